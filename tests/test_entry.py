"""Driver contract: entry runs, registries line up, names carry inventory keys."""

import re

import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert set(df.columns) == {"risk_category", "n_patients", "avg_score", "n_in_zone"}


def test_registries_consistent():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    for name in q:
        assert re.match(r"^([A-Z]\d+_|op\d+_|pipeline$)", name), name
    assert len(q) >= 150
