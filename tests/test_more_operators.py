"""More hand-computed cases: feature store, heartbeats, identity matching,
sepsis screen, record standardisation, file integrity."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from medlake.operators import audit, quality
from medlake.operators import clinical as cl
from medlake.sources import files


def test_feature_store_check(spark):
    feats = spark.createDataFrame([("a", "2024-01-01 10:00:00", 1.0, None), ("b", "2024-01-01 11:30:00", 2.0, 5.0)],
                                  "k string, ts string, x double, y double")
    src = spark.createDataFrame([("a", 1.0, None), ("b", 2.5, 5.0)], "k string, x double, y double")
    r = quality.feature_store_check(feats, src, "k", "ts", "2024-01-01 12:00:00", ["x", "y"]).first()
    assert r["staleness_seconds"] == 1800 and r["fresh"]
    assert r["completeness"] == pytest.approx(0.75) and not r["complete"]
    assert r["consistency"] == pytest.approx(0.5) and not r["consistent"]


def test_heartbeat_gaps(spark):
    log = spark.createDataFrame([("p", "2024-01-01 00:00:00", 1), ("p", "2024-01-01 00:10:00", 2),
                                 ("p", "2024-01-01 02:00:00", 3), ("q", "2024-01-01 00:00:00", 4)],
                                "pipeline string, ts string, id int").withColumn("ts", F.to_timestamp("ts"))
    g = quality.heartbeat_gaps(log, "pipeline", "ts", 3600, tiebreak="id").collect()
    assert [(r["pipeline"], r["gap_seconds"]) for r in g] == [("p", 6600)]


def test_identity_matching(spark):
    a = spark.createDataFrame([(1, "Ann Lee", 1980, "Z1"), (2, "Bob Ray", 1975, "Z2"), (3, "Cy Dee", 1990, "Z3")],
                              "id int, name string, yob int, zip string")
    b = spark.createDataFrame([(10, " ann lee", 1980, "Z9"), (11, "Bob Rai", 1975, "Z2"), (12, "Zed", 1990, "Z7")],
                              "rid int, name string, yob int, zip string")
    det = {tuple(r) for r in quality.deterministic_matches(a, b, ["name", "yob"], "id", "rid").collect()}
    assert det == {(1, 10)}
    prob = {r["l_id"]: r["r_id"] for r in quality.probabilistic_matches(
        a, b, "id", "rid", blocks=[["yob"]], weights={"yob": 2.0, "zip": 2.0}, name="name",
        max_edits=2, name_weight=3.0, threshold=5.0).collect()}
    assert prob == {2: 11}  # same yob + zip + name within 2 edits; 1 has a different zip and case


def test_sepsis_screen_latest_values(spark):
    r = spark.createDataFrame([(1, "heart_rate", "2024-01-01 00:00:00", 120.0, 1),
                               (1, "heart_rate", "2024-01-01 01:00:00", 80.0, 2),
                               (1, "resp_rate", "2024-01-01 00:30:00", 25.0, 3),
                               (1, "temperature", "2024-01-01 00:30:00", 39.0, 4)],
                              "patient_key int, metric string, t string, value double, event_id int").withColumn(
        "ts", F.to_timestamp("t"))
    s = cl.sepsis_screen(r, "patient_key", "metric", "ts", "value", "event_id").first()
    assert s["heart_rate"] == 80.0 and s["sirs_score"] == 2 and s["alert"]


def test_standardize_try_cast(spark):
    raw = spark.createDataFrame([('{"k": "7"}', "12.5"), ('{"k": "x"}', "n/a")], "props string, amount string")
    out = files.standardize(raw, [("k", "get_json_object(props, '$.k')", "int"), ("amount", "amount", "double")])
    assert [tuple(r) for r in out.collect()] == [(7, 12.5), (None, None)]


def test_file_integrity(spark):
    d1, d2 = tempfile.mkdtemp(prefix="fi-a-"), tempfile.mkdtemp(prefix="fi-b-")
    for d, files_ in ((d1, {"a.bin": b"1", "b.bin": b"2"}), (d2, {"a.bin": b"1", "b.bin": b"3", "c.bin": b"4"})):
        for n, c in files_.items():
            with open(os.path.join(d, n), "wb") as f:
                f.write(c)
    diff = {r["name"]: r["status"] for r in audit.integrity_diff(audit.file_hashes(spark, d2 + "/*.bin"),
                                                                audit.file_hashes(spark, d1 + "/*.bin")).collect()}
    assert diff == {"a.bin": "same", "b.bin": "changed", "c.bin": "new"}


def _best_pairs(a, b, blocks, weights):
    """(l_id -> (r_id, score)) over candidate ids, each scored through all rows of both ids."""
    names = ("name", "yob", "zip")
    rows = lambda t: [(r[0], dict(zip(names, r[1:]))) for r in t if r[0] is not None]
    out = {}
    for l, r in {(l, r) for l, x in rows(a) for r, y in rows(b) for k in blocks if all(x[f] is not None and x[f] == y[f] for f in k)}:
        s = max(sum(w for f, w in weights.items() if x[f] == y[f]) for i, x in rows(a) if i == l for j, y in rows(b) if j == r)
        if s >= 3.0 and (l not in out or (s, -r) > (out[l][1], -out[l][0])):
            out[l] = (r, s)
    return out


def test_probabilistic_matching_of_copies_and_repeated_ids(spark):
    rng = random.Random(5)
    row = lambda: (rng.choice(("ann", "bob", None)), rng.choice((1980, 1981, None)), rng.choice(("Z1", "Z2", "Z3", None)))
    a = [(rng.choice((None, *range(25))), *row()) for _ in range(40)]
    b = [(rng.choice((None, *range(100, 125))), *row()) for _ in range(40)]
    blocks, weights = [["name"], ["yob", "zip"], ["zip"]], {"name": 3.0, "yob": 2.0, "zip": 1.0}
    match = lambda x, y: quality.probabilistic_matches(
        spark.createDataFrame(x, "id long, name string, yob int, zip string"),
        spark.createDataFrame(y, "rid long, name string, yob int, zip string"), "id", "rid", blocks=blocks, weights=weights, threshold=3.0)
    assert {r["l_id"]: (r["r_id"], r["score"]) for r in match(a, b).collect()} == _best_pairs(a, b, blocks, weights)

    # a thousand equal records on each side meet as one pair, not as a million
    same = [(i, "ann", 1980, "Z1") for i in range(1000)]
    got = match(same, [(i + 5000, *r) for i, *r in same])
    assert {(r["r_id"], r["score"]) for r in got.collect()} == {(5000, 6.0)} and got.count() == 1000
