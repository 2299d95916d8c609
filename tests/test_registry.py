"""The stored registry: versions, rejected duplicates, repeated calls."""

from medlake.operators import registry
from medlake.session import scratch_path


def perf(spark, rows):
    return spark.createDataFrame(rows, "model string, auc double, trained_at date").selectExpr("model", "auc", "trained_at")


def test_second_registration_is_rejected(spark):
    import datetime
    day, store = datetime.date(2024, 1, 5), scratch_path(spark, "registry-test")
    assert registry.current_registry(spark, store)[0] == 0
    first = registry.register_in(spark, store, perf(spark, [("a", 0.7, day), ("b", 0.8, day), ("b", 0.9, day)]))
    assert sorted((r["model"], r["rejected"]) for r in first.collect()) == [("a", False), ("b", False), ("b", True)]
    version, rows = registry.current_registry(spark, store)
    assert version == 1 and sorted((r["model"], r["performance"]) for r in rows.collect()) == [("a", 0.7), ("b", 0.9)]
    again = registry.register_in(spark, store, perf(spark, [("a", 0.99, day), ("c", 0.6, day)]))
    assert sorted((r["model"], r["rejected"]) for r in again.collect()) == [("a", True), ("c", False)]
    version, rows = registry.current_registry(spark, store)
    assert version == 2 and sorted((r["model"], r["performance"]) for r in rows.collect()) == [("a", 0.7), ("b", 0.9), ("c", 0.6)]
    none = registry.register_in(spark, store, perf(spark, [("a", 1.0, day)]))
    assert none.first()["rejected"] and registry.current_registry(spark, store)[0] == 2
    assert registry.register_in(spark, store, perf(spark, [])).count() == 0
