"""Bucketed ordered helpers agree with plain windows, on both the light-key
path and the heavy-key (split) path."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from medlake.operators.ordered import (bucketed_lag, exact_quantiles, exact_quantiles_df, running_totals,
                                       trailing_window)


def _skewed(spark):
    # key 'hot' holds most rows; ties in ts broken by id
    rows = [("hot" if i % 4 else f"k{i % 7}", i // 3, i, float((i * 37) % 101)) for i in range(600)]
    return spark.createDataFrame(rows, "k string, ts long, id long, v double")


def test_running_totals_heavy_matches_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: (r["c"], r["t"]) for r in df.select("id", F.sum("v").over(w).alias("c"),
                                                         F.sum("v").over(Window.partitionBy("k")).alias("t")).collect()}
    for heavy in (10, 10**9):
        got = running_totals(df, ["ts", "id"], ["v"], partition_cols=["k"], n_buckets=8, heavy_rows=heavy)
        res = {r["id"]: (r["cum_v"], r["total_v"]) for r in got.collect()}
        assert res == want


def test_running_totals_descending_global(spark):
    df = _skewed(spark)
    w = Window.orderBy(F.col("ts").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: r["c"] for r in df.select("id", F.sum("v").over(w).alias("c")).collect()}
    got = running_totals(df, ["ts", "id"], ["v"], descending=True, n_buckets=8)
    assert {r["id"]: r["cum_v"] for r in got.collect()} == want


def test_bucketed_lag_matches_lag(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {r["id"]: r["p"] for r in df.select("id", F.lag("v").over(w).alias("p")).collect()}
    for heavy in (5, 10**9):
        got = bucketed_lag(df, ["ts", "id"], "v", partition_cols=["k"], n_buckets=8, heavy_rows=heavy)
        assert {r["id"]: r["prev_v"] for r in got.collect()} == want


def test_exact_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    q = exact_quantiles(df, "x", [0.0, 0.2, 0.5, 1.0])
    assert q == [1.0, 1.6, 2.5, 10.0]


def test_exact_quantiles_grouped_heavy(spark):
    df = _skewed(spark)
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles_df(df, "v", [0.25, 0.5], ["k"], n_buckets=4,
                                                                heavy_rows=5).collect()}
    import numpy as np
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        for p in (0.25, 0.5):
            assert abs(got[(k, p)] - float(np.quantile(g["v"], p))) < 1e-9


def test_trailing_window_chunks_match(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-3, -1)
    want = {r["id"]: r["m"] for r in df.select("id", F.avg("v").over(w).alias("m")).collect()}
    got = trailing_window(df, ["k"], ["ts", "id"], 3, {"m": F.avg("v")}, chunk_rows=7, heavy_rows=20)
    res = {r["id"]: r["m"] for r in got.collect()}
    assert res.keys() == want.keys()
    for k in want:
        assert (want[k] is None and res[k] is None) or abs(want[k] - res[k]) < 1e-9


def test_many_heavy_keys_fall_back_to_shuffle_join(spark, monkeypatch):
    import medlake.operators.ordered as od
    monkeypatch.setattr(od, "MAX_HEAVY_KEYS", 2)       # more heavy keys than the broadcast bound
    monkeypatch.setattr(od, "MAX_BOOKKEEPING_ROWS", 12)  # forces fewer buckets per key
    rows = [(f"k{i % 5}", i, float(i % 13)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, ts long, v double")
    got = od.running_totals(df, ["ts"], ["v"], partition_cols=["k"], n_buckets=16, heavy_rows=10)
    w = Window.partitionBy("k").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["ts"]: r["c"] for r in df.select("ts", F.sum("v").over(w).alias("c")).collect()}
    assert {r["ts"]: r["cum_v"] for r in got.collect()} == want
    _, kind = od._assign_buckets(df, [F.col("ts")], ["k"], 16, 10)
    assert kind == "heavy_many"


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("every", [1000, 4])
def test_running_totals_with_nan_and_null_order(spark, descending, every):
    """Both paths sort NaN and NULL as Spark does."""
    rows = [(i % 2, None if i % 97 == 5 else float("nan") if i % every == 0 else float((i * 37) % 500), i, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, x double, id int, v long").repartition(4)
    order = [F.col("x"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*[o.desc() if descending else o.asc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: r["s"] for r in df.select("id", F.sum("v").over(w).alias("s")).collect()}
    for heavy in (10, 10 ** 6):
        got = running_totals(df, order, ["v"], partition_cols=["k"], descending=descending, n_buckets=8, heavy_rows=heavy)
        assert {r["id"]: r["cum_v"] for r in got.collect()} == want


def test_trailing_window_longer_than_a_chunk(spark):
    df = spark.range(20).select(F.lit(1).alias("k"), F.col("id").alias("ts"), F.lit(1.0).alias("v"))
    got = trailing_window(df, ["k"], ["ts"], 10, {"n": F.count("v")}, chunk_rows=4, heavy_rows=5)
    assert [r["n"] for r in got.orderBy("ts").collect()] == [min(i, 10) for i in range(20)]
