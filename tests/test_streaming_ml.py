"""Streaming forms (watermark, late data, state) and ML helpers."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlake.operators import ml
from medlake.session import scratch_path
from medlake.streaming import monitors as sm


def _write_batches(spark, batches):
    import time
    d = tempfile.mkdtemp(prefix="medlake-stream-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "unit int, ts string").selectExpr("unit", "cast(ts AS timestamp) AS ts") \
            .coalesce(1).write.mode("append").parquet(os.path.join(d, f"part{i:02d}"))
        time.sleep(1.1)  # file order = modification time
    return d


def test_watermark_finalizes_and_drops_late_rows(spark):
    b1 = [(1, "2024-01-01 10:00:00"), (1, "2024-01-03 10:00:00")]
    b2 = [(1, "2024-01-05 10:00:00")]
    b3 = [(1, "2024-01-01 11:00:00"), (1, "2024-01-05 11:00:00")]  # the first row is far behind the watermark
    d = _write_batches(spark, [b1, b2, b3])
    stream = (spark.readStream.schema("unit int, ts timestamp").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(d))
    out = sm.run_available_now(sm.tumbling_event_counts(stream, ["unit"], "1 hour", "1 day"), "t-wm", "append")
    got = {str(r["window_start"])[:10]: r["n"] for r in out.collect()}
    # finalized windows only; the late row did not reopen 2024-01-01; 2024-01-05 is still open
    assert got == {"2024-01-01": 1, "2024-01-03": 1}


def test_adwin_detects_shift():
    ad = sm.Adwin(delta=0.002)
    rng = np.random.default_rng(0)
    hits = [i for i, x in enumerate(np.r_[rng.normal(0, 0.1, 500), rng.normal(1, 0.1, 500)]) if ad.add(x)]
    assert hits and 500 <= hits[0] < 560
    assert ad.width < 600  # the old regime was dropped


def test_ddm_stream_state(spark):
    rows = [("m", i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", 1.0 if (i >= 300 and i % 2) else 0.0)
            for i in range(600)]
    d = os.path.join(tempfile.mkdtemp(prefix="medlake-ddm-"), "log")
    spark.createDataFrame(rows, "model string, event_id long, t string, error double").selectExpr(
        "model", "event_id", "cast(t AS timestamp) AS ts", "error").write.parquet(d)
    s = spark.readStream.schema("model string, event_id long, ts timestamp, error double").parquet(d)
    out = sm.run_available_now(sm.ddm_stream(s), "t-ddm")
    levels = [(r["event_id"], r["level"]) for r in out.orderBy("event_id").collect()]
    assert any(lv == "drift" and eid >= 300 for eid, lv in levels)
    assert not any(eid < 300 for eid, _ in levels)


def test_gradient_step_matches_numpy(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(50, 4))
    y = (rng.random(50) > 0.5).astype(float)
    df = spark.createDataFrame([(x.tolist(), float(t)) for x, t in zip(X, y)], "v array<double>, label double")
    w0 = [0.1, -0.2, 0.0, 0.3]
    w, b = ml.gradient_step(df, w0, 0.05, "v", "label", lr=0.5)
    p = 1 / (1 + np.exp(-(X @ np.array(w0) + 0.05)))
    want_w = np.array(w0) - 0.5 * ((p - y) @ X) / 50
    assert np.allclose(w, want_w) and b == pytest.approx(0.05 - 0.5 * (p - y).mean())


def test_smote_interpolates_between_minority_points(spark):
    pts = [(i, [float(i % 5), float(i // 5)], 1 if i < 8 else 0) for i in range(30)]
    df = spark.createDataFrame(pts, "id long, v array<double>, y int")
    s = ml.smote(df, "v", "y", "id", minority=1, k=3)
    rows = s.collect()
    assert len(rows) == 22 - 8
    mino = np.array([p[1] for p in pts if p[2] == 1])
    lo, hi = mino.min(0), mino.max(0)
    for r in rows:
        assert np.all(np.array(r["v"]) >= lo - 1e-9) and np.all(np.array(r["v"]) <= hi + 1e-9)


def _true_nearest(pts, k):
    """{key: [(squared distance, key) of the k nearest others]}."""
    keys, x = [p[0] for p in pts], np.array([p[1] for p in pts])
    out = {}
    for i, a in enumerate(keys):
        d = ((x - x[i]) ** 2).sum(axis=1)
        out[a] = sorted((float(d[j]), b) for j, b in enumerate(keys) if b != a)[:k]
    return out


@pytest.mark.parametrize("block", [None, 100, 7])
def test_nearest_neighbours_are_exact(spark, block):
    """Random points in 64 dimensions, 40 copies of one, a near copy far from
    the origin, points on a grid (ties), and vectors that cannot compare."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 64)), np.repeat(rng.normal(size=(1, 64)), 40, axis=0),
                        1e6 + 1e-3 * rng.normal(size=(20, 64)), rng.integers(0, 2, (60, 64)) * (np.arange(64) < 5)])
    pts = [(i * 7 % 1000, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [float("nan")] * 64), (2003, [None] * 64), (2004, [float("inf")] * 64), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(pts + odd, "a long, x array<double>").repartition(3)
    got = {}
    for r in ml.nearest_neighbours(df, 5, len(pts), block).orderBy("a", "rank").collect():
        got.setdefault(r["a"], []).append((r["d"], r["b"]))
    want = _true_nearest(pts, 5)
    assert set(got) == set(want)
    for a in want:
        assert [b for _, b in got[a]] == [b for _, b in want[a]], a
        assert [d for d, _ in got[a]] == pytest.approx([d for d, _ in want[a]], rel=1e-9)


@pytest.mark.parametrize("pivots", [1, 8, 60])
def test_far_cells_never_meet_and_neighbours_stay_exact(spark, pivots):
    """Clusters far apart: the pairs that meet are a small part of all pairs."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 16)) * 50
    x = np.concatenate([c + rng.normal(size=(20 if i else 200, 16)) for i, c in enumerate(centre)])
    pts = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(pts, "a long, x array<double>").repartition(3)
    got = {}
    for r in ml.nearest_neighbours(df, 4, len(pts), 64, pivots).orderBy("a", "rank").collect():
        got.setdefault(r["a"], []).append((r["d"], r["b"]))
    want = _true_nearest(pts, 4)
    assert {a: [b for _, b in v] for a, v in got.items()} == {a: [b for _, b in v] for a, v in want.items()}
    placed, meets = ml._cells(df, 4, len(pts), pivots)
    member = placed.join(meets, ["dim", "cell"]).where("r >= least").groupBy(F.col("to").alias("cell")).agg(F.count("*").alias("m"))
    pairs = placed.groupBy("cell").agg(F.count("*").alias("n")).join(member, "cell").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert pairs == len(pts) ** 2 if pivots == 1 else pairs < len(pts) ** 2 / (4 if pivots == 60 else 1)


def test_smote_samples_lie_towards_true_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 64))
    pts = [(str(i), v.tolist(), 1 if i < 400 else 0) for i, v in enumerate(np.concatenate([x, rng.normal(size=(900, 64))]))]
    df = spark.createDataFrame(pts, "id string, v array<double>, y int")
    rows = ml.smote(df, "v", "y", "id", minority=1, k=5).collect()
    assert len(rows) == 500
    want = _true_nearest([(i, v) for i, v, y in pts if y], 5)
    for r in rows:
        src = r["id"].split("_")[1]
        step = np.array(r["v"]) - x[int(src)]
        ways = [x[int(b)] - x[int(src)] for _, b in want[src]]
        assert max(float(step @ w) / np.sqrt((step @ step) * (w @ w)) for w in ways) > 1 - 1e-9


def test_federated_average_unweighted(spark):
    sm_ = spark.createDataFrame([(0, [1.0, 2.0], 10), (1, [3.0, 6.0], 30)], "site int, coefficients array<double>, n int")
    got = {r["pos"]: r["w"] for r in ml.federated_average(sm_).collect()}
    assert got == {0: 2.0, 1: 4.0}
    gw = {r["pos"]: r["w"] for r in ml.federated_average(sm_, "n").collect()}
    assert gw[0] == pytest.approx(2.5)


def test_replay_sample_with_replacement(spark):
    ev = spark.createDataFrame([("a", i, i) for i in range(10)], "model string, ts long, event_id long")
    buf = ml.replay_buffer(ev, "model", "ts", "event_id", 4)
    assert sorted(r["event_id"] for r in buf.collect()) == [6, 7, 8, 9]
    s = ml.replay_sample(buf, "model", 50)
    assert s.count() == 50 and {r["event_id"] for r in s.collect()} <= {6, 7, 8, 9}


def test_logistic_penalty_scaling(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(200, 3))
    y = (X[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(float)
    df = ml.with_features(spark.createDataFrame([(x.tolist(), float(t)) for x, t in zip(X, y)],
                                                "v array<double>, label double"), "v")
    m = ml.train(df, "logistic", "label")
    s = ml.positive_probability(m.transform(df))
    from medlake.operators import metrics
    assert metrics.roc_auc(s, "p", "label").first()["auc"] > 0.85


def test_latency_percentiles_stream(spark):
    rows = [("api", f"2024-01-01 00:{i % 60:02d}:00", float(i)) for i in range(100)]
    d = os.path.join(tempfile.mkdtemp(prefix="medlake-lat-"), "log")
    spark.createDataFrame(rows, "endpoint string, t string, latency double").selectExpr(
        "endpoint", "cast(t AS timestamp) AS ts", "latency").write.parquet(d)
    s = spark.readStream.schema("endpoint string, ts timestamp, latency double").parquet(d)
    out = sm.run_available_now(sm.latency_percentiles_stream(s, "endpoint", "latency"), "t-lat", "update",
                               keys=["endpoint", "window_start"]).first()
    assert out["n"] == 100 and 93 <= out["p95"] <= 96 and 97 <= out["p99"] <= 99


def test_random_search_small(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 3))
    y = (X[:, 0] > 0).astype(float)
    df = ml.with_features(spark.createDataFrame([(i, x.tolist(), float(t)) for i, (x, t) in enumerate(zip(X, y))],
                                                "id long, v array<double>, label double"), "v")
    space = ml.sample_space(2, seed=1)
    assert all(100 <= p["num_trees"] <= 1000 and 3 <= p["max_depth"] <= 10 for p in space)
    small = {"num_trees": (2, 3, False), "max_depth": (2, 3, False), "learning_rate": (0.1, 0.5, True),
             "subsample": (0.8, 1.0, False), "colsample": (0.6, 1.0, False)}
    import medlake.operators.ml as mlmod
    res = [mlmod.cross_validate(df, ["gbt"], "id", k=2, params={"gbt": p}).first()["cv_auc"]
           for p in mlmod.sample_space(2, seed=3, space=small)]
    assert all(0.5 <= a <= 1.0 for a in res)


def test_online_logistic_stream_steps(spark):
    rng = np.random.default_rng(4)
    base = tempfile.mkdtemp(prefix="medlake-online-")
    data = os.path.join(base, "in")
    for i in range(3):
        X = rng.normal(size=(40, 3))
        y = (X[:, 0] > 0).astype(float)
        spark.createDataFrame([(x.tolist(), float(t)) for x, t in zip(X, y)], "features_array array<double>, label double") \
            .coalesce(1).write.mode("append").parquet(os.path.join(data, f"b{i}"))
        import time
        time.sleep(1.1)
    s = (spark.readStream.schema("features_array array<double>, label double").option("maxFilesPerTrigger", 1)
         .option("recursiveFileLookup", "true").parquet(data))
    wpath = os.path.join(base, "weights")
    q = (s.writeStream.foreachBatch(sm.online_logistic_sink(wpath, lr=0.5)).option(
        "checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    w = spark.read.parquet(wpath).orderBy("epoch").collect()
    assert [r["epoch"] for r in w] == [0, 1, 2]
    assert w[-1]["weights"][0] > 0  # learns the sign of the informative feature


def test_census_stream(spark):
    rows = [(p, f"2024-01-0{1 + (p % 2)} 10:00:00") for p in range(50)] + [(1, "2024-01-02 11:00:00")]
    d = os.path.join(tempfile.mkdtemp(prefix="medlake-census-"), "s")
    spark.createDataFrame(rows, "patient long, t string").selectExpr("patient", "cast(t AS timestamp) AS ts").write.parquet(d)
    s = spark.readStream.schema("patient long, ts timestamp").parquet(d)
    out = {str(r["window_start"])[:10]: r["approx_patients"] for r in
           sm.run_available_now(sm.census_stream(s, "patient"), "t-census", "update", keys=["window_start"]).collect()}
    assert set(out) == {"2024-01-01", "2024-01-02"}
    assert all(abs(v - 25) <= 2 for v in out.values())  # HyperLogLog, ~5% relative error


def test_linear_shap_additive(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(80, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, -1.0]
    y = (X[:, 0] + 0.1 * X[:, 1] > 0.3).astype(float)
    df = spark.createDataFrame([(i, *map(float, x), float(t)) for i, (x, t) in enumerate(zip(X, y))],
                               "id long, a double, b double, c double, label double")
    cols = ["a", "b", "c"]
    m = ml.train(ml.with_features(df, cols), "logistic", "label")
    means = {c: float(np.mean(X[:, i])) for i, c in enumerate(cols)}
    sh = {r["id"]: sum(r[f"shap_{c}"] for c in cols) for r in ml.linear_shap(df, m, cols, means, "id").collect()}
    from pyspark.ml.functions import vector_to_array
    margin = {r["id"]: r["m"] for r in m.transform(ml.with_features(df, cols)).select(
        "id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    b = m.stages[-1].intercept
    assert all(abs(sh[i] - (margin[i] - b)) < 1e-6 for i in sh)


def test_cross_validation_tasks_do_not_grow_with_rows_up_to_the_rows_of_a_task():
    assert [ml.cv_tasks(n, 12) for n in (0, 1, 1500, 5000)] == [1, 1, 2, 5]
    assert ml.cv_tasks(120_000, 12) == ml.cv_tasks(1_200_000, 12) == 12
    assert ml.cv_tasks(12_000_000, 12) == 120


def test_detectors_hold_three_numbers_a_row_and_emit_in_parts(monkeypatch):
    import tracemalloc

    import pandas as pd
    n, rng = 200_000, np.random.default_rng(2)
    at = rng.permutation(n)

    def frames():
        for lo in range(0, n, 10_000):
            i = at[lo:lo + 10_000]
            yield pd.DataFrame({"model": ["m" * 500 + str(k) for k in i], "event_id": i, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(i // 2, unit="s"),
                                "error": i % 3.0})
    tracemalloc.start()
    got = 0
    for k, (event_id, ts, error) in enumerate(sm.in_order(frames(), "error")):
        assert event_id == k and error == k % 3
        got += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == n and peak < 100 * n

    class State:
        exists = False

        def update(self, v):
            self.value = v
    monkeypatch.setattr(sm, "PART_ROWS", 100)
    rows = pd.DataFrame({"model": "m", "event_id": range(3000), "ts": pd.Timestamp("2024-01-01"), "error": [float(k % (10 if k < 300 else 2) == 0) for k in range(3000)]})
    parts = list(sm.ddm_state_fn(drift_level=99.0)(("m",), iter([rows]), State()))
    whole = pd.concat(parts)
    assert max(map(len, parts)) == 100 < len(whole) and whole["event_id"].is_monotonic_increasing
