"""Spatial join edge cases, curve metrics against brute force, drift tests."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlake.operators import drift, joins, metrics
from medlake.sources.derived import zone_rings


def _zones(spark):
    z = spark.createDataFrame([("A", 0.0, 10.0, 0.0, 10.0), ("B", 5.0, 15.0, 0.0, 10.0)],
                              "zip_code string, min_x double, max_x double, min_y double, max_y double")
    return zone_rings(z)


def test_spatial_within_boundary_overlap_left(spark):
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 7.0, 5.0), (3, 10.0, 5.0), (4, 50.0, 50.0), (5, 0.0, 3.0)],
                                "id int, longitude double, latitude double")
    got = sorted((r["id"], r["zip_code"]) for r in joins.spatial_within_join(pts, _zones(spark), cell=4.0).collect())
    # 2 is in both zones; 3 lies on A's edge (inside B); 4 is nowhere; 5 is on A's edge only
    assert got == [(1, "A"), (2, "A"), (2, "B"), (3, "B"), (4, None), (5, None)]
    inner = joins.spatial_within_join(pts, _zones(spark), how="inner", cell=4.0)
    assert inner.count() == 4


def test_spatial_polygon_triangle(spark):
    tri = spark.createDataFrame([("T", [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)])],
                                "zip_code string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 6.0, 6.0), (3, 5.0, 5.0)], "id int, longitude double, latitude double")
    got = sorted((r["id"], r["zip_code"]) for r in joins.spatial_within_join(pts, tri).collect())
    assert got == [(1, "T"), (2, None), (3, None)]  # 3 is on the hypotenuse


def _scores(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)  # rounding makes ties
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int"), p, y


def _auc_brute(p, y):
    pos, neg = p[y == 1], p[y == 0]
    s = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def test_auc_matches_pairwise_and_monotone(spark):
    df, p, y = _scores(spark)
    auc = metrics.roc_auc(df, "p", "y").first()["auc"]
    assert auc == pytest.approx(_auc_brute(p, y), abs=1e-12)
    auc2 = metrics.roc_auc(df.withColumn("p", F.exp(F.col("p") * 3)), "p", "y").first()["auc"]
    assert auc2 == pytest.approx(auc, abs=1e-12)


def test_average_precision_brute(spark):
    df, p, y = _scores(spark)
    ap = metrics.average_precision(df, "p", "y").first()["ap"]
    th = np.unique(p)[::-1]
    prev_r, want = 0.0, 0.0
    for t in th:
        pred = p >= t
        tp = (pred & (y == 1)).sum()
        prec, rec = tp / pred.sum(), tp / (y == 1).sum()
        want += (rec - prev_r) * prec
        prev_r = rec
    assert ap == pytest.approx(want, abs=1e-12)


def test_youden_and_sweep(spark):
    df, p, y = _scores(spark)
    th = np.unique(p)[::-1]
    P, N = (y == 1).sum(), (y == 0).sum()
    best = max(th, key=lambda t: (((p >= t) & (y == 1)).sum() / P - ((p >= t) & (y == 0)).sum() / N, t))
    assert metrics.youden_threshold(df, "p", "y").first()["threshold"] == pytest.approx(best)
    sw = {round(r["threshold"], 1): r for r in metrics.threshold_sweep(df, "p", "y").collect()}
    t = 0.5
    tp = ((p >= t) & (y == 1)).sum()
    assert sw[0.5]["precision"] == pytest.approx(tp / (p >= t).sum())
    assert len(sw) == 11


def test_ks_identical_is_zero(spark):
    df = spark.createDataFrame([(float(i % 17),) for i in range(200)], "x double")
    k = drift.ks_drift(df, df, ["x"]).first()
    assert k["statistic"] == 0.0 and k["p_value"] == pytest.approx(1.0) and not k["drift"]


def test_ks_shift_detected(spark):
    a = spark.createDataFrame([(float(i),) for i in range(300)], "x double")
    b = spark.createDataFrame([(float(i) + 150,) for i in range(300)], "x double")
    k = drift.ks_drift(a, b, ["x"]).first()
    assert k["statistic"] == pytest.approx(0.5) and k["drift"]


def test_chi2_pvalue(spark):
    a = spark.createDataFrame([("u",)] * 50 + [("v",)] * 50, "c string")
    b = spark.createDataFrame([("u",)] * 30 + [("v",)] * 70, "c string")
    r = drift.chi2_drift(a, b, ["c"]).first()
    assert r["statistic"] == pytest.approx(8.333333, rel=1e-6)  # Pearson, no continuity correction
    assert r["p_value"] == pytest.approx(0.0038924, rel=1e-4)


def test_psi_same_is_zero(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    assert drift.psi(df, df, "x").first()["psi"] == pytest.approx(0.0)


def test_spatial_one_zone_option(spark):
    pts = spark.createDataFrame([(2, 7.0, 5.0), (4, 50.0, 50.0)], "id int, longitude double, latitude double")
    got = sorted((r["id"], r["zip_code"]) for r in joins.spatial_within_join(
        pts, _zones(spark), cell=4.0, one_zone_by=("id", "zip_code")).collect())
    assert got == [(2, "A"), (4, None)]


def test_pr_curve_library_form(spark):
    df, p, y = _scores(spark, n=120, seed=5)
    pts = metrics.precision_recall_curve(df, "p", "y").collect()
    th = sorted({r["threshold"] for r in pts if r["threshold"] is not None}, reverse=True)
    P = (y == 1).sum()
    # thresholds run from the top score down to the first reaching full recall
    full = max(t for t in np.unique(p) if ((p >= t) & (y == 1)).sum() == P)
    assert th[0] == pytest.approx(p.max()) and th[-1] == pytest.approx(full)
    end = [r for r in pts if r["threshold"] is None]
    assert len(end) == 1 and end[0]["precision"] == 1.0 and end[0]["recall"] == 0.0
