"""Sources/sinks (GeoJSON, snapshots) and monitors against naive references."""

import json
import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from medlake.operators import clinical as cl
from medlake.operators import monitor
from medlake.sources import files


def test_geojson_feature_collection_int_coords(spark):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"zip_code": "Z01", "pm2_5": 12},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]]}},
        {"type": "Feature", "properties": {"zip_code": "Z02", "pm2_5": 7.5},
         "geometry": {"type": "Polygon", "coordinates": [[[1.5, 1], [2, 1], [2, 2], [1.5, 1]]]}}]}
    d = tempfile.mkdtemp(prefix="medlake-geo-")
    p = os.path.join(d, "zones.geojson")
    with open(p, "w") as f:
        json.dump(fc, f, indent=2)
    g = files.read_geojson(spark, p).collect()
    assert [r["properties"]["zip_code"] for r in g] == ["Z01", "Z02"]
    assert g[0]["ring"][2]["x"] == 4.0 and isinstance(g[0]["ring"][2]["x"], float)
    assert g[1]["properties"]["pm2_5"] == "7.5"


def test_snapshot_delta_and_digest(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None)], "id int, s string, x double")
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.5), (4, "d", 4.0)], "id int, s string, x double")
    got = sorted(tuple(r) for r in files.snapshot_delta(old, new, "id").collect())
    assert got == [(2, "updated"), (3, "deleted"), (4, "inserted")]
    d1 = files.snapshot_digest(old).first()
    d2 = files.snapshot_digest(old.orderBy(F.desc("id")).repartition(3)).first()
    assert tuple(d1) == tuple(d2)  # order- and partition-independent


def test_rolling_accuracy_matches_window(spark):
    rows = [("m" if i % 5 else "n", i, int((i * 7) % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "model string, ts long, ok int")
    got = {r["ts"]: r["rolling_accuracy"] for r in
           monitor.rolling_metric_alert(df, ["model"], "ts", "ts", F.col("ok") == 1, window_rows=25).collect()}
    w = Window.partitionBy("model").orderBy("ts").rowsBetween(-24, 0)
    want = {r["ts"]: r["a"] for r in df.select("ts", F.avg("ok").over(w).alias("a")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_missed_dose_runs_and_gaps(spark):
    doses = spark.createDataFrame([("p", "d", "2024-01-01"), ("p", "d", "2024-01-02"), ("p", "d", "2024-01-06"),
                                   ("p", "d", "2024-01-09"), ("p", "e", "2024-01-01")],
                                  "patient_id string, drug string, t string").withColumn("ts", F.to_timestamp("t"))
    got = [(str(r["last_taken"]), str(r["next_taken"]), r["missed_days"])
           for r in cl.missed_dose_runs(doses, ["patient_id", "drug"], "ts", 2).collect()]
    assert got == [("2024-01-02", "2024-01-06", 3)]  # the 2-day gap before the 9th is not > 2


def test_interactions_only_interacting_pairs(spark):
    meds = spark.createDataFrame([("p1", "A"), ("p1", "B"), ("p1", "C"), ("p2", "A"), ("p2", "C")],
                                 "patient_id string, drug string")
    pairs = spark.createDataFrame([("A", "B"), ("B", "C")], "drug_a string, drug_b string")
    got = sorted(tuple(r) for r in cl.drug_interactions(meds, pairs).collect())
    assert got == [("p1", "A", "B"), ("p1", "B", "C")]


def test_sliding_counts_match_window(spark):
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-02 23:59:59")],
                               "k int, t string").withColumn("ts", F.to_timestamp("t"))
    a = {(r["k"], str(r["window_start"])): r["n"] for r in cl.sliding_counts(ev, ["k"], "ts", "6 hours", "1 hour").collect()}
    w = F.window("ts", "6 hours", "1 hour")
    b = {(r["k"], str(r["ws"])): r["n"] for r in ev.groupBy("k", w.start.alias("ws")).agg(F.count("*").alias("n")).collect()}
    assert a == b


def test_page_hinkley_detects_shift(spark):
    rows = [("m", i, 0.1 if i < 200 else 0.9) for i in range(400)]
    df = spark.createDataFrame(rows, "model string, ts long, x double")
    r = monitor.page_hinkley_first_drift(df, ["model"], "ts", "ts", F.col("x"), delta=0.005, threshold=5.0).first()
    assert 200 < r["first_alarm"] < 230
