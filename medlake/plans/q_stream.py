"""Registered queries that run the streaming forms end to end: the landed
table is read as a stream, processed with watermarks / state, written to
a parquet sink in the shared checkpoint folder (``availableNow``), and the
sink is returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.plans.catalog import register
from medlake.sources.derived import SPECS
from medlake.streaming import monitors as sm


def _vitals_stream(spark, sf):
    ev = sm.table_stream(spark, sf, "events")
    return ev.selectExpr(*[f"{e} AS {a}" for e, a in SPECS["vitals"][2]])


def _pred_stream(spark, sf):
    ev = sm.table_stream(spark, sf, "events")
    return ev.selectExpr(*[f"{e} AS {a}" for e, a in SPECS["predictions"][2]])


@register("C2_lab_alerts_stream")
def c2s(spark, sf):
    out = sm.run_available_now(sm.lab_alert_counts(_vitals_stream(spark, sf)), "c2-stream", "update",
                               keys=["patient_key", "metric", "window_start"])
    return out.select("patient_key", "metric", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias(
        "window_start"), "n")


@register("C5_safety_events_stream")
def c5s(spark, sf):
    ev = sm.table_stream(spark, sf, "events").where("event_type = 'error'").selectExpr(
        "cast(user_id % 10 AS int) AS unit", "ts")
    out = sm.run_available_now(sm.tumbling_event_counts(ev, ["unit"]), "c5-stream", "update",
                               keys=["unit", "window_start"])
    return out.select("unit", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@register("C15_dedup_alerts_stream")
def c15s(spark, sf):
    from medlake.operators import clinical as cl
    bad = cl.lab_out_of_range(_vitals_stream(spark, sf)).where(F.col("ts") > F.lit("2024-01-25 00:00:00").cast(
        "timestamp")).withColumn("hour", F.date_trunc("hour", "ts"))
    out = sm.run_available_now(sm.dedup_alerts(bad, ["patient_key", "metric", "hour"]), "c15-stream")
    return out.select("patient_key", "metric", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"))


@register("C7_assessment_sessions_stream")
def c7s(spark, sf):
    a = _vitals_stream(spark, sf).where("metric = 'temperature'")
    out = sm.run_available_now(sm.assessment_sessions(a, "patient_key", "96 hours", "96 hours"), "c7-stream",
                               "complete", keys=["patient_key", "session_start"])
    return out.select("patient_key", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                      F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "n")


@register("Q7_ddm_stream")
def q7s(spark, sf):
    p = _pred_stream(spark, sf).withColumn("error", (F.col("p") >= 0.5) != (F.col("y") == 1))
    out = sm.run_available_now(sm.ddm_stream(p), "q7-stream")
    return out.select("model", "event_id", "level", "n_since_reset")


@register("Q8_adwin_stream")
def q8s(spark, sf):
    # a level shift on the 15th of the month makes the change points checkable
    p = _pred_stream(spark, sf).withColumn("x", F.col("p") + F.when(F.dayofmonth("ts") >= 15, 0.3).otherwise(0.0))
    out = sm.run_available_now(sm.adwin_stream(p, "x", delta=0.002), "q8-stream")
    return out.select("model", "event_id", "window_width", F.round("mean_before", 6).alias("mean_before"),
                      F.round("mean_after", 6).alias("mean_after"))


@register("S6_prediction_log_stream")
def s6s(spark, sf):
    from medlake.session import scratch_path
    log_path, metrics_path = scratch_path(spark, "s6-log"), scratch_path(spark, "s6-metrics")
    ckpt = scratch_path(spark, "s6-ckpt")
    q = (_pred_stream(spark, sf).writeStream.foreachBatch(sm.log_predictions(None, log_path, metrics_path))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    logged = spark.read.parquet(log_path)
    per_day = logged.groupBy("model", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    return per_day
