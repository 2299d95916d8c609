"""Registered queries for evaluation (E), drift and monitoring (Q) and the
model registry (G), over the derived prediction log and landed tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlake.operators import detectors, drift, metrics, monitor, registry
from medlake.plans.catalog import register
from medlake.sources.derived import derived
from medlake.sources.tables import table

G = ["model"]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _pred(spark, sf):
    return derived(spark, sf, "predictions")


# ---------------------------------------------------------------- E
@register("E1_classification_metrics")
def e1(spark, sf):
    m = metrics.classification_metrics(_pred(spark, sf), "p", "y", G)
    return m.select("model", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("E2_roc_auc")
def e2(spark, sf):
    a = metrics.roc_auc(_pred(spark, sf), "p", "y", G)
    return a.select("model", r6("auc").alias("auc"), "n_pos", "n_neg")


@register("E3_precision_recall_curve")
def e3(spark, sf):
    p = metrics.precision_recall_curve(_pred(spark, sf), "p", "y", G)
    return p.select("model", "threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@register("E4_confusion_matrix")
def e4(spark, sf):
    return metrics.confusion_matrix(_pred(spark, sf), "p", "y", G, 0.5)


@register("E5_average_precision")
def e5(spark, sf):
    return metrics.average_precision(_pred(spark, sf), "p", "y", G).withColumn("ap", r6("ap"))


@register("E6_brier_score")
def e6(spark, sf):
    return metrics.brier(_pred(spark, sf), "p", "y", G).withColumn("brier", r6("brier"))


@register("E7_threshold_sweep")
def e7(spark, sf):
    s = metrics.threshold_sweep(_pred(spark, sf), "p", "y", G)
    return s.select("model", r6("threshold").alias("threshold"), *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@register("E8_youden_threshold")
def e8(spark, sf):
    y = metrics.youden_threshold(_pred(spark, sf), "p", "y", G)
    return y.select("model", "threshold", r6("youden_j").alias("youden_j"))


@register("E9_calibration_error")
def e9(spark, sf):
    return metrics.calibration_error(_pred(spark, sf), "p", "y", G).withColumn("ece", r6("ece"))


_REPORT_COLS = ("auc", "ap", "brier", "ece", "best_threshold", "accuracy", "precision", "recall", "f1")


@register("E10_evaluation_report")
def e10(spark, sf):
    r = metrics.evaluation_report(_pred(spark, sf), "p", "y", G)
    return r.select("model", *[r6(c).alias(c) for c in _REPORT_COLS])


@register("E11_leaderboard")
def e11(spark, sf):
    r = metrics.evaluation_report(_pred(spark, sf), "p", "y", G)
    lb = metrics.leaderboard(r.select("model", r6("f1").alias("f1"), r6("auc").alias("auc")), by="f1")
    return lb


@register("E12_metrics_text")
def e12(spark, sf):
    r = metrics.classification_metrics(_pred(spark, sf), "p", "y", G)
    return metrics.metrics_text(r, ["accuracy", "precision", "recall", "f1"])


# ---------------------------------------------------------------- Q drift
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CAT = ["l_returnflag", "l_linestatus"]


def _ref_cur(spark, sf):
    # range predicates on the date column reach the scan; the windows adjoin
    li, cut = table(spark, sf, "lineitem"), F.lit("1998-01-01").cast(T.DateType())
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


@register("Q1_ks_drift")
def q1(spark, sf):
    ref, cur = _ref_cur(spark, sf)
    k = drift.ks_drift(ref, cur, _NUM)
    return k.select("feature", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"), "drift",
                    "n_ref", "n_cur")


@register("Q1_chi2_statistics")
def q1b(spark, sf):
    ref, cur = _ref_cur(spark, sf)
    return drift.chi2_statistics(ref, cur, _CAT).withColumn("statistic", r6("statistic"))


@register("Q2_drift_table")
def q2(spark, sf):
    ref, cur = _ref_cur(spark, sf)
    t = drift.drift_table(ref, cur, _NUM, _CAT)
    return t.select("feature", "test", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"), "drift",
                    r6("drifted_share").alias("drifted_share"), "dataset_drift")


@register("Q3_dataset_summary")
def q3(spark, sf):
    return drift.dataset_summary(table(spark, sf, "lineitem"))


@register("Q4_drift_trend")
def q4(spark, sf):
    t = drift.drift_trend(_pred(spark, sf), G, "ts", "event_id", "p")
    return t.select("model", r6("mean_score").alias("mean_score"), r6("max_score").alias("max_score"),
                    F.round(F.col("slope") * 1e6, 6).alias("slope_e6"), "trend")


@register("Q5_performance_report")
def q5(spark, sf):
    p = _pred(spark, sf)
    span = p.groupBy("model").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
                                  F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))
    parts = [span, metrics.roc_auc(p, "p", "y", G).select("model", "auc"), metrics.brier(p, "p", "y", G),
             metrics.calibration_error(p, "p", "y", G),
             drift.drift_trend(p, G, "ts", "event_id", "p").select("model", "trend")]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(x, "model")
    return out.select("model", "first_ts", "last_ts", r6("auc").alias("auc"), r6("brier").alias("brier"),
                      r6("ece").alias("ece"), "trend")


@register("Q6_psi")
def q6(spark, sf):
    ref, cur = _ref_cur(spark, sf)
    return drift.psi(ref, cur, "l_extendedprice").withColumn("psi", r6("psi"))


# ---------------------------------------------------------------- Q monitors
@register("Q9_rolling_accuracy_alerts")
def q9(spark, sf):
    p = _pred(spark, sf)
    correct = (F.col("p") >= 0.5) == (F.col("y") == 1)
    r = monitor.rolling_metric_alert(p, G, "ts", "event_id", correct, window_rows=1000, sensitivity=0.15)
    return r.select("model", "event_id", "row_index", r6("rolling_accuracy").alias("rolling_accuracy"), "alert")


@register("Q9_rolling_precision_recall")
def q9b(spark, sf):
    r = monitor.rolling_quality_alert(_pred(spark, sf), G, "ts", "event_id", F.col("p") >= 0.5, F.col("y") == 1,
                                      window_rows=200, sensitivity=0.15)
    return r.select("model", "event_id", "row_index", r6("rolling_precision").alias("rolling_precision"), "precision_alert",
                    r6("rolling_recall").alias("rolling_recall"), "recall_alert")


@register("Q10_latency_percentiles")
def q10(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    q = monitor.latency_percentiles(e, ["event_type", "day"], "value", (0.95, 0.99), (300.0, 400.0))
    return q.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), r6("p95").alias("p95"),
                    r6("p99").alias("p99"), "breach")


@register("Q11_prediction_distribution")
def q11(spark, sf):
    d = monitor.distribution_check(_pred(spark, sf), G, "p", 0.1)
    return d.select("model", r6("skewness").alias("skewness"), r6("excess_kurtosis").alias("excess_kurtosis"), "normal")


@register("Q12_resource_levels")
def q12(spark, sf):
    e = table(spark, sf, "events")
    lvl = monitor.resource_level(F.col("value") / 400.0)
    return e.groupBy("event_type", lvl.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@register("Q13_api_performance")
def q13(spark, sf):
    e = table(spark, sf, "events")
    a = monitor.api_performance(e, "event_type", "ts", "value", F.col("value") < 300, "1 hour", 300.0, 0.999)
    return a.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "requests", r6("throughput").alias("throughput"), r6("availability").alias("availability"),
                    r6("error_rate").alias("error_rate"), r6("p95_latency").alias("p95_latency"), "sla_breach")


@register("Q14_log_keyword_counts")
def q14(spark, sf):
    d = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return monitor.log_keyword_counts(d, "line", ["token", "license", "mail", "error"])


@register("Q15_uptime")
def q15(spark, sf):
    u = monitor.uptime(table(spark, sf, "events"), "event_type", "ts", 0.9995)
    return u.select("event_type", "up_minutes", "expected_minutes", r6("uptime").alias("uptime"), "sla_met")


@register("Q15_outages")
def q15b(spark, sf):
    o = monitor.outages(table(spark, sf, "events"), "event_type", "ts", 120)
    return o.select("event_type", F.date_format("last_up", "yyyy-MM-dd HH:mm").alias("last_up"),
                    F.date_format("back_up", "yyyy-MM-dd HH:mm").alias("back_up"), "down_minutes")


@register("Q16_should_retrain")
def q16(spark, sf):
    p = _pred(spark, sf)
    trend = drift.drift_trend(p, G, "ts", "event_id", "p")
    trained = p.groupBy("model").agg(F.min("ts").alias("trained_at"))
    r = monitor.should_retrain(trend, G, trained, "2024-01-20", schedule_days=30)
    return r


def _daily_metrics(spark, sf):
    p = _pred(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return metrics.classification_metrics(p, "p", "y", ["model", "day"]).join(
        metrics.brier(p, "p", "y", ["model", "day"]), ["model", "day"])


@register("Q17_poisoning_suspects")
def q17(spark, sf):
    s = monitor.poisoning_suspects(_daily_metrics(spark, sf), "accuracy", 0.85)
    return s.select("model", "day", r6("accuracy").alias("accuracy"))


def _versions(spark, sf):
    p = _pred(spark, sf)
    return p.select(F.concat("model", F.lit("-w"), F.weekofyear("ts").cast("string")).alias("model_id"),
                    F.dayofmonth("ts").alias("dom"))


@register("Q18_unregistered_versions")
def q18(spark, sf):
    v = _versions(spark, sf)
    deployed = v.select("model_id").distinct()
    reg = v.where("dom <= 21").select("model_id").distinct()
    return monitor.unregistered_versions(deployed, reg)


@register("Q19_latest_performance")
def q19(spark, sf):
    m = _daily_metrics(spark, sf)
    lp = monitor.latest_performance(m, G, "day", {"accuracy": ("<", 0.55), "brier": (">", 0.3)})
    return lp.select("model", "as_of", r6("accuracy").alias("accuracy"), r6("brier").alias("brier"),
                     F.array_join("breaches", ",").alias("breaches"))


# ---------------------------------------------------------------- G registry
def _model_perf(spark, sf):
    p = _pred(spark, sf)
    return metrics.roc_auc(p, "p", "y", G).join(
        p.groupBy("model").agg(F.max("ts").alias("trained_at")), "model")


@register("G1_register_models")
def g1(spark, sf):
    reg = registry.register_models(spark, _model_perf(spark, sf), existing=None)
    return reg.select("id", "model", r6("performance").alias("performance"))


@register("G1_second_registration")
def g1b(spark, sf):
    from medlake.session import materialize, scratch_path
    perf, store = materialize(_model_perf(spark, sf), "g1-perf"), scratch_path(spark, "g1-registry")
    registry.register_in(spark, store, perf.where("model < 'purchase'"))
    return registry.register_in(spark, store, perf)


@register("G2_best_model")
def g2(spark, sf):
    reg = registry.register_models(spark, _model_perf(spark, sf), existing=None)
    b = registry.best_model(reg)
    return b.select("id", "model", r6("performance").alias("performance"))


@register("G3_audit_models")
def g3(spark, sf):
    reg = registry.register_models(spark, _model_perf(spark, sf), existing=None)
    a = registry.audit_models(reg, 0.92)
    return a.select("id", "model", r6("performance").alias("performance"))


@register("Q7_ddm_first_drift")
def q7(spark, sf):
    p = _pred(spark, sf)
    err = (F.col("p") >= 0.5) != (F.col("y") == 1)
    return monitor.ddm_first_drift(p, G, "ts", "event_id", err, min_samples=30)


def _wrong():
    return (F.col("p") >= 0.5) != (F.col("y") == 1)


@register("Q7_ddm_alarms")
def q7_ddm(spark, sf):
    return detectors.ddm_alarms(_pred(spark, sf), G, "ts", "event_id", _wrong())


@register("Q7_eddm_alarms")
def q7_eddm(spark, sf):
    return detectors.eddm_alarms(_pred(spark, sf), G, "ts", "event_id", _wrong())


@register("Q8_adwin_changes")
def q8(spark, sf):
    # level shifts on the 10th and the 20th make the change points checkable
    shift = F.when(F.dayofmonth("ts") >= 20, 0.2).when(F.dayofmonth("ts") >= 10, 0.3).otherwise(0.0)
    out = detectors.adwin_changes(_pred(spark, sf), G, "ts", F.col("p") + shift, seconds=3600)
    return out.select("model", "bucket", "cut", "n_before", "n_after", r6("mean_before").alias("mean_before"),
                      r6("mean_after").alias("mean_after"))


@register("Q7_page_hinkley_first_alarm")
def q7b(spark, sf):
    p = _pred(spark, sf)
    return monitor.page_hinkley_first_drift(p, G, "ts", "event_id", F.col("p"), delta=0.005, threshold=5.0)


@register("S7_report_json_roundtrip")
def s7(spark, sf):
    from medlake.session import scratch_path
    from medlake.sources import files
    r = metrics.evaluation_report(_pred(spark, sf), "p", "y", G).select("model", *[r6(c).alias(c) for c in _REPORT_COLS])
    path = scratch_path(spark, "s7-report")
    files.write_report(r, path)
    return spark.read.schema(r.schema).json(path)


@register("S8_export_tables")
def s8(spark, sf):
    import os
    from medlake.session import scratch_path
    from medlake.sources import files
    root = scratch_path(spark, "s8-export")
    tabs = {"predictions": _pred(spark, sf).select("event_id", "model", "p", "y"),
            "lineitem_flags": table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")}
    paths = files.export_tables(spark, tabs, ["predictions", "lineitem_flags"], "csv", root)
    out = None
    for name, pth in zip(["predictions", "lineitem_flags"], paths):
        n = spark.read.option("header", True).csv(pth).groupBy().count().select(F.lit(name).alias("table"),
                                                                                  F.col("count").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


@register("Q12_resource_breaches")
def q12b(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "CASE event_id % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'memory' ELSE 'gpu' END AS resource", "value / 400.0 AS util")
    b = monitor.resource_breach(F.col("resource"), F.col("util"))
    return e.groupBy("resource", b.alias("breach"), monitor.resource_level(F.col("util")).alias("level")).agg(
        F.count(F.lit(1)).alias("n"))
