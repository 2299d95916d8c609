"""Registered queries for the clinical monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.operators import clinical as cl
from medlake.plans.catalog import register
from medlake.sources.derived import derived
from medlake.sources.tables import table


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _vitals(spark, sf):
    return derived(spark, sf, "vitals")


def _fmt(c, pattern="yyyy-MM-dd HH:mm:ss"):
    return F.date_format(F.col(c), pattern)


@register("C1_latest_vitals")
def c1(spark, sf):
    v = cl.latest_values(_vitals(spark, sf), ["patient_key", "metric"], "ts", "value", "event_id")
    return v.select("patient_key", "metric", r6("latest_value").alias("latest_value"),
                    _fmt("latest_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest_ts"))


@register("C1_vital_zscores")
def c1z(spark, sf):
    z = cl.trailing_zscores(_vitals(spark, sf), ["patient_key", "metric"], "ts", "event_id", "value", n=5, z_limit=2.0)
    return z.select("patient_key", "metric", "event_id", F.round("z", 4).alias("z"), "anomaly")


@register("C2_lab_out_of_range_24h")
def c2(spark, sf):
    bad = cl.lab_out_of_range(_vitals(spark, sf))
    w = cl.sliding_counts(bad, ["patient_key", "metric"], "ts", "24 hours", "1 hour")
    return w.select("patient_key", "metric", _fmt("window_start").alias("window_start"), "n")


def _doses(spark, sf):
    return derived(spark, sf, "meds")


@register("C3_missed_dose_runs")
def c3(spark, sf):
    m = cl.missed_dose_runs(_doses(spark, sf), ["patient_id", "drug"], "ts", max_missed=2)
    return m.select("patient_id", "drug", F.date_format("last_taken", "yyyy-MM-dd").alias("last_taken"),
                    F.date_format("next_taken", "yyyy-MM-dd").alias("next_taken"), "missed_days")


@register("C3_overuse")
def c3b(spark, sf):
    o = cl.overuse(_doses(spark, sf), ["patient_id", "drug"], "ts", "qty", F.lit(25.0), 0.2)
    return o.select("patient_id", "drug", F.date_format("day", "yyyy-MM-dd").alias("day"), r6("taken").alias("taken"))


@register("C4_progression")
def c4(spark, sf):
    p = cl.progression(_vitals(spark, sf), ["patient_key", "metric"], "ts", "value", "event_id")
    return p.select("patient_key", "metric", F.round("slope_per_day", 4).alias("slope_per_day"),
                    r6("change").alias("change"), "n")


@register("C5_safety_events_daily")
def c5(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").selectExpr("cast(user_id % 10 AS int) AS unit", "ts")
    t = cl.tumbling_counts(e, ["unit"], "ts", "1 day")
    return t.select("unit", _fmt("window_start").alias("window_start"), "n")


@register("C6_sepsis_screen")
def c6(spark, sf):
    s = cl.sepsis_screen(_vitals(spark, sf), "patient_key", "metric", "ts", "value", "event_id", threshold=2)
    return s.select("patient_key", r6("heart_rate").alias("heart_rate"), r6("resp_rate").alias("resp_rate"),
                    r6("temperature").alias("temperature"), "sirs_score", "alert")


@register("C7_assessment_gaps")
def c7(spark, sf):
    a = _vitals(spark, sf).where("metric = 'temperature'")
    g = cl.assessment_gaps(a, "patient_key", "ts", "2024-01-31 00:00:00", max_gap_hours=96.0)
    return g.select("patient_key", _fmt("gap_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("gap_start"),
                    _fmt("gap_end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("gap_end"), "open")


@register("C8_overdue_followup")
def c8(spark, sf):
    v = _vitals(spark, sf)
    return cl.overdue_followup(v, v.where("metric = 'spo2'"), "patient_key", "ts", "2024-01-31 00:00:00", "10 days")


@register("C9_must_score")
def c9(spark, sf):
    c = derived(spark, sf, "clinical")
    return c.select("patient_id", cl.must_score(F.col("bmi"), F.col("weight_loss_pct"), F.col("acute_illness"))
                    .alias("must_score"))


@register("C10_infection_surveillance")
def c10(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").selectExpr(
        "CASE event_id % 3 WHEN 0 THEN 'mrsa' WHEN 1 THEN 'cdiff' ELSE 'vre' END AS pathogen",
        "cast(user_id % 5 AS int) AS ward", "date_trunc('week', ts) AS week")
    counts = e.groupBy("pathogen", "ward", "week").agg(F.count(F.lit(1)).alias("n"))
    a = cl.surveillance_alarm(counts, ["pathogen", "ward"], "week", "n", history=2, sigmas=1.0)
    return a.select("pathogen", "ward", F.date_format("week", "yyyy-MM-dd").alias("week"), "n",
                    r6("baseline_mean").alias("baseline_mean"), r6("baseline_std").alias("baseline_std"), "alarm")


def _stays(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS patient", "o_orderdate AS admit",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate + make_interval(0, 0, 0, cast(o_orderkey % 10 AS int)) END "
        "AS discharge")


@register("C11_census")
def c11(spark, sf):
    return cl.census(_stays(spark, sf), "patient", "admit", "discharge", "1996-06-15 00:00:00")


@register("C12_cohort_stats")
def c12(spark, sf):
    m = derived(spark, sf, "medical").withColumn("cohort", F.when(F.month("exam_date") <= 6, "h1").otherwise("h2"))
    s = cl.cohort_stats(m.where(F.col("exam_date") >= F.lit("2024-01-01").cast("date")), ["cohort", "sex"], "weight_kg")
    return s.select("cohort", "sex", "n", r6("mean").alias("mean"), r6("std").alias("std"), r6("median").alias("median"))


def _interaction_pairs(spark, sf):
    p = table(spark, sf, "part").where("p_size <= 3").selectExpr(
        "printf('D%02d', p_partkey % 50) AS a", "printf('D%02d', (p_partkey * 7) % 50) AS b")
    return p.where("a < b").select(F.col("a").alias("drug_a"), F.col("b").alias("drug_b")).distinct()


@register("C13_drug_interactions")
def c13(spark, sf):
    return cl.drug_interactions(_doses(spark, sf), _interaction_pairs(spark, sf))


@register("C14_guideline_gaps")
def c14(spark, sf):
    c = derived(spark, sf, "clinical")
    problems = c.where("diabetes").select("patient_id", F.lit("diabetes").alias("problem")).unionByName(
        c.where("hypertension").select("patient_id", F.lit("hypertension").alias("problem")))
    rules = spark.createDataFrame([("diabetes", "glucose", 10), ("hypertension", "heart_rate", 5)],
                                  "problem string, lab string, max_age_days int")
    labs = _vitals(spark, sf).select(F.format_string("P%03d", "patient_key").alias("patient_id"),
                                     F.col("metric").alias("lab"), "ts")
    return cl.guideline_gaps(problems, rules, labs, "patient_id", "ts", "2024-01-31 00:00:00").select(
        "patient_id", "problem", "lab")


@register("C15_new_alerts")
def c15(spark, sf):
    bad = cl.lab_out_of_range(_vitals(spark, sf)).withColumn("hour", F.date_trunc("hour", F.col("ts")))
    a = cl.new_alerts(bad, "ts", "2024-01-25 00:00:00", ["patient_key", "metric", "hour"])
    return a.select("patient_key", "metric", _fmt("hour").alias("hour"),
                    _fmt("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"), "total_new")


@register("C16_patient_timeline")
def c16(spark, sf):
    t = cl.patient_timeline(_vitals(spark, sf), "patient_key", "ts", "event_id")
    return t.select("patient_key", "event_id", "seq")


@register("C16_treatment_options")
def c16b(spark, sf):
    c = derived(spark, sf, "clinical")
    dx = (c.where("diabetes").select("patient_id", F.lit("diabetes").alias("diagnosis"))
          .unionByName(c.where("hypertension").select("patient_id", F.lit("hypertension").alias("diagnosis")))
          .unionByName(c.where("egfr < 30").select("patient_id", F.lit("ckd").alias("diagnosis"))))
    tx = spark.createDataFrame([("diabetes", "metformin"), ("diabetes", "sglt2"), ("hypertension", "ace_inhibitor"),
                                ("hypertension", "thiazide")], "diagnosis string, treatment string")
    ci = spark.createDataFrame([("ckd", "metformin"), ("diabetes", "thiazide")], "comorbidity string, treatment string")
    return cl.treatment_options(dx, tx, ci)


@register("C17_risk_stratification")
def c17(spark, sf):
    c = derived(spark, sf, "clinical")
    cat = F.when(F.col("p") >= 0.7, "high").when(F.col("p") >= 0.4, "medium").otherwise("low")
    d = c.select(F.concat(F.col("sex"), F.lit("_"), F.when(F.col("age") >= 60, "60+").otherwise("<60")).alias("cohort"),
                 cat.alias("category"))
    return cl.stratification(d, "cohort", "category", ["low", "medium", "high"])


@register("C12_cohort_cube")
def c12c(spark, sf):
    m = derived(spark, sf, "medical").withColumn("cohort", F.when(F.month("exam_date") <= 6, "h1").otherwise("h2"))
    c = cl.cohort_cube(m, ["cohort", "sex"], "weight_kg")
    return c.select("cohort", "sex", "n", r6("mean").alias("mean"), F.col("grouping_id").cast("int").alias("grouping_id"))
