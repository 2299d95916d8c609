"""Clinical monitors (C1-C17) in batch form.  The same functions take a
streaming DataFrame where noted (see ``medlake.streaming``).

Ordered per-patient logic (trailing windows, gaps, sequence numbers) is
built on the bucketed helpers: a patient with a third of all readings is
still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.operators.joins import bounded_broadcast
from medlake.operators.ordered import bucketed_lag, exact_quantiles_df, running_totals, trailing_window


def latest_values(readings: DataFrame, keys: Sequence[str], ts: str, value: str, tiebreak: str) -> DataFrame:
    """The latest value per key (``max_by`` on (ts, tiebreak)); a
    partial aggregate, so hot keys are combined map-side."""
    return readings.groupBy(*keys).agg(F.max_by(value, F.struct(ts, tiebreak)).alias("latest_value"),
                                       F.max(ts).alias("latest_ts"))


def trailing_zscores(readings: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, value: str, n: int = 5,
                     z_limit: float = 3.0, chunk_rows: int = 1_000_000) -> DataFrame:
    """Z-score of each reading against the previous ``n`` readings of
    the same key (population std); NULL until a previous reading exists.

    Uses ``trailing_window``: per-key row numbers from bucketed running
    counts and chunked windows with a halo, so a key holding most readings
    is still split into bounded tasks, and the std comes from Spark's
    stable aggregate (no difference of large running sums).
    """
    k = list(keys)
    aggs = {"trailing_mean": F.avg(value), "trailing_std": F.stddev_pop(value), "__cnt": F.count(value)}
    t = trailing_window(readings.select(*k, ts, tiebreak, value), k, [ts, tiebreak], n, aggs, chunk_rows=chunk_rows)
    z = F.when((F.col("__cnt") > 0) & (F.col("trailing_std") > 1e-12),
               (F.col(value) - F.col("trailing_mean")) / F.col("trailing_std"))
    return t.select(*k, ts, tiebreak, value, "trailing_mean", "trailing_std", z.alias("z"),
                    F.coalesce(F.abs(z) > z_limit, F.lit(False)).alias("anomaly"))


# fixed values: lab reference ranges (lab, low, high), closed
LAB_RANGES = [("glucose", 70.0, 200.0), ("potassium", 3.5, 5.2), ("creatinine", 0.6, 1.3)]


def lab_out_of_range(readings: DataFrame, lab: str = "metric", value: str = "value", ranges=LAB_RANGES) -> DataFrame:
    """Readings outside the closed reference range of their lab; the
    range table is a fixed 3-row literal applied as a broadcast join."""
    spark = readings.sparkSession
    rt = F.broadcast(spark.createDataFrame(ranges, f"{lab} string, low double, high double"))
    j = readings.join(rt, lab, "inner")
    return j.where(~F.col(value).between(F.col("low"), F.col("high")))


def sliding_counts(events: DataFrame, keys: Sequence[str], ts: str, length: str = "24 hours",
                   slide: str = "1 hour") -> DataFrame:
    """Events per key and sliding window (``window(ts, length, slide)``
    semantics: windows aligned to the epoch, start <= ts < start + length).

    Pre-aggregates to one count per (key, slide bucket) first and only then
    fans each bucket out to the length/slide windows that contain it -- the
    fan-out multiplies buckets, not raw events, and the shuffle carries
    partial counts."""
    from medlake.operators.monitor import _window_seconds
    ln, sl = _window_seconds(length), _window_seconds(slide)
    if ln % sl:
        w = F.window(F.col(ts).cast("timestamp"), length, slide)
        return events.groupBy(*keys, w.start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    secs = F.unix_seconds(F.col(ts).cast("timestamp"))
    bucket = (secs - F.pmod(secs, F.lit(sl))).alias("__b")
    per = events.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    fan = per.select(*keys, "__n", F.explode(F.sequence(F.lit(0), F.lit(ln // sl - 1))).alias("__k"),
                     F.col("__b"))
    start = F.timestamp_seconds(F.col("__b") - F.col("__k") * F.lit(sl))
    return fan.groupBy(*keys, start.alias("window_start")).agg(F.sum("__n").alias("n"))


def missed_dose_runs(doses: DataFrame, keys: Sequence[str], ts: str, max_missed: int = 2) -> DataFrame:
    """Runs of consecutive days without a dose longer than ``max_missed``
    between two dosing days (gaps-and-islands on distinct dosing days)."""
    d = doses.select(*keys, F.to_date(F.col(ts)).alias("day")).distinct()
    g = bucketed_lag(d, ["day"], "day", partition_cols=list(keys), out="prev_day")
    missed = F.datediff("day", "prev_day") - 1
    return g.where(missed > max_missed).select(*keys, F.col("prev_day").alias("last_taken"),
                                               F.col("day").alias("next_taken"), missed.alias("missed_days"))


def overuse(doses: DataFrame, keys: Sequence[str], ts: str, qty: str, prescribed: Column, margin: float = 0.2
            ) -> DataFrame:
    """Daily quantity above (1 + margin) x prescribed."""
    daily = doses.groupBy(*keys, F.to_date(F.col(ts)).alias("day")).agg(F.sum(qty).alias("taken"))
    return daily.where(F.col("taken") > (1 + margin) * prescribed)


def progression(readings: DataFrame, keys: Sequence[str], ts: str, value: str, tiebreak: str) -> DataFrame:
    """C4: per key, OLS slope of the value per day and last minus first value."""
    days = F.unix_micros(F.col(ts).cast("timestamp")).cast("double") / 86_400_000_000.0
    order = F.struct(F.col(ts), F.col(tiebreak))
    return readings.groupBy(*keys).agg(F.regr_slope(F.col(value), days).alias("slope_per_day"),
                                       (F.max_by(value, order) - F.min_by(value, order)).alias("change"),
                                       F.count(F.lit(1)).alias("n"))


def tumbling_counts(events: DataFrame, keys: Sequence[str], ts: str, length: str = "1 day") -> DataFrame:
    """Filtered events per key and tumbling window."""
    w = F.window(F.col(ts).cast("timestamp"), length)
    return events.groupBy(*keys, w.start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


# fixed values: SIRS-style criteria on the latest vitals (metric, predicate on v)
SIRS_CRITERIA = [("heart_rate", "v > 90"), ("resp_rate", "v > 20"), ("temperature", "v > 38 OR v < 36")]


def sepsis_screen(readings: DataFrame, patient: str, metric: str, ts: str, value: str, tiebreak: str,
                  criteria=SIRS_CRITERIA, threshold: int = 2) -> DataFrame:
    """Count of criteria met by each patient's latest value per metric;
    alert at ``threshold`` or more [ours: SIRS cut-offs]."""
    names = [m for m, _ in criteria]
    latest = latest_values(readings.where(F.col(metric).isin(names)), [patient, metric], ts, value, tiebreak)
    wide = latest.groupBy(patient).pivot(metric, names).agg(F.first("latest_value"))
    score = sum((F.coalesce(F.expr(pred.replace("v", f"`{m}`")), F.lit(False)).cast("int") for m, pred in criteria),
                F.lit(0))
    return wide.withColumn("sirs_score", score).withColumn("alert", F.col("sirs_score") >= threshold)


def assessment_gaps(assessments: DataFrame, patient: str, ts: str, as_of: str, max_gap_hours: float = 4.0
                    ) -> DataFrame:
    """Gaps longer than the interval between consecutive assessments,
    plus the open gap from the last assessment to ``as_of``."""
    a = assessments.select(patient, F.col(ts).cast("timestamp").alias("ts")).distinct()
    g = bucketed_lag(a, ["ts"], "ts", partition_cols=[patient], out="prev_ts")
    hours = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 3.6e9
    closed = g.where(hours > max_gap_hours).select(patient, F.col("prev_ts").alias("gap_start"),
                                                   F.col("ts").alias("gap_end"), F.lit(False).alias("open"))
    last = a.groupBy(patient).agg(F.max("ts").alias("gap_start"))
    asof = F.lit(as_of).cast("timestamp")
    open_ = last.where((F.unix_micros(asof) - F.unix_micros("gap_start")) / 3.6e9 > max_gap_hours).select(
        patient, "gap_start", asof.alias("gap_end"), F.lit(True).alias("open"))
    return closed.unionByName(open_)


def overdue_followup(patients: DataFrame, assessments: DataFrame, patient: str, ts: str, as_of: str,
                     lookback: str = "1 month") -> DataFrame:
    """Patients with no assessment within ``lookback`` before ``as_of``."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {lookback}")
    recent = assessments.where((F.col(ts).cast("timestamp") >= since) &
                               (F.col(ts).cast("timestamp") <= F.lit(as_of).cast("timestamp"))).select(patient)
    return patients.select(patient).distinct().join(recent.distinct(), patient, "left_anti")


def must_score(bmi: Column, weight_loss_pct: Column, acute: Column) -> Column:
    """Malnutrition Universal Screening Tool (BMI, weight
    loss, acute effect); a missing input gives NULL, not points."""
    b = F.when(bmi > 20, 0).when(bmi >= 18.5, 1).when(bmi < 18.5, 2)
    w = F.when(weight_loss_pct > 10, 2).when(weight_loss_pct >= 5, 1).when(weight_loss_pct < 5, 0)
    return b + w + F.when(acute, 2).when(~acute, 0)


def surveillance_alarm(counts: DataFrame, keys: Sequence[str], period: str, n: str = "n", history: int = 4,
                       sigmas: float = 2.0) -> DataFrame:
    """Alarm when a period's count exceeds the mean + sigmas * std of
    the previous ``history`` periods of the same key.  ``counts`` is already
    aggregated per (key, period): a small table, so a plain window is fine."""
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(-history, -1)
    m, s = F.avg(n).over(w), F.stddev_pop(n).over(w)
    return counts.withColumn("baseline_mean", m).withColumn("baseline_std", s).withColumn(
        "alarm", F.coalesce(F.col(n) > m + sigmas * s, F.lit(False)))


def census(stays: DataFrame, patient: str, admit: str, discharge: str, as_of: str) -> DataFrame:
    """C11: distinct patients admitted and not discharged at ``as_of``."""
    t = F.lit(as_of).cast("timestamp")
    cur = stays.where((F.col(admit).cast("timestamp") <= t) &
                      (F.col(discharge).isNull() | (F.col(discharge).cast("timestamp") > t)))
    return cur.agg(F.count_distinct(patient).alias("census"))


def cohort_stats(df: DataFrame, cohort: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample std and exact median per cohort."""
    g = list(cohort)
    stats = df.groupBy(*g).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                               F.stddev_samp(value).alias("std"))
    med = exact_quantiles_df(df, value, [0.5], group_cols=g).select(*g, F.col("q").alias("median"))
    return stats.join(med, g, "left")


def drug_interactions(meds: DataFrame, pairs: DataFrame, patient: str = "patient_id", drug: str = "drug"
                      ) -> DataFrame:
    """Interacting drug pairs a patient takes.

    Each (patient, drug) meets the interaction table on its first drug
    (the table is small and broadcast after a size proof), then is kept only
    if the patient also takes the partner drug (equi-join on (patient,
    partner)).  Only interacting pairs are ever produced -- never all pairs
    of a patient's drugs."""
    pd_ = meds.select(patient, drug).distinct()
    p = bounded_broadcast(pairs.select(F.col("drug_a"), F.col("drug_b")))
    cand = pd_.join(p, pd_[drug] == p["drug_a"]).select(patient, "drug_a", "drug_b")
    partner = pd_.select(F.col(patient).alias("__p"), F.col(drug).alias("__d"))
    hit = cand.join(partner, (cand[patient] == partner["__p"]) & (cand["drug_b"] == partner["__d"]), "left_semi")
    return hit


def guideline_gaps(problems: DataFrame, rules: DataFrame, labs: DataFrame, patient: str, ts: str, as_of: str
                   ) -> DataFrame:
    """C14: (patient, problem, required lab) where the lab is absent or
    older than the rule's ``max_age_days`` at ``as_of``."""
    need = problems.join(bounded_broadcast(rules), "problem")
    t = F.lit(as_of).cast("timestamp")
    recent = labs.select(patient, F.col("lab"), F.col(ts).cast("timestamp").alias("__ts"))
    cond = ((need[patient] == recent[patient]) & (need["lab"] == recent["lab"]) & (recent["__ts"] <= t) &
            (recent["__ts"] > t - F.make_interval(days=need["max_age_days"])))
    return need.join(recent, cond, "left_anti")


def new_alerts(alerts: DataFrame, ts: str, cursor: str, dedupe: Sequence[str]) -> DataFrame:
    """Alerts after the cursor, one per dedupe key (earliest kept), with the total."""
    a = alerts.where(F.col(ts).cast("timestamp") > F.lit(cursor).cast("timestamp"))
    first = a.groupBy(*dedupe).agg(F.min(ts).alias(ts))
    total = first.count()  # one number back to the driver
    return first.withColumn("total_new", F.lit(total).cast("long"))


def patient_timeline(events: DataFrame, patient: str, ts: str, tiebreak: str) -> DataFrame:
    """Every event with its sequence number in the patient's history
    (bucketed running count, no per-patient collect)."""
    e = events.withColumn("__one", F.lit(1))
    r = running_totals(e, [ts, tiebreak], ["__one"], partition_cols=[patient], with_totals=False)
    return r.withColumnRenamed("cum___one", "seq").drop("__one")


def treatment_options(diagnoses: DataFrame, treatments: DataFrame, contraindications: DataFrame,
                      patient: str = "patient_id") -> DataFrame:
    """Treatments for each patient's diagnoses minus those
    contraindicated by a comorbidity the patient has."""
    opts = diagnoses.join(bounded_broadcast(treatments), "diagnosis")
    bad = diagnoses.select(patient, F.col("diagnosis").alias("comorbidity")).join(
        bounded_broadcast(contraindications), "comorbidity").select(patient, "treatment")
    return opts.join(bad, [patient, "treatment"], "left_anti")


def stratification(df: DataFrame, cohort: str, category: str, categories: Sequence[str]) -> DataFrame:
    """C17: cohort x risk-category counts (categories fixed, so the pivot
    needs no extra distinct pass)."""
    return df.groupBy(cohort).pivot(category, list(categories)).count().fillna(0)


def cohort_cube(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """C12 extra: counts and means for every combination of the cohort
    dimensions (``cube``; NULL marks 'all'), with the grouping id."""
    return df.cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                              F.grouping_id().alias("grouping_id"))
