"""Model and system monitoring over logs (Q7-Q19).

Every monitor is an aggregate or an ordered scan over a log table; the
ordered ones use the bucketed helpers so a busy model or endpoint is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.operators.ordered import bucketed_lag, exact_quantiles_df, running_totals


def rolling_metric_alert(df: DataFrame, group: Sequence[str], ts: str, tiebreak: str, correct: Column,
                         window_rows: int = 1000, sensitivity: float = 0.15) -> DataFrame:
    """Q9: accuracy over the last ``window_rows`` predictions per group, and
    an alert when it falls ``sensitivity`` or more below the group's overall
    accuracy [ours].

    Rolling sums come from running totals: sum(i-W+1..i) = cum(i) - cum(i-W).
    ``cum(i-W)`` is fetched by an equi-join on (group, index - W), so no
    window holds a whole group.
    """
    g = list(group)
    s = df.select(*g, ts, tiebreak, correct.cast("int").alias("__ok")).withColumn("__one", F.lit(1))
    r = running_totals(s, [ts, tiebreak], ["__ok", "__one"], partition_cols=g)
    back = r.select(*g, (F.col("cum___one") + window_rows).alias("cum___one"),
                    F.col("cum___ok").alias("__ok_back"))
    j = r.join(back, [*g, "cum___one"], "left")
    n = F.least(F.col("cum___one"), F.lit(window_rows))
    rolling = (F.col("cum___ok") - F.coalesce(F.col("__ok_back"), F.lit(0))) / n
    base = F.col("total___ok") / F.col("total___one")
    return j.select(*g, ts, tiebreak, F.col("cum___one").alias("row_index"), rolling.alias("rolling_accuracy"),
                    base.alias("baseline_accuracy"),
                    (rolling <= base - F.lit(sensitivity)).alias("alert"))


def rolling_quality_alert(df: DataFrame, group: Sequence[str], ts: str, tiebreak: str, predicted: Column, actual: Column,
                          window_rows: int = 1000, sensitivity: float = 0.15) -> DataFrame:
    """Q9: precision and recall over the last ``window_rows`` predictions per group, the
    group's overall values and an alert for each that falls ``sensitivity`` or more below.

    A window without predicted (actual) positives has a NULL precision (recall) and no
    alert.  Counts come from running totals and one equi-join, as in
    ``rolling_metric_alert``: no window holds a whole group."""
    g = list(group)
    yes, true = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    sums = {"__hit": yes & true, "__yes": yes, "__true": true, "__one": F.lit(True)}
    s = df.select(*g, ts, tiebreak, *[c.cast("int").alias(k) for k, c in sums.items()])
    r = running_totals(s, [ts, tiebreak], list(sums), partition_cols=g)
    back = r.select(*g, (F.col("cum___one") + window_rows).alias("cum___one"),
                    *[F.col(f"cum_{k}").alias(f"__before{k}") for k in list(sums)[:3]])
    j = r.join(back, [*g, "cum___one"], "left")

    def share(part: str, whole: str) -> tuple[Column, Column]:
        def now(k: str) -> Column:
            return F.col(f"cum_{k}") - F.coalesce(F.col(f"__before{k}"), F.lit(0))
        return (F.when(now(whole) > 0, now(part) / now(whole)),
                F.when(F.col(f"total_{whole}") > 0, F.col(f"total_{part}") / F.col(f"total_{whole}")))

    out = [*g, ts, tiebreak, F.col("cum___one").alias("row_index")]
    for name, whole in (("precision", "__yes"), ("recall", "__true")):
        rolling, base = share("__hit", whole)
        out += [rolling.alias(f"rolling_{name}"), base.alias(f"baseline_{name}"),
                F.coalesce(rolling <= base - F.lit(sensitivity), F.lit(False)).alias(f"{name}_alert")]
    return j.select(*out)


def latency_percentiles(df: DataFrame, group: Sequence[str], latency: str, probs=(0.95, 0.99),
                        limits=(200.0, 500.0)) -> DataFrame:
    """Q10: exact latency percentiles per group and whether they break the limits."""
    q = exact_quantiles_df(df, latency, list(probs), group_cols=list(group))
    wide = q.groupBy(*group).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{int(p * 100)}")
                                   for p in probs])
    breach = F.lit(False)
    for p, lim in zip(probs, limits):
        breach = breach | (F.col(f"p{int(p * 100)}") > F.lit(lim))
    return wide.withColumn("breach", breach)


def distribution_check(df: DataFrame, group: Sequence[str], value: str, tolerance: float = 0.1) -> DataFrame:
    """Q11: population skewness and excess kurtosis per group; 'normal' when
    both are within the tolerance [ours]."""
    out = df.groupBy(*group).agg(F.skewness(value).alias("skewness"), F.kurtosis(value).alias("excess_kurtosis"))
    return out.withColumn("normal", (F.abs("skewness") <= tolerance) & (F.abs("excess_kurtosis") <= tolerance))


def resource_level(value: Column, warning: float = 0.85, alert: float = 0.90, critical: float = 0.95) -> Column:
    """Q12: level of one utilisation sample."""
    return (F.when(value >= critical, "critical").when(value >= alert, "alert").when(value >= warning, "warning")
            .otherwise("ok"))


def api_performance(log: DataFrame, endpoint: str, ts: str, latency: str, ok: Column, window: str = "1 hour",
                    latency_limit: float = 2000.0, availability_min: float = 0.999) -> DataFrame:
    """Q13: per endpoint and tumbling window: requests, throughput (per
    second), availability, error rate, exact p95 latency, SLA breach."""
    w = log.select(endpoint, F.window(F.col(ts).cast("timestamp"), window).start.alias("window_start"),
                   F.col(latency).alias("latency"), ok.alias("ok"))
    agg = w.groupBy(endpoint, "window_start").agg(F.count(F.lit(1)).alias("requests"),
                                                  F.avg(F.col("ok").cast("double")).alias("availability"))
    p95 = exact_quantiles_df(w, "latency", [0.95], group_cols=[endpoint, "window_start"]).select(
        endpoint, "window_start", F.col("q").alias("p95_latency"))
    seconds = _window_seconds(window)
    out = agg.join(p95, [endpoint, "window_start"], "left")
    return out.select(endpoint, "window_start", "requests", (F.col("requests") / F.lit(float(seconds))).alias(
        "throughput"), "availability", (1 - F.col("availability")).alias("error_rate"), "p95_latency",
        ((F.col("p95_latency") > latency_limit) | (F.col("availability") < availability_min)).alias("sla_breach"))


def _window_seconds(w: str) -> int:
    n, unit = w.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600, "day": 86400,
            "days": 86400}[unit]
    return int(n) * mult


# fixed values: error-log keywords
LOG_KEYWORDS = ["error", "exception", "critical"]


def log_keyword_counts(lines: DataFrame, text: str, keywords: Sequence[str] = LOG_KEYWORDS) -> DataFrame:
    """Q14: lines containing each keyword (any case)."""
    low = F.lower(F.col(text))
    hits = F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords]), lambda x: x.isNotNull())
    return lines.select(F.explode(hits).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_lines"))


def uptime(heartbeats: DataFrame, service: str, ts: str, sla: float = 0.9995) -> DataFrame:
    """Q15: per service, minutes with at least one heartbeat over the
    minutes spanned (first to last beat), and the SLA verdict."""
    m = heartbeats.select(service, F.date_trunc("minute", F.col(ts).cast("timestamp")).alias("minute"))
    agg = m.groupBy(service).agg(F.count_distinct("minute").alias("up_minutes"), F.min("minute").alias("first"),
                                 F.max("minute").alias("last"))
    expected = (F.unix_timestamp("last") - F.unix_timestamp("first")) / 60 + 1
    return agg.select(service, "up_minutes", expected.cast("long").alias("expected_minutes"),
                      (F.col("up_minutes") / expected).alias("uptime")).withColumn("sla_met", F.col("uptime") >= sla)


def outages(heartbeats: DataFrame, service: str, ts: str, min_gap_minutes: int = 2) -> DataFrame:
    """Q15: outage intervals = gaps between consecutive heartbeat minutes
    (gaps-and-islands via the bucketed lag)."""
    m = heartbeats.select(service, F.date_trunc("minute", F.col(ts).cast("timestamp")).alias("minute")).distinct()
    g = bucketed_lag(m, ["minute"], "minute", partition_cols=[service], out="prev_minute")
    gap = (F.unix_timestamp("minute") - F.unix_timestamp("prev_minute")) / 60
    return g.where(gap >= min_gap_minutes).select(service, F.col("prev_minute").alias("last_up"),
                                                  F.col("minute").alias("back_up"),
                                                  (gap - 1).cast("long").alias("down_minutes"))


def should_retrain(trend: DataFrame, group: Sequence[str], last_trained: DataFrame, as_of: str,
                   schedule_days: int = 30, trigger: bool = False) -> DataFrame:
    """Q16: retrain when triggered, when drift is increasing, or when the
    schedule is due (days since the last training >= ``schedule_days``)."""
    j = trend.join(last_trained, list(group), "left")
    due = F.datediff(F.lit(as_of).cast("date"), F.col("trained_at").cast("date")) >= schedule_days
    return j.select(*group, F.lit(trigger).alias("triggered"), (F.col("trend") == "increasing").alias("decaying"),
                    F.coalesce(due, F.lit(True)).alias("scheduled")).withColumn(
        "retrain", F.col("triggered") | F.col("decaying") | F.col("scheduled"))


def poisoning_suspects(metrics: DataFrame, accuracy: str = "accuracy", limit: float = 0.85) -> DataFrame:
    """Q17: metric rows with accuracy strictly below the limit."""
    return metrics.where(F.col(accuracy) < limit)


def unregistered_versions(deployed: DataFrame, registry: DataFrame, key: str = "model_id") -> DataFrame:
    """Q18: deployed versions absent from the registry (``left_anti``)."""
    return deployed.join(registry.select(key), key, "left_anti")


def latest_performance(metrics: DataFrame, group: Sequence[str], ts: str, limits: dict[str, tuple[str, float]]
                       ) -> DataFrame:
    """Q19: the latest value of each metric per model (``max_by``) and the
    names of the limits it breaks (``{metric: ('<' | '>', limit)}``)."""
    cols = list(limits)
    latest = metrics.groupBy(*group).agg(*[F.max_by(c, F.col(ts)).alias(c) for c in cols],
                                         F.max(ts).alias("as_of"))
    broken = F.filter(F.array(*[F.when(F.expr(f"`{c}` {op} {v}"), F.lit(c)) for c, (op, v) in limits.items()]),
                      lambda x: x.isNotNull())
    return latest.withColumn("breaches", broken)


def ddm_first_drift(df: DataFrame, group: Sequence[str], ts: str, tiebreak: str, error: Column,
                    min_samples: int = 30, warning_level: float = 2.0, drift_level: float = 3.0) -> DataFrame:
    """Q7 DDM (batch, up to the first drift): p_i = errors_i / i,
    s_i = sqrt(p_i (1 - p_i) / i); after ``min_samples`` rows track the
    minimum of p + s (with its s); warning / drift when p_i + s_i reaches
    p_min + 2 s_min / p_min + 3 s_min (strictly).  Returns the first warning and first
    drift row index per group.  Running sums and the running arg-min use
    the bucketed helpers (associative), so no group is a single task; the
    reset after a drift needs state -- see ``medlake.streaming``."""
    from medlake.operators.ordered import running_min
    g = list(group)
    s = df.select(*g, ts, tiebreak, error.cast("double").alias("__e")).withColumn("__one", F.lit(1))
    r = running_totals(s, [ts, tiebreak], ["__e", "__one"], partition_cols=g, with_totals=False)
    n = F.col("cum___one").cast("double")
    p = F.col("cum___e") / n
    sd = F.sqrt(p * (1 - p) / n)
    r = r.withColumn("p", p).withColumn("s", sd).withColumn(
        "ps", F.when(F.col("cum___one") >= min_samples, F.struct((F.col("p") + F.col("s")).alias("v"),
                                                                   F.col("s").alias("s"))))
    m = running_min(r, [ts, tiebreak], ["ps"], partition_cols=g)
    lvl = F.col("p") + F.col("s")
    pm, sm = F.col("min_ps.v") - F.col("min_ps.s"), F.col("min_ps.s")
    ok = F.col("cum___one") >= min_samples
    # strict: a zero-variance start (no errors yet) must not alarm
    m = m.withColumn("warn", ok & (lvl > pm + warning_level * sm)).withColumn("drift", ok & (lvl > pm + drift_level * sm))
    return m.groupBy(*g).agg(F.min(F.when(F.col("warn"), F.col("cum___one"))).alias("first_warning"),
                             F.min(F.when(F.col("drift"), F.col("cum___one"))).alias("first_drift"),
                             F.max("cum___one").alias("n"))


def page_hinkley_first_drift(df: DataFrame, group: Sequence[str], ts: str, tiebreak: str, value: Column,
                             delta: float = 0.005, threshold: float = 50.0) -> DataFrame:
    """Q7 Page-Hinkley (batch, up to the first alarm): with the running mean
    mu_i, m_t = sum_{i<=t} (x_i - mu_i - delta); alarm when
    m_t - min_{i<=t} m_i > threshold.  Two bucketed running sums and one
    bucketed running min."""
    from medlake.operators.ordered import running_min
    g = list(group)
    s = df.select(*g, ts, tiebreak, value.cast("double").alias("__x")).withColumn("__one", F.lit(1))
    r = running_totals(s, [ts, tiebreak], ["__x", "__one"], partition_cols=g, with_totals=False)
    r = r.withColumn("__d", F.col("__x") - F.col("cum___x") / F.col("cum___one") - F.lit(delta))
    r = running_totals(r.select(*g, ts, tiebreak, "cum___one", "__d"), [ts, tiebreak], ["__d"], partition_cols=g,
                       with_totals=False)
    r = running_min(r, [ts, tiebreak], ["cum___d"], partition_cols=g)
    alarm = (F.col("cum___d") - F.col("min_cum___d")) > threshold
    return r.groupBy(*g).agg(F.min(F.when(alarm, F.col("cum___one"))).alias("first_alarm"),
                             F.max("cum___one").alias("n"))


# fixed values: per-resource utilisation limits
RESOURCE_LIMITS = {"cpu": 0.8, "memory": 0.75, "gpu": 0.9}


def resource_breach(metric: Column, value: Column, limits: dict[str, float] | None = None) -> Column:
    """Q12: sample above its resource's limit (unknown resource -> NULL)."""
    lim = limits or RESOURCE_LIMITS
    m = F.create_map(*[x for k, v in lim.items() for x in (F.lit(k), F.lit(v))])
    return value > m[metric]
