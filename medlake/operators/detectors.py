"""Sequential change detectors as batch jobs (Q7 DDM and EDDM with reset, Q8 ADWIN).

A detector's state restarts when it signals a drift, so the rows of a model depend
on each other in order.  None of the jobs here hands a model's rows to one task:

* DDM and EDDM up to their next drift are running sums and running extremes
  (``operators.ordered`` splits a heavy model into range buckets).  Resets are
  resolved in rounds: a round finds the next drift of every model that still has
  rows after its last one, and the next round goes on behind it.  There are as many
  rounds as the model with the most drifts has, plus one; models without a further
  drift are not read again.
* ADWIN works on mergeable summaries of time buckets (rows, sum, sum of squares, all
  exact whole numbers).  Summaries of a span are differences of prefix sums.  The
  window is cut at the ages 1, 2, 4, 8 ... buckets, the bounds of an exponential
  histogram, so a step tests few cuts.  The fold over a model's buckets sees one
  entry for each bucket of time, whatever the number of rows in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.operators.joins import bounded_broadcast
from medlake.operators.ordered import bucketed_lag, row_index, running_min, running_totals
from medlake.session import materialize

# fixed values: the published levels of EDDM
EDDM_WARNING, EDDM_DRIFT, EDDM_ERRORS = 0.95, 0.90, 30
#: Most models that still drift in one round (their last drifts are broadcast).
MAX_MODELS = 1_000_000


def _numbered(df: DataFrame, group: Sequence[str], ts: str, tiebreak: str, error: Column, heavy: dict) -> DataFrame:
    """(group, tiebreak, error 0/1, number of the row in its group); a NULL error is no error."""
    rows = df.select(*group, F.col(ts).alias("__ts"), F.col(tiebreak).alias("__id"),
                     F.coalesce(error.cast("int"), F.lit(0)).cast("long").alias("__e"))
    rows = row_index(rows, ["__ts", "__id"], partition_cols=list(group), out="__at", **heavy)
    return materialize(rows.select(*group, "__id", "__e", "__at"), "detector-rows")


def _with_resets(rows: DataFrame, group: Sequence[str], scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All alarms of ``scan``, which is run again behind each drift.

    ``scan`` takes rows with ``__start`` (number of the last drift's row) and returns
    (group, __id, __at, n, level) of the rows that alarm as if no drift came before."""
    g, found = list(group), []
    now = rows.withColumn("__start", F.lit(0).cast("long"))
    while True:
        alarms = materialize(scan(now).select(*g, "__id", "__at", "n", "level"), "detector-alarms")
        drift = materialize(alarms.where("level = 'drift'").groupBy(*g).agg(F.min("__at").alias("__start")), "detector-drifts")
        some = bounded_broadcast(drift, MAX_MODELS)
        found.append(alarms.join(some, g, "left").where("__start is null or __at <= __start").select(*g, "__id", "level", "n"))
        if drift.isEmpty():
            return reduce(DataFrame.unionAll, found)
        now = rows.join(some, g).where("__at > __start")


def ddm_alarms(df: DataFrame, group: Sequence[str], ts: str, tiebreak: str, error: Column, min_samples: int = 30,
               warning_level: float = 2.0, drift_level: float = 3.0, **heavy) -> DataFrame:
    """Q7 DDM: every warning and drift, with a reset after each drift.

    With p_i the error rate over the n rows since the reset and s_i its deviation, the
    row alarms when p_i + s_i exceeds p_min + ``level`` s_min, the values of the least
    p + s so far (from ``min_samples`` rows on).  Returns (group, tiebreak, level,
    n_since_reset)."""
    g = list(group)

    def scan(rows: DataFrame) -> DataFrame:
        r = running_totals(rows, ["__at"], ["__e"], partition_cols=g, with_totals=False, **heavy)
        n = F.col("__at") - F.col("__start")
        r = r.select(*g, "__id", "__at", n.alias("n"), (F.col("cum___e") / n).alias("p"))
        r = r.withColumn("s", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")))
        r = r.withColumn("v", F.when(F.col("n") >= min_samples, F.struct(
            (F.col("p") + F.col("s")).alias("v"), F.col("n").alias("n"), F.col("p").alias("p"), F.col("s").alias("s"))))
        r = running_min(r, ["__at"], ["v"], partition_cols=g, **heavy)
        over = F.col("p") + F.col("s")
        level = (F.when(over > F.col("min_v.p") + drift_level * F.col("min_v.s"), "drift")
                 .when(over > F.col("min_v.p") + warning_level * F.col("min_v.s"), "warning"))
        return r.where(F.col("n") >= min_samples).withColumn("level", level).where("level is not null")

    out = _with_resets(_numbered(df, g, ts, tiebreak, error, heavy), g, scan)
    return out.select(*g, F.col("__id").alias(tiebreak), "level", F.col("n").alias("n_since_reset"))


def eddm_alarms(df: DataFrame, group: Sequence[str], ts: str, tiebreak: str, error: Column, min_errors: int = EDDM_ERRORS,
                warning: float = EDDM_WARNING, drift: float = EDDM_DRIFT, **heavy) -> DataFrame:
    """Q7 EDDM: warnings and drifts by the distance between errors, with reset.

    Over the errors since the reset, m is the mean and s the (population) deviation of
    the distances between successive errors, the first one counted from the reset.
    From ``min_errors`` errors on, an error alarms when (m + 2 s) falls below
    ``warning`` / ``drift`` of its largest value so far.  Distances are whole numbers
    and their sums exact.  Returns (group, tiebreak, level, n_since_reset)."""
    g = list(group)

    def scan(rows: DataFrame) -> DataFrame:
        e = bucketed_lag(rows.where("__e = 1"), ["__at"], "__at", partition_cols=g, out="__last", **heavy)
        e = e.withColumn("__d", F.col("__at") - F.coalesce("__last", "__start"))
        e = e.withColumn("__dd", F.col("__d") * F.col("__d")).withColumn("__one", F.lit(1).cast("long"))
        e = running_totals(e, ["__at"], ["__dd", "__one"], partition_cols=g, with_totals=False, **heavy)
        k, n = F.col("cum___one"), F.col("__at") - F.col("__start")
        mean = n / k                     # the distances add up to the place
        spread = F.sqrt(F.greatest(F.col("cum___dd") / k - mean * mean, F.lit(0.0)))
        e = e.select(*g, "__id", "__at", n.alias("n"), k.alias("k"), (mean + 2.0 * spread).alias("v"))
        e = running_min(e.withColumn("low", F.when(F.col("k") >= min_errors, -F.col("v"))), ["__at"], ["low"],
                        partition_cols=g, **heavy)
        share = F.col("v") / -F.col("min_low")
        level = F.when(share < drift, "drift").when(share < warning, "warning")
        return e.where(F.col("k") >= min_errors).withColumn("level", level).where("level is not null")

    out = _with_resets(_numbered(df, g, ts, tiebreak, error, heavy), g, scan)
    return out.select(*g, F.col("__id").alias(tiebreak), "level", F.col("n").alias("n_since_reset"))


def bucket_summaries(df: DataFrame, group: Sequence[str], ts: str, value: Column, seconds: int, unit: float = 1e-6) -> DataFrame:
    """(group, bucket, n, s, q): mergeable summary of each bucket of time; values are
    whole multiples of ``unit``, so sums are exact.  NULL values and times are left out."""
    x = F.round(value.cast("double") / unit).cast("decimal(19,0)")
    rows = df.select(*group, F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)).alias("bucket"), x.alias("x"))
    return rows.where("x is not null and bucket is not null").groupBy(*group, "bucket").agg(
        F.count("*").alias("n"), F.sum("x").cast("decimal(38,0)").alias("s"),
        F.sum((F.col("x") * F.col("x")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("q"))


def adwin_changes(df: DataFrame, group: Sequence[str], ts: str, value: Column, seconds: int = 3600, delta: float = 0.002,
                  min_rows: int = 5, unit: float = 1e-6, **heavy) -> DataFrame:
    """Q8 ADWIN over buckets of ``seconds``: every change of the mean of ``value``.

    After each bucket the window (the buckets since the last cut) is split at the ages
    of 1, 2, 4 ... buckets.  A split with ``min_rows`` rows on both sides is a change
    if the means differ by more than eps = sqrt(2/m v ln(2 ln(n)/delta)) +
    2/(3m) ln(2 ln(n)/delta), with n rows of variance v in the window and 1/m = 1/n0 +
    1/n1.  The latest such split becomes the window's start.  Returns (group, bucket,
    cut, n_before, n_after, mean_before, mean_after); bucket and cut are numbers of
    spans of ``seconds`` since 1970, ``cut`` the first one kept."""
    g = list(group)
    span = running_totals(bucket_summaries(df, g, ts, value, seconds, unit), ["bucket"], ["n", "s", "q"], partition_cols=g,
                          with_totals=False, **heavy)
    entry = F.struct("bucket", F.col("cum_n").cast("long").alias("n"), F.col("cum_s").cast("decimal(38,0)").alias("s"),
                     F.col("cum_q").cast("decimal(38,0)").alias("q"))
    # one entry a bucket of time, the first one empty
    zero = "struct(bigint(null) as bucket, 0L as n, cast(0 as decimal(38,0)) as s, cast(0 as decimal(38,0)) as q)"
    paths = span.groupBy(*g).agg(F.sort_array(F.collect_list(entry)).alias("a")).withColumn("a", F.concat(F.array(F.expr(zero)), "a"))

    def between(lo: Column, hi: Column, what: str) -> Column:
        return (hi[what] - lo[what]).cast("double")

    def differs(lo: Column, mid: Column, hi: Column) -> Column:
        n0, n1, n = between(lo, mid, "n"), between(mid, hi, "n"), between(lo, hi, "n")
        total = between(lo, hi, "s")
        variance = (between(lo, hi, "q") - total * total / n) / n * F.lit(unit * unit)
        inverse = 1.0 / n0 + 1.0 / n1
        log = F.log(2.0 * F.log(n) / delta)
        eps = F.sqrt(2.0 * inverse * F.greatest(variance, F.lit(0.0)) * log) + 2.0 / 3.0 * inverse * log
        gap = F.abs(between(lo, mid, "s") / n0 - between(mid, hi, "s") / n1) * F.lit(unit)
        return (n0 >= min_rows) & (n1 >= min_rows) & (gap > eps)

    def step(state: Column, t: Column) -> Column:
        ages = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda j: t - F.call_function("shiftleft", F.lit(1), j))
        cuts = F.filter(ages, lambda c: (c > state["start"]) & differs(
            F.get("a", state["start"]), F.get("a", c), F.get("a", t)))
        cut = F.get(cuts, F.lit(0))     # ages rise, so the first one is the latest
        hit = F.struct(t.alias("t"), state["start"].alias("start"), cut.alias("cut"))
        return F.struct(F.coalesce(cut, state["start"]).alias("start"),
                        F.when(cut.isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(hit))).alias("found"))

    first = F.expr("struct(0 as start, cast(array() as array<struct<t:int,start:int,cut:int>>) as found)")
    hits = paths.select(*g, "a", F.explode(F.aggregate(F.sequence(F.lit(1), F.size("a") - 1), first, step, lambda s: s["found"])).alias("x"))
    lo, mid, hi = (F.get("a", F.col("x")[k]) for k in ("start", "cut", "t"))
    return hits.select(*g, hi["bucket"].alias("bucket"), F.get("a", F.col("x")["cut"] + 1)["bucket"].alias("cut"),
                       (mid["n"] - lo["n"]).alias("n_before"), (hi["n"] - mid["n"]).alias("n_after"),
                       (between(lo, mid, "s") / between(lo, mid, "n") * F.lit(unit)).alias("mean_before"),
                       (between(mid, hi, "s") / between(mid, hi, "n") * F.lit(unit)).alias("mean_after"))
