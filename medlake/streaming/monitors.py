"""Structured Streaming forms of the monitors.

The windowed monitors reuse the batch column logic on a streaming
DataFrame with an event-time watermark (late rows beyond it are dropped by
Spark and do not reopen closed windows).  The sequential detectors (DDM
with reset, ADWIN) keep bounded per-key state with
``applyInPandasWithState``: each micro-batch hands a key only its new
rows, so neither memory nor a task grows with the history.  Of a micro-batch a
task holds three numbers a row (to put them in order) and emits in parts.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from medlake.operators import clinical as cl
from medlake.session import ensure_checkpoint_dir, scratch_path


# ---------------------------------------------------------------- sources / runner

def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A parquet table of the landing folder as a stream (schema taken from
    the batch footer, no inference); ``TIMESTAMP_NTZ`` columns are cast to
    ``TIMESTAMP`` so watermarks accept them."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    r = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.load(sf_dir)
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def run_available_now(df: DataFrame, name: str, output_mode: str = "append", keys: Sequence[str] | None = None,
                      sink_format: str = "parquet") -> DataFrame:
    """Run a streaming query over everything available and return its
    result as a batch DataFrame; offsets/state live in a checkpoint in the
    shared folder, so a restart resumes exactly-once.

    * ``append``: file sink; only finalized rows (e.g. windows the
      watermark has passed) are written.
    * ``update``: every micro-batch's changed rows go through
      ``foreachBatch`` to an epoch-partitioned table; the result keeps the
      latest version of each ``keys`` row (open windows included).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    if output_mode == "append":
        q = (df.writeStream.format(sink_format).option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def sink(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch: a replayed epoch replaces its first attempt
        batch.write.mode("overwrite").parquet(f"{out}/_epoch={epoch}")

    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).outputMode(output_mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.schema(df.schema.add("_epoch", "long")).parquet(out)
    if not keys:
        return res.drop("_epoch")
    latest = res.groupBy(*keys).agg(F.max("_epoch").alias("_epoch"))
    return res.join(latest, [*keys, "_epoch"], "left_semi").drop("_epoch")


# ---------------------------------------------------------------- windowed monitors

def lab_alert_counts(readings: DataFrame, watermark: str = "2 hours", length: str = "24 hours",
                     slide: str = "1 hour") -> DataFrame:
    """C2 stream: out-of-range lab readings per patient, lab and sliding window."""
    bad = cl.lab_out_of_range(readings.withWatermark("ts", watermark))
    w = F.window("ts", length, slide)
    return bad.groupBy("patient_key", "metric", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "patient_key", "metric", F.col("w.start").alias("window_start"), "n")


def tumbling_event_counts(events: DataFrame, keys: Sequence[str], watermark: str = "1 hour", length: str = "1 day"
                          ) -> DataFrame:
    """C5 stream: events per key and tumbling window."""
    e = events.withWatermark("ts", watermark)
    return e.groupBy(*keys, F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("w.start").alias("window_start"), "n")


def dedup_alerts(alerts: DataFrame, keys: Sequence[str], watermark: str = "1 hour") -> DataFrame:
    """C15 stream: one alert per key within the watermark delay."""
    return alerts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def assessment_sessions(assessments: DataFrame, patient: str, gap: str = "4 hours", watermark: str = "4 hours"
                        ) -> DataFrame:
    """C7 stream: sessions of assessments separated by more than ``gap``."""
    a = assessments.withWatermark("ts", watermark)
    return a.groupBy(patient, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(
        patient, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def log_predictions(stream: DataFrame, log_path: str, metrics_path: str, ts: str = "ts") -> None:
    """S6 stream sink body for ``foreachBatch``: write the batch to the log
    (partitioned by epoch and day) and one metrics row per model to a metrics
    table (by epoch); a replayed epoch replaces its folder."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day").parquet(f"{log_path}/epoch={epoch}")
        batch.groupBy("model").agg(F.count(F.lit(1)).alias("n"),
                                   F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"),
                                   F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")) \
            .write.mode("overwrite").parquet(f"{metrics_path}/epoch={epoch}")
    return sink


# ---------------------------------------------------------------- stateful detectors

#: Rows taken into Python objects, or emitted, at once.
PART_ROWS = 10_000


def in_order(pdfs: Iterator[pd.DataFrame], value: str) -> Iterator[tuple]:
    """(event_id, ts, value) of all rows by ts and event_id, nulls last.  Only these
    columns are held, as arrays; the frames are let go as they come."""
    held: dict[str, list] = {"event_id": [], "ts": [], value: []}
    for pdf in pdfs:
        for c, parts in held.items():
            parts.append(pdf[c].to_numpy(copy=True))
    cols = [np.concatenate(held.pop(c)) for c in ("event_id", "ts", value)]
    order = np.lexsort((cols[0], cols[1]))
    for lo in range(0, len(order), PART_ROWS):
        at = order[lo:lo + PART_ROWS]
        yield from zip(cols[0][at].tolist(), cols[1][at], cols[2][at].astype(float).tolist(), strict=True)


DDM_STATE = "n long, errors double, p_min double, s_min double"
DDM_OUT = "model string, event_id long, ts timestamp, level string, n_since_reset long"


def ddm_state_fn(min_samples: int = 30, warning_level: float = 2.0, drift_level: float = 3.0):
    """Q7 DDM with reset after each drift, as a ``applyInPandasWithState``
    function over (model, event_id, ts, error) rows."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, errors, p_min, s_min = state.get if state.exists else (0, 0.0, float("inf"), float("inf"))
        names, rows = ["model", "event_id", "ts", "level", "n_since_reset"], []
        for event_id, ts, error in in_order(pdfs, "error"):
            n += 1
            errors += error
            p = errors / n
            s = math.sqrt(p * (1 - p) / n)
            if n < min_samples:
                continue
            if p + s < p_min + s_min:
                p_min, s_min = p, s
            if p + s > p_min + drift_level * s_min:
                rows.append((key[0], int(event_id), pd.Timestamp(ts), "drift", n))
                n, errors, p_min, s_min = 0, 0.0, float("inf"), float("inf")
            elif p + s > p_min + warning_level * s_min:
                rows.append((key[0], int(event_id), pd.Timestamp(ts), "warning", n))
            if len(rows) == PART_ROWS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        state.update((n, errors, p_min, s_min))
        yield pd.DataFrame(rows, columns=names)
    return fn


def ddm_stream(predictions: DataFrame, error_col: str = "error", **kw) -> DataFrame:
    """Q7 stream: DDM warnings and drifts per model, state kept per model."""
    s = predictions.select("model", "event_id", "ts", F.col(error_col).cast("double").alias("error"))
    return s.groupBy("model").applyInPandasWithState(ddm_state_fn(**kw), DDM_OUT, DDM_STATE, "append",
                                                     GroupStateTimeout.NoTimeout)


ADWIN_STATE = "buckets string, n_seen long"
ADWIN_OUT = "model string, event_id long, ts timestamp, window_width long, mean_before double, mean_after double"


class Adwin:
    """ADWIN (Bifet & Gavalda 2007) with an exponential histogram: at most
    ``m`` buckets per size, so memory is O(m log W).  A change is signalled
    when two sub-windows' means differ by more than the Hoeffding-style
    bound eps_cut; the older part is then dropped."""

    def __init__(self, delta: float = 0.002, m: int = 5, buckets=None):
        self.delta, self.m = delta, m
        self.b = buckets or []  # oldest first: [count, total, variance]

    @property
    def width(self) -> int:
        return int(sum(x[0] for x in self.b))

    def add(self, x: float) -> tuple[float, float] | None:
        self.b.append([1, float(x), 0.0])
        self._compress()
        return self._detect()

    def _compress(self) -> None:
        size = 1
        while True:
            idx = [i for i, bk in enumerate(self.b) if bk[0] == size]
            if len(idx) <= self.m:
                if not idx:
                    break
                size *= 2
                continue
            i, j = idx[0], idx[1]  # merge the two oldest of this size
            n1, t1, v1 = self.b[i]
            n2, t2, v2 = self.b[j]
            mu1, mu2 = t1 / n1, t2 / n2
            merged = [n1 + n2, t1 + t2, v1 + v2 + n1 * n2 / (n1 + n2) * (mu1 - mu2) ** 2]
            self.b[i] = merged
            del self.b[j]
            size *= 2

    def _detect(self) -> tuple[float, float] | None:
        found = None
        changed = True
        while changed and len(self.b) > 1:
            changed = False
            n = self.width
            tot = sum(bk[1] for bk in self.b)
            var = self._variance()
            n0, t0 = 0, 0.0
            for k in range(len(self.b) - 1):
                n0 += self.b[k][0]
                t0 += self.b[k][1]
                n1, t1 = n - n0, tot - t0
                if n0 < 5 or n1 < 5:
                    continue
                mu0, mu1 = t0 / n0, t1 / n1
                mm = 1.0 / (1.0 / n0 + 1.0 / n1)
                dd = math.log(2.0 * math.log(n) / self.delta) if n > 1 else 0.0
                eps = math.sqrt(2.0 / mm * var * dd) + 2.0 / (3.0 * mm) * dd
                if abs(mu0 - mu1) > eps:
                    found = (mu0, mu1)
                    del self.b[0]  # shrink from the old end and re-test
                    changed = True
                    break
        return found

    def _variance(self) -> float:
        n = self.width
        if n < 2:
            return 0.0
        tot = sum(bk[1] for bk in self.b)
        mu = tot / n
        ss = sum(bk[2] + bk[0] * (bk[1] / bk[0] - mu) ** 2 for bk in self.b)
        return ss / n


def adwin_state_fn(delta: float = 0.002, m: int = 5):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buckets, n_seen = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        ad = Adwin(delta, m, buckets)
        names, rows = ["model", "event_id", "ts", "window_width", "mean_before", "mean_after"], []
        for event_id, ts, x in in_order(pdfs, "x"):
            n_seen += 1
            hit = ad.add(x)
            if hit:
                rows.append((key[0], int(event_id), pd.Timestamp(ts), ad.width, hit[0], hit[1]))
            if len(rows) == PART_ROWS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        state.update((json.dumps(ad.b), n_seen))
        yield pd.DataFrame(rows, columns=names)
    return fn


def adwin_stream(stream: DataFrame, value: str, delta: float = 0.002) -> DataFrame:
    """Q8 stream: ADWIN change points of ``value`` per model (bounded state)."""
    s = stream.select("model", "event_id", "ts", F.col(value).cast("double").alias("x"))
    return s.groupBy("model").applyInPandasWithState(adwin_state_fn(delta), ADWIN_OUT, ADWIN_STATE, "append",
                                                     GroupStateTimeout.NoTimeout)


def latency_percentiles_stream(log: DataFrame, endpoint: str, latency: str, watermark: str = "10 minutes",
                               window: str = "1 hour", probs=(0.95, 0.99), accuracy: int = 10000) -> DataFrame:
    """Q10 stream: per endpoint and tumbling window, approximate latency
    percentiles (``percentile_approx`` keeps a bounded sketch per window in
    the state store; the exact batch form is ``monitor.latency_percentiles``)."""
    e = log.withWatermark("ts", watermark)
    q = F.percentile_approx(F.col(latency), list(probs), accuracy)
    g = e.groupBy(endpoint, F.window("ts", window).alias("w")).agg(q.alias("q"), F.count(F.lit(1)).alias("n"))
    return g.select(endpoint, F.col("w.start").alias("window_start"), "n",
                    *[F.col("q")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(probs)])


def online_logistic_sink(weights_path: str, vec: str = "features_array", label: str = "label", lr: float = 0.1,
                         dim: int | None = None):
    """M11 stream: ``foreachBatch`` body doing one mini-batch logistic
    gradient step per micro-batch.  The weights live in a small parquet
    table (one row per epoch) in the shared folder, so a restarted stream
    continues from the last committed step."""
    from medlake.operators.ml import gradient_step

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            last = spark.read.parquet(weights_path).orderBy(F.desc("epoch")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None  # no weights yet
        if last is not None and last["epoch"] >= epoch:
            return  # this epoch was already applied (replay after a restart)
        if batch.isEmpty():
            return
        n = dim or len(batch.select(vec).first()[0])
        w, b = (list(last["weights"]), last["bias"]) if last is not None else ([0.0] * n, 0.0)
        w, b = gradient_step(batch, w, b, vec, label, lr=lr)
        spark.createDataFrame([(epoch, w, b)], "epoch long, weights array<double>, bias double") \
            .write.mode("append").parquet(weights_path)
    return sink


def census_stream(stays: DataFrame, patient: str, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """C11 stream: approximate distinct admitted patients per window
    (``approx_count_distinct``: a bounded HyperLogLog sketch in state)."""
    s = stays.withWatermark("ts", watermark)
    return s.groupBy(F.window("ts", window).alias("w")).agg(
        F.approx_count_distinct(patient).alias("approx_patients")).select(
        F.col("w.start").alias("window_start"), "approx_patients")
