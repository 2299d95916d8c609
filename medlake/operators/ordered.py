"""Order-dependent aggregates that must not run in one task.

A window ``ORDER BY`` with no ``PARTITION BY`` -- or partitioned by a key
that holds a large share of the rows -- sends all of those rows to one
task.  The helpers here split such work by *range buckets* of the
ordering key:

* boundaries come from one ``percentile_approx`` pass (a few numbers);
* per (key, bucket) sums / last values form a small bookkeeping table
  whose prefix over buckets gives each bucket's offset;
* the final window runs per (key, bucket).

Only keys that are actually heavy (more than ``heavy_rows`` rows) are
split: light keys keep one window partition per key and need no
bookkeeping, so a table with millions of small keys pays nothing extra.
Heavy keys are found with one grouped count; their number is at most
rows / heavy_rows, so the heavy-key and bookkeeping tables have a proven
size bound and are broadcast.

``exact_quantiles`` builds on it: distinct values with their counts,
running counts, then only the rows holding the wanted ranks survive --
exact linear-interpolation quantiles without gathering a column in one
task (``percentile`` keeps every distinct value of a group in memory).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 64
DEFAULT_HEAVY_ROWS = 2_000_000
MAX_HEAVY_KEYS = 500_000  # broadcast bound for the heavy-key table
MAX_BOOKKEEPING_ROWS = 2_000_000  # heavy keys x buckets kept below this (broadcast bound)


def _is_temporal(df: DataFrame, c: Column) -> bool:
    t = df.select(c).schema.fields[0].dataType.typeName()
    return t in ("timestamp", "timestamp_ntz", "date")


def _bucket_splits(df: DataFrame, key: Column, n_buckets: int) -> list[float]:
    if n_buckets <= 1:
        return []
    qs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(F.percentile_approx(key, qs, 10000).alias("q")).first()
    vals = row["q"] if row is not None else None
    return sorted({float(v) for v in (vals or []) if v is not None and math.isfinite(v)})


def _bucket_key(df: DataFrame, first: Column, descending: bool) -> Column:
    key = F.unix_micros(first.cast("timestamp")).cast("double") if _is_temporal(df, first) else first.cast("double")
    k = -key if descending else key
    # as Spark sorts: NaN above every number, NULL below every one
    k = F.when(F.isnan(key), F.lit(float("-inf") if descending else float("inf"))).otherwise(k)
    return F.coalesce(k, F.lit(float("inf") if descending else float("-inf")))


def _assign_buckets(df: DataFrame, order: Sequence[Column], parts: list[str], n_buckets: int, heavy_rows: int,
                    descending: bool = False) -> tuple[DataFrame, str]:
    """Adds ``__b`` (bucket) and returns the plan kind:
    ``'none'`` (no key is heavy: ``__b`` = 0), ``'all'`` (no partition
    columns: every row bucketed), ``'heavy'`` (heavy keys bucketed, light keys 0)."""
    base = df.withColumn("__bkey", _bucket_key(df, order[0], descending))
    if not parts:
        splits = _bucket_splits(base, F.col("__bkey"), n_buckets)
        b = Bucketizer(splits=[float("-inf")] + splits + [float("inf")], inputCol="__bkey", outputCol="__b",
                       handleInvalid="keep").transform(base)
        return b.drop("__bkey").withColumn("__b", F.col("__b").cast("int")), "all"
    heavy = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy_rows).select(*parts)
    n_heavy = heavy.limit(MAX_HEAVY_KEYS + 1).count()
    if n_heavy == 0:
        return base.drop("__bkey").withColumn("__b", F.lit(0)), "none"
    hk = heavy.withColumn("__hv", F.lit(True))
    hk = F.broadcast(hk) if n_heavy <= MAX_HEAVY_KEYS else hk
    flagged = base.join(hk, parts, "left")
    # fewer buckets when there are many heavy keys, so the per-(key, bucket)
    # bookkeeping table stays under MAX_BOOKKEEPING_ROWS and can be broadcast
    n_buckets = max(2, min(n_buckets, MAX_BOOKKEEPING_ROWS // max(1, n_heavy) - 1))
    splits = _bucket_splits(flagged.where(F.col("__hv")), F.col("__bkey"), n_buckets)
    b = Bucketizer(splits=[float("-inf")] + splits + [float("inf")], inputCol="__bkey", outputCol="__braw",
                   handleInvalid="keep").transform(flagged)
    # heavy keys use buckets 1..B+1, light keys bucket 0
    b = b.withColumn("__b", F.when(F.col("__hv"), F.col("__braw").cast("int") + 1).otherwise(F.lit(0)))
    return b.drop("__bkey", "__braw", "__hv"), ("heavy" if n_heavy <= MAX_HEAVY_KEYS else "heavy_many")


def _bounded(book: DataFrame, kind: str) -> DataFrame:
    """Broadcast a bookkeeping table when its size is proven: (#heavy keys)
    x (#buckets + 1) <= MAX_BOOKKEEPING_ROWS ('all': #buckets + 1 rows).
    Beyond MAX_HEAVY_KEYS heavy keys it is joined by a shuffle instead."""
    return book if kind == "heavy_many" else F.broadcast(book)


def running_totals(df: DataFrame, order: Sequence[str | Column], sum_cols: Sequence[str],
                   partition_cols: Sequence[str] = (), descending: bool = False,
                   n_buckets: int = DEFAULT_BUCKETS, prefix: str = "cum_",
                   with_totals: bool = True, heavy_rows: int = DEFAULT_HEAVY_ROWS) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order`` within ``partition_cols``.

    ``order`` must be a total order inside a partition (add a tie-breaker).
    The first order column must be numeric, date or timestamp; it drives
    the range buckets.  Adds ``{prefix}{c}`` and, if ``with_totals``,
    ``total_{c}`` columns.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = list(partition_cols)
    b, kind = _assign_buckets(df, order, parts, n_buckets, heavy_rows, descending)
    ordered = [o.desc() if descending else o.asc() for o in order]
    w_in = Window.partitionBy(*parts, "__b").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    keep = [F.col(f"`{c}`") for c in df.columns]
    if kind == "none":
        wkey = Window.partitionBy(*parts)
        return b.select(*keep, *[F.sum(c).over(w_in).alias(f"{prefix}{c}") for c in sum_cols],
                        *([F.sum(c).over(wkey).alias(f"total_{c}") for c in sum_cols] if with_totals else []))
    src = b if kind == "all" else b.where(F.col("__b") > 0)
    # bookkeeping: one row per (heavy key, bucket) -> at most MAX_HEAVY_KEYS x (n_buckets + 1) rows
    tot = src.groupBy(*parts, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    wprev = Window.partitionBy(*parts).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*parts)
    offs = tot.select(*parts, "__b",
                      *[F.coalesce(F.sum(f"__t_{c}").over(wprev), F.lit(0)).alias(f"__o_{c}") for c in sum_cols],
                      *[F.sum(f"__t_{c}").over(wall).alias(f"__T_{c}") for c in sum_cols])
    j = b.join(_bounded(offs, kind), [*parts, "__b"], "left")
    wb = Window.partitionBy(*parts, "__b")
    return j.select(*keep,
                    *[(F.sum(c).over(w_in) + F.coalesce(F.col(f"__o_{c}"), F.lit(0))).alias(f"{prefix}{c}")
                      for c in sum_cols],
                    *([F.coalesce(F.col(f"__T_{c}"), F.sum(c).over(wb)).alias(f"total_{c}") for c in sum_cols]
                      if with_totals else []))


def exact_quantiles_df(df: DataFrame, col: str, probs: Sequence[float],
                       group_cols: Sequence[str] = (), n_buckets: int = DEFAULT_BUCKETS,
                       heavy_rows: int = DEFAULT_HEAVY_ROWS) -> DataFrame:
    """Exact linear-interpolation quantiles of ``col`` per group.

    Returns ``(*group_cols, p, q)``; NULLs are ignored; an all-NULL group
    yields no rows.
    """
    g = list(group_cols)
    counts = df.where(F.col(col).isNotNull()).groupBy(*g, col).agg(F.count(F.lit(1)).alias("n"))
    c = running_totals(counts, [col], ["n"], partition_cols=g, n_buckets=n_buckets, heavy_rows=heavy_rows)
    parr = F.array(*[F.lit(float(p)) for p in probs])
    start = F.col("cum_n") - F.col("n")

    def holds(rank):
        return (start <= rank) & (rank < F.col("cum_n"))

    def pos(p):
        return p * (F.col("total_n") - 1)

    c = c.where(F.exists(parr, lambda p: holds(F.floor(pos(p))) | holds(F.ceil(pos(p)))))
    c = c.withColumn("p", F.explode(parr))
    ps = pos(F.col("p"))
    agg = c.groupBy(*g, "p").agg(
        F.max(F.when(holds(F.floor(ps)), F.col(col))).alias("__lo"),
        F.max(F.when(holds(F.ceil(ps)), F.col(col))).alias("__hi"),
        F.first(ps).alias("__pos"),
    )
    q = F.col("__lo") + (F.col("__pos") - F.floor("__pos")) * (F.col("__hi") - F.col("__lo"))
    return agg.select(*g, "p", q.cast("double").alias("q"))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    n_buckets: int = DEFAULT_BUCKETS) -> list[float | None]:
    """Global exact quantiles as Python floats (one small row per prob)."""
    rows = exact_quantiles_df(df, col, probs, n_buckets=n_buckets).collect()
    got = {round(r["p"], 12): r["q"] for r in rows}
    return [got.get(round(float(p), 12)) for p in probs]


def bucketed_lag(df: DataFrame, order: Sequence[str | Column], value: str, partition_cols: Sequence[str] = (),
                 out: str | None = None, n_buckets: int = DEFAULT_BUCKETS,
                 heavy_rows: int = DEFAULT_HEAVY_ROWS) -> DataFrame:
    """``lag(value)`` over ``order`` within ``partition_cols`` without a
    single hot task: heavy keys (and the unpartitioned case) are
    range-bucketed, lag runs inside (key, bucket), and a bucket's first row
    takes the last value of the previous non-empty bucket from a small
    bookkeeping table."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = list(partition_cols)
    out = out or f"prev_{value}"
    b, kind = _assign_buckets(df, order, parts, n_buckets, heavy_rows)
    w = Window.partitionBy(*parts, "__b").orderBy(*order)
    keep = [F.col(f"`{c}`") for c in df.columns]
    if kind == "none":
        return b.select(*keep, F.lag(value).over(w).alias(out))
    src = b if kind == "all" else b.where(F.col("__b") > 0)
    last = src.groupBy(*parts, "__b").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    wb = Window.partitionBy(*parts).orderBy("__b")
    prev = last.select(*parts, "__b", F.lag("__last").over(wb).alias("__prev_last"))
    j = b.join(_bounded(prev, kind), [*parts, "__b"], "left")
    first_in_bucket = F.row_number().over(w) == 1
    lagged = F.when(first_in_bucket, F.col("__prev_last")).otherwise(F.lag(value).over(w))
    return j.select(*keep, lagged.alias(out))


def row_index(df: DataFrame, order: Sequence[str | Column], partition_cols: Sequence[str] = (),
              out: str = "row_index", n_buckets: int = DEFAULT_BUCKETS,
              heavy_rows: int = DEFAULT_HEAVY_ROWS) -> DataFrame:
    """1-based position of each row in ``order`` within its partition."""
    r = running_totals(df.withColumn("__one", F.lit(1)), order, ["__one"], partition_cols=partition_cols,
                       n_buckets=n_buckets, with_totals=False, heavy_rows=heavy_rows)
    return r.withColumnRenamed("cum___one", out).drop("__one")


def trailing_window(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int,
                    aggs: dict[str, Column], chunk_rows: int = 1_000_000, include_current: bool = False,
                    heavy_rows: int = DEFAULT_HEAVY_ROWS) -> DataFrame:
    """Aggregates over the previous ``n`` rows (``rowsBetween(-n, -1)``, or
    ``(-n + 1, 0)`` with ``include_current``) per key, with bounded tasks.

    Rows are numbered per key and cut into chunks of ``chunk_rows``; the
    last ``n`` rows of every chunk are copied into the next chunk as
    read-only context ("halo").  The window then runs per (key, chunk) with
    Spark's own numerically stable aggregates, and the halo copies are
    dropped -- exact, and no partition exceeds ``chunk_rows + n`` rows even
    for a key holding most of the data.  A chunk holds at least ``n`` rows, so
    the halo never has to reach beyond the chunk before.
    """
    k = list(keys)
    chunk_rows = max(chunk_rows, n)
    idx = row_index(df, order, partition_cols=k, out="__idx", heavy_rows=heavy_rows)
    chunk = F.floor((F.col("__idx") - 1) / F.lit(chunk_rows))
    own = idx.withColumn("__chunk", chunk).withColumn("__halo", F.lit(False))
    halo = idx.where(((F.col("__idx") - 1) % chunk_rows) >= chunk_rows - n).withColumn(
        "__chunk", chunk + 1).withColumn("__halo", F.lit(True))
    both = own.unionByName(halo)
    lo, hi = (-n + 1, 0) if include_current else (-n, -1)
    w = Window.partitionBy(*k, "__chunk").orderBy("__idx").rowsBetween(lo, hi)
    out = both.select(*[F.col(f"`{c}`") for c in df.columns], "__idx", "__halo",
                      *[agg.over(w).alias(name) for name, agg in aggs.items()])
    return out.where(~F.col("__halo")).drop("__halo").withColumnRenamed("__idx", "row_index")


def running_min(df: DataFrame, order: Sequence[str | Column], cols: Sequence[str], partition_cols: Sequence[str] = (),
                prefix: str = "min_", n_buckets: int = DEFAULT_BUCKETS, heavy_rows: int = DEFAULT_HEAVY_ROWS
                ) -> DataFrame:
    """Inclusive running minimum of each column (any orderable type,
    structs included, so an arg-min travels with its value) in ``order``
    within ``partition_cols``; min is associative, so heavy keys use the
    same bucket-offset scheme as ``running_totals``."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = list(partition_cols)
    b, kind = _assign_buckets(df, order, parts, n_buckets, heavy_rows)
    w_in = Window.partitionBy(*parts, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keep = [F.col(f"`{c}`") for c in df.columns]
    if kind == "none":
        return b.select(*keep, *[F.min(c).over(w_in).alias(f"{prefix}{c}") for c in cols])
    src = b if kind == "all" else b.where(F.col("__b") > 0)
    tot = src.groupBy(*parts, "__b").agg(*[F.min(c).alias(f"__m_{c}") for c in cols])
    wprev = Window.partitionBy(*parts).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*parts, "__b", *[F.min(f"__m_{c}").over(wprev).alias(f"__o_{c}") for c in cols])
    j = b.join(_bounded(offs, kind), [*parts, "__b"], "left")

    def lo(a, o):
        return F.when(o.isNull(), a).when(a.isNull(), o).otherwise(F.least(a, o))

    return j.select(*keep, *[lo(F.min(c).over(w_in), F.col(f"__o_{c}")).alias(f"{prefix}{c}") for c in cols])
