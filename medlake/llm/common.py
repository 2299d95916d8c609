"""Shared helpers: Arrow text batches, vectorised tokenising and hashing,
connected components on an edge table.

All numpy work happens on slices of about ``SLICE_BYTES`` of UTF-8 text, so a
task's memory does not depend on how many rows an Arrow batch holds; only a
single text larger than a slice is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medlake.session import ensure_checkpoint_dir, materialize

SLICE_BYTES = 1 << 20
#: Rows that Spark hands to a Python worker at once; its default of 10,000 texts
#: would be held by the JVM and the worker at the same time.
BATCH_ROWS = 1024
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows."""
    now = int(spark.conf.get(BATCH_CONF, "0"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table, read by Spark so that any Hadoop file system works."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back (cuts lineage)."""
    ensure_checkpoint_dir(df.sparkSession)
    bounded_batches(df.sparkSession)
    return materialize(df, f"llm-{name}")


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of (id, text): rows equal in both share it, nulls included."""
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull())


def filled(arr: pa.Array) -> pa.Array:
    """A string array without nulls (null becomes the empty text)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.fill_null(arr, "") if arr.null_count else arr


def text_slices(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, UTF-8 bytes, row offsets into them)."""
    arr = filled(arr)
    n = len(arr)
    if not n:
        return
    buf = arr.buffers()
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offs = np.frombuffer(buf[1], dtype=width)[arr.offset: arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf[2], dtype=np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


# --- tokenising -----------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = True
_ALNUM[0x61:0x7B] = True
_ALNUM[0x80:] = True
#: Bytes that belong to a word, after lower-casing A-Z.
WORD_BYTES = {"space": _SPACE, "alnum": _ALNUM}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps modulo 2^64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions) and row index of every word of lowered
    bytes; words never run across rows."""
    inside = WORD_BYTES[kind][data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    total = int(length.sum())
    begin = np.cumsum(length) - length
    pos = np.arange(total, dtype=np.int64) - np.repeat(begin, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
    val = _BYTE_HASH[data[pos + np.repeat(starts, length)]] * power[pos]
    return mix64(np.add.reduceat(val, begin) + length.astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position (length ``n - k + 1``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    c = np.uint64(0x2545F4914F6CDD1D)
    for j in range(k):
        out = (out + words[j:j + n]) * c
        out ^= out >> np.uint64(29)
    return mix64(out)


# --- bitmaps of keys --------------------------------------------------------

def key_bitmap(keys: DataFrame, bits: int = 1 << 23):
    """A broadcast bitmap of fixed size (1 MB) over the keys' hashes, built by
    OR-ing one bitmap per partition pairwise in a tree."""
    sc = keys.sparkSession.sparkContext

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            at = (mix64(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        seg = out.reshape(-1, 4096)
        used = np.flatnonzero(seg.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([seg[i].tobytes() for i in used], pa.binary())],
                                         names=["seg", "bits"])

    rows = keys.mapInArrow(mark, "seg long, bits binary").groupBy("seg").agg(F.bitmap_or_agg("bits").alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[r["seg"] * 4096:(r["seg"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return sc.broadcast(out)


#: Least and most bits of a key filter (128 kB to 32 MB), and bits for each key between.
FILTER_BITS = (1 << 20, 1 << 28)
BITS_A_KEY = 16


def filter_bits(count: int) -> int:
    low, high = FILTER_BITS
    return min(high, max(low, 1 << (count * BITS_A_KEY).bit_length()))


def key_hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for each 64-bit key whose bit is set."""
    at = (mix64(keys.view(np.uint64)) % np.uint64(len(bits) * 8)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def key_filter(keys: DataFrame, count: int) -> Callable[[Column], Column]:
    """A test of 64-bit keys: true for each of the ``count`` given ones and for few
    others.  Rows that fail it need no join with ``keys``.  The bitmap has a bound
    whatever ``count``; beyond it more rows pass, and are joined."""
    bitmap = key_bitmap(keys, filter_bits(count))

    @F.pandas_udf("boolean")
    def hit(k: pd.Series) -> pd.Series:
        return pd.Series(key_hits(bitmap.value, k.to_numpy()))
    return hit


# --- connected components -------------------------------------------------

def sized(df: DataFrame, rows: int, per: int = 200_000) -> DataFrame:
    """``df`` in about ``rows / per`` partitions (no shuffle) where that is
    fewer than the session's; small tables then cost few tasks."""
    spark = df.sparkSession
    want = max(-(-rows // per), spark.sparkContext.defaultParallelism)
    return df.coalesce(want) if want < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(u, v)`` with the smallest node it reaches.

    Alternating large-star and small-star steps; each step is a grouped
    minimum (partial aggregation, so a hub is pre-aggregated) and a join whose
    hot side AQE can split.  Every step is written to the shared folder.  The
    steps keep connectivity, so the work is done once the edges are stars: no
    node is both child and root, and no child has two roots.
    Returns (node, root); isolated nodes are absent.
    """
    e = landed(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
               .filter("a <> b").distinct(), f"{name}-e")
    for _ in range(most_rounds):
        n = e.count()
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("top")).union(
            e.select(F.col("b").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("top")))
        mixed = (sized(ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("top").alias("top")), n)
                 .agg(F.max(((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("top") > 0))).cast("int")).alias("m")).first()["m"])
        if not mixed:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = landed(sized(both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                             .filter("a <> b"), n), f"{name}-l")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = sized(large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b"), n)
        e = landed(sized(star.distinct(), n), f"{name}-s")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def cross_blocks(members: DataFrame, data: DataFrame, compare, block: int) -> DataFrame:
    """Edges between members of one bucket that are in different components.

    ``members`` has (_band, _cls, _root), ``data`` the payload by ``_cls``.
    Queries are the members outside their bucket's largest component; they
    meet all members in blocks of about ``block``, so no task holds a whole
    bucket and ``compare`` decides which pairs become rows.  Work is the number
    of queries times the size of their bucket; buckets whose members are all in
    one component cost nothing."""
    per = members.groupBy("_band", "_root").agg(F.count("*").alias("n"))
    top = per.groupBy("_band").agg(F.max(F.struct("n", "_root")).alias("t"), F.sum("n").alias("all"),
                                   F.count("*").alias("roots")).filter("roots > 1")
    top = top.select("_band", F.col("t._root").alias("_main"), F.ceil(F.col("all") / block).cast("int").alias("_rows"),
                     F.ceil((F.col("all") - F.col("t.n")) / block).cast("int").alias("_cols"))
    full = landed(members.join(top, "_band"), "cross").join(data, "_cls")
    spot = F.xxhash64("_cls")
    keep = ["_band", "_cls", "_root", *[c for c in data.columns if c != "_cls"]]
    member = full.select(*keep, F.pmod(spot, F.col("_rows")).cast("int").alias("_i"),
                         F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)).alias("_j"), F.lit(False).alias("_query"))
    query = full.filter(F.col("_root") != F.col("_main")).select(
        *keep, F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_i"),
        F.pmod(spot, F.col("_cols")).cast("int").alias("_j"), F.lit(True).alias("_query"))
    query = query.select(*member.columns)
    got = member.union(query).groupBy("_band", "_i", "_j").applyInArrow(compare, "u long, v long")
    return got.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
