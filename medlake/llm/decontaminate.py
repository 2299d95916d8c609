"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item gives its windows of ``WINDOW`` consecutive words (an item
with fewer words, but not none, is one window).  A window's tokens are its
``SHINGLE``-word shingles (shorter windows: the whole window).

1. One pass over the documents keeps runs of positions whose shingle hits a
   bitmap of fixed size over the benchmark's shingles.  Length bound: a run
   must be long enough for the shortest window with that token length.
2. The kept positions give every benchmark shingle its frequency in the
   corpus.  Shingles are ordered by rarity; containment must be complete, so
   the necessary prefix of a window is its one rarest shingle.  A window with
   a shingle that never occurs cannot occur.
3. Kept positions join the prefix tokens; the window must lie inside the run
   (positional bound) and is then compared word by word.
4. Occurrences become hit words (union of intervals) and item lists.

The bitmap only saves shuffling: its false hits fall out in step 3.

Results for odd input: null or wordless text has ``n_words`` 0 and no hits;
null or wordless items have no windows; items with a null id mark words but
are not listed; repeated items and rows are counted once each; a null doc id
is kept as null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import (key_filter, landed, lower_bytes, mix64, row_key, shingle_hashes, spare, text_slices,
                                word_bounds, word_hashes)

WINDOW = 10
SHINGLE = 5
SEGMENT = 64
BITS = 1 << 24
BROADCAST_BYTES = 8 << 20


def _texts(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, lowered bytes, starts, ends, hashes, cuts by row)."""
    for lo, hi, data, offs in text_slices(arr):
        low = lower_bytes(data)
        starts, ends, row = word_bounds(low, offs, "alnum")
        yield lo, low, starts, ends, word_hashes(low, starts, ends), np.searchsorted(row, np.arange(hi - lo + 1))


def _spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [low[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]


_WINDOWS = "_item string, _len int, _words array<string>, _sh array<bigint>"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, low, starts, ends, words, cut in _texts(batch.column("_text")):
            out: dict[str, list] = {"_item": [], "_len": [], "_words": [], "_sh": []}
            for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                n = min(WINDOW, int(b - a))
                if not n:
                    continue
                s = min(SHINGLE, n)
                spelled = _spelled(low, starts[a:b], ends[a:b])
                sh = shingle_hashes(words[a:b], s).view(np.int64)
                for i in range(len(spelled) - n + 1):
                    out["_item"].append(batch.column("_item")[lo + r].as_py())
                    out["_len"].append(n)
                    out["_words"].append(spelled[i:i + n])
                    out["_sh"].append(sh[i:i + n - s + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["_item"], pa.string()), pa.array(out["_len"], pa.int32()),
                 pa.array(out["_words"], pa.list_(pa.string())), pa.array(out["_sh"], pa.list_(pa.int64()))], names=list(out))


_SEGMENTS = ("_rk long, _id long, n_words long, _segs array<struct<s:int,pos:int,ctx:int,"
             "sh:array<bigint>,words:array<string>>>")
_SEG_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("pos", pa.int32()), ("ctx", pa.int32()),
                                ("sh", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))]))


def _segments(bitmap, shortest: dict[int, int]):
    """Runs of benchmark shingles in each text, cut into segments of at most
    ``SEGMENT`` positions with the words a window around them may need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for lo, low, starts, ends, words, cut in _texts(batch.column("_text")):
                n = len(cut) - 1
                segs: list[list[dict]] = [[] for _ in range(n)]
                for s, least in shortest.items():
                    sh = shingle_hashes(words, s)
                    if not len(sh):
                        continue
                    at = (mix64(sh) % np.uint64(BITS)).astype(np.int64)
                    hit = ((bits[at >> 3] >> (at & 7)) & 1).astype(bool)
                    pos = np.flatnonzero(hit)
                    row = np.searchsorted(cut, pos, side="right") - 1
                    ok = pos + s <= cut[row + 1]
                    pos, row = pos[ok], row[ok]
                    if not len(pos):
                        continue
                    new = np.flatnonzero((np.diff(pos) != 1) | (np.diff(row) != 0)) + 1
                    for p in np.split(pos, new):
                        if len(p) < least:
                            continue
                        a, stop = int(p[0]), int(p[-1]) + s
                        r = int(np.searchsorted(cut, a, side="right") - 1)
                        base = int(cut[r])
                        for q in range(a, int(p[-1]) + 1, SEGMENT):
                            last = min(q + SEGMENT, int(p[-1]) + 1)
                            x, y = max(a, q - WINDOW), min(stop, last + WINDOW)
                            segs[r].append({"s": s, "pos": q - base, "ctx": x - base, "sh": sh[q:last].view(np.int64),
                                            "words": _spelled(low, starts[x:y], ends[x:y])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_rk").slice(lo, n), batch.column("_id").slice(lo, n),
                     pa.array(np.diff(cut).astype(np.int64)), pa.array(segs, _SEG_TYPE)],
                    names=["_rk", "_id", "n_words", "_segs"])
    return run


def _bitmap(hashes: DataFrame):
    """Broadcast bitmap of ``BITS`` bits (2 MB), merged from partial ones."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BITS // 8, dtype=np.uint8)
        for batch in batches:
            at = (mix64(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        seg = out.reshape(-1, 4096)
        used = np.flatnonzero(seg.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([seg[i].tobytes() for i in used], pa.binary())],
                                         names=["seg", "bits"])

    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in hashes.mapInArrow(mark, "seg long, bits binary").groupBy("seg").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        out[r["seg"] * 4096:(r["seg"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _small(df: DataFrame, size) -> DataFrame:
    """``df`` with a broadcast hint where its bytes are counted and few."""
    if (df.agg(F.sum(size).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Return documents (_rk, _id, n_words), occurrences (_rk, _win, start,
    stop) and the windows' items (_win, _item)."""
    spark = docs.sparkSession
    win = landed(benchmark.select(F.col(item_col).cast("string").alias("_item"), F.col(item_text).cast("string").alias("_text"))
                 .mapInArrow(_item_windows, _WINDOWS)
                 .withColumn("_win", F.xxhash64(F.array_join("_words", " "))), "windows")
    distinct = win.dropDuplicates(["_win"]).select("_win", "_len", "_words", "_sh")
    least = {r["s"]: r["m"] for r in win.groupBy(F.least(F.lit(SHINGLE), F.col("_len")).alias("s"))
             .agg(F.min(F.size("_sh")).alias("m")).collect()}
    bitmap = _bitmap(distinct.select(F.explode("_sh").alias("h")))
    src = docs.select(row_key(id_col, text_col).alias("_rk"), F.col(id_col).cast("long").alias("_id"),
                      F.col(text_col).cast("string").alias("_text"))
    found = landed(src.mapInArrow(_segments(bitmap, least), _SEGMENTS), "segments")
    seg = found.filter(F.size("_segs") > 0).select("_rk", F.explode("_segs").alias("g"))

    # rarity of the benchmark's shingles in the corpus, then each window's prefix
    freq = seg.select(F.explode("g.sh").alias("h")).groupBy("h").agg(F.count("*").alias("f"))
    token = distinct.select("_win", F.posexplode("_sh").alias("off", "h"))
    rare = (token.join(freq, "h", "left").groupBy("_win")
            .agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), F.col("h"), F.col("off"))).alias("t"))
            .filter("t.f > 0").select("_win", F.col("t.h").alias("h"), F.col("t.off").alias("off")))
    prefix = landed(rare.join(distinct.drop("_sh"), "_win"), "prefix")
    prefix = _small(prefix, F.lit(40) + F.length(F.array_join("_words", " ")) + 16 * F.col("_len"))

    at = seg.select("_rk", "g.pos", "g.ctx", F.col("g.words").alias("_text_words"), F.posexplode("g.sh").alias("i", "h"))
    start = F.col("pos") + F.col("i") - F.col("off")
    occ = (at.join(prefix, "h").withColumn("start", start)
           .filter((F.col("start") >= F.col("ctx")) & (F.col("start") + F.col("_len") <= F.col("ctx") + F.size("_text_words")))
           .filter(F.slice("_text_words", F.col("start") - F.col("ctx") + 1, F.col("_len")) == F.col("_words"))
           .select("_rk", "_win", "start", (F.col("start") + F.col("_len")).alias("stop")))
    occ = landed(occ, "occurrences")
    items = win.filter("_item is not null").select("_win", "_item").distinct()
    return found.drop("_segs"), occ, items


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: _rk, _id, n_words, n_hit, n_items, items (sorted, as strings),
    contaminated."""
    rows, occ, items = occurrences(docs, benchmark, id_col, text_col, item_col, item_text)
    # union of intervals, folded in order of their starts
    spans = occ.groupBy("_rk").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("v"))
    covered = F.expr("""aggregate(v, struct(0 as upto, 0L as n), (a, x) -> struct(
        greatest(a.upto, x.stop) as upto,
        a.n + greatest(0, x.stop - greatest(a.upto, x.start)) as n)).n""")
    hit = spans.select("_rk", covered.alias("n_hit"))
    items = _small(items, F.lit(24) + F.length("_item"))
    names = (occ.select("_rk", "_win").distinct().join(items, "_win").select("_rk", "_item").distinct()
             .groupBy("_rk").agg(F.array_sort(F.collect_list("_item")).alias("items")))
    out = rows.join(hit.join(names, "_rk", "left"), "_rk", "left")
    none = F.array().cast("array<string>")
    return out.select("_rk", "_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
                      F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document with the digest of the items it contains."""
    out = contamination(docs, benchmark, id_col)
    return out.select(F.col("_id").alias(id_col), "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, all columns kept.  Only
    rows that may go are shuffled."""
    rk = spare(docs, "_llm_rk")
    bad = landed(occurrences(docs, benchmark, id_col, text_col)[1].select(F.col("_rk").alias(rk)).distinct(), "contaminated")
    keyed = docs.withColumn(rk, row_key(id_col, text_col))
    unsure = key_filter(bad, bad.count())(F.col(rk))
    clean = keyed.filter(unsure).join(bad, rk, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return keyed.filter(~unsure).drop(rk).union(clean)
