"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct ``K``-word shingles.  Its sketch is the
SetSketch of that set: register ``i`` is the smallest of exponential variates
(rate ``A``) of all elements, on the log scale ``floor(1 - log_B(x))``
truncated to 16 bits.  Registers merge by maximum and two sets agree in a
register with a probability close to (never below) their similarity.

1. Sketch every text in numpy; documents with equal sets form one *class*.
2. Band the registers: ``shape`` takes the most rows a band may have so that a
   pair at the threshold shares no band with probability below ``MISS`` (32 bands
   of 6 rows at 0.85, 38 of 5 at 0.8).
3. Buckets of at most ``FEW`` classes give all their pairs; larger ones give
   one edge per member, to the member with the heaviest buckets (a star, so
   the count stays linear in a hot group).
4. Candidate pairs must pass the size bound and the joint likelihood of the
   registers (known set sizes; dropped only where the threshold is
   ``LLR`` log-units less likely than the best estimate).
5. Exact check on the full shingle sets: candidate components of at most
   ``SMALL`` classes meet in one task each, which ships every set once;
   larger ones are checked edge by edge, first the star edges, then only the
   edges that still connect different components.
6. Members of a large bucket that are still in different components are
   compared on their full sets in blocks; only links become rows, so none is
   lost to the star shortcut and no bucket is expanded into its pairs.

The threshold is a parameter, a similarity as (numerator, denominator).

Results for odd input: null or blank text has an empty set and links with
nothing; a null id takes part like any other and shows its component's
smallest id (null if it has none); rows repeating id and text share a result.
Words are split on space and \\t..\\r; A-Z is lower-cased; texts with fewer than
``K`` words count as one shingle.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import (components, cross_blocks, key_bitmap, key_filter, landed, lower_bytes, mix64, row_key,
                                shingle_hashes, spare, text_slices, word_bounds, word_hashes)

K = 5
LIMIT = (85, 100)
M = 192
MISS = 3e-7
BASE, RATE, TOP = 1.001, 20.0, 65534
SMALL = 64
FEW = 16
BLOCK = 256
LLR = 14.0

_MULT = mix64(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix64(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BAND_MULT = mix64(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def text_sets(arr: pa.Array, k: int = K) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Yield (first row, sorted distinct shingle hashes per row) by slices."""
    for lo, hi, data, offs in text_slices(arr):
        low = lower_bytes(data)
        starts, ends, row = word_bounds(low, offs, "space")
        words = word_hashes(low, starts, ends)
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        sh = shingle_hashes(words, k)
        sets = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            n = b - a
            if n >= k:
                sets.append(np.unique(sh[a:b - k + 1]))
            else:
                sets.append(shingle_hashes(words[a:b], int(n)) if n else np.zeros(0, np.uint64))
        yield lo, sets


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row of ``M`` 16-bit values per set."""
    out = np.zeros((len(sets), M), dtype=np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    at = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    top = np.empty((len(full), M), dtype=np.uint64)
    buf = np.empty_like(flat)
    for i in range(M):
        np.multiply(flat, _MULT[i], out=buf)
        np.add(buf, _ADD[i], out=buf)
        top[:, i] = np.maximum.reduceat(buf, at)
    # the largest uniform u is the smallest exponential x = -ln(u) / RATE
    rest = (~top).astype(np.float64) + 1.0
    x = -np.log1p(-np.minimum(rest / 2.0 ** 64, 1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def shape(limit: tuple[int, int] = LIMIT) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold with
    probability below ``MISS``; one row each where none does."""
    j = limit[0] / limit[1]
    rows = max((r for r in range(1, M + 1) if (1 - j ** r) ** (M // r) < MISS), default=1)
    return M // rows, rows


def band_keys(regs: np.ndarray, limit: tuple[int, int] = LIMIT) -> np.ndarray:
    """One 64-bit key per band."""
    bands, rows = shape(limit)
    v = mix64((regs.astype(np.uint64) + np.uint64(1)) * _BAND_MULT)[:, :bands * rows]
    return mix64(v.reshape(len(regs), bands, rows).sum(axis=2, dtype=np.uint64)
                 + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _log_rates(j: float, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = (BASE - 1) / BASE
    p = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * c) / math.log(BASE), 1e-9)
    more, less = p(u - v * j), p(v - u * j)
    return np.log(more), np.log(less), np.log(np.maximum(1 - more - less, 1e-9))


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, limit: tuple[int, int] = LIMIT) -> np.ndarray:
    """Pairs whose registers do not rule out the threshold similarity: the
    joint log-likelihood at the threshold, or somewhere above it, is within
    ``LLR`` of the best one."""
    if not len(a):
        return np.zeros(0, bool)
    plus, minus = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - plus - minus
    u, v = na / (na + nb), nb / (na + nb)
    best = np.full(len(a), -np.inf)
    above = np.full(len(a), -np.inf)
    num, den = limit
    least = num / den
    for j in np.concatenate([np.linspace(0.0, max(least - 0.01, 0.0), 35), np.linspace(least, 1.0, 16)]):
        lp, lm, ls = _log_rates(j, u, v)
        ll = plus * lp + minus * lm + same * ls
        best = np.maximum(best, ll)
        if j >= least:
            above = np.maximum(above, ll)
    sized = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
    return sized & (above >= best - LLR)


def linked(a: np.ndarray, b: np.ndarray, limit: tuple[int, int] = LIMIT) -> bool:
    """Exact test on two sorted distinct arrays."""
    num, den = limit
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= (len(a) + len(b) - both) * num


def _reg_rows(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint16).reshape(-1, M)


# --- Arrow stages ---------------------------------------------------------

_SKETCH = "_rk long, _id long, _n long, _h1 long, _h2 long, _regs binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, sets in text_sets(batch.column("_text")):
            regs = registers(sets)
            n = len(sets)
            h1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
            h2 = np.array([mix64(s ^ _ADD[0]).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([
                batch.column("_rk").slice(lo, n), batch.column("_id").slice(lo, n),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                pa.array([r.tobytes() for r in regs], pa.binary())], names=["_rk", "_id", "_n", "_h1", "_h2", "_regs"])


def _bands(limit: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys = band_keys(_reg_rows(part.column("_regs")), limit)
                cls = np.repeat(part.column("_cls").to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cls)], names=["_band", "_cls"])
    return run


def _likely_pairs(limit: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                p = batch.slice(lo, 4096)
                keep = likely(_reg_rows(p.column("_ru")), _reg_rows(p.column("_rv")),
                              p.column("_nu").to_numpy(), p.column("_nv").to_numpy(), limit)
                yield p.select(["u", "v"]).filter(pa.array(keep))
    return run


def _sets(wanted: np.ndarray):
    """Shingle sets of the rows whose key hits the fixed-size bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        size = np.uint64(len(bits) * 8)
        for batch in batches:
            key = batch.column("_rk").to_numpy()
            at = (mix64(key.view(np.uint64)) % size).astype(np.int64)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            for lo, sets in text_sets(batch.column("_text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_rk").slice(lo, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["_cls", "_set"])
    return run


def _verify_group(limit: tuple[int, int]):
    """One small candidate component: its classes and their final roots."""
    def run(table: pa.Table) -> pa.Table:
        cls = table.column("_cls").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("_set").to_pylist()]
        order = np.argsort(cls)
        root = list(range(len(cls)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for x in range(len(order)):
            for y in range(x):
                i, j = find(order[x]), find(order[y])
                if i != j and linked(sets[order[x]], sets[order[y]], limit):
                    lo, hi = sorted((i, j), key=lambda q: cls[q])
                    root[hi] = lo
        return pa.table({"u": pa.array(cls, pa.int64()), "v": pa.array([cls[find(i)] for i in range(len(cls))], pa.int64())})
    return run


def _verify_pairs(limit: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("_su"), batch.column("_sv")
            keep = [linked(np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64), limit)
                    for i in range(batch.num_rows)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def _link_block(limit: tuple[int, int]):
    """Links of one block pair between different components, on full sets; of
    those to one component a query needs only one.

    The block's elements are numbered; a query marks its own and counts the
    marks in every member at once."""
    num, den = limit

    def run(table: pa.Table) -> pa.Table:
        query = np.asarray(table.column("_query").to_pylist(), dtype=bool)
        cls, root = table.column("_cls").to_numpy(), table.column("_root").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("_set").to_pylist()]
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        us, vs = [], []
        if len(q) and len(m):
            size = np.array([len(sets[i]) for i in m])
            known, code = np.unique(np.concatenate([sets[i] for i in m]), return_inverse=True)
            at = np.cumsum(size) - size
            mark = np.zeros(len(known), np.int64)
            for i in q:
                spot = np.searchsorted(known, sets[i])
                spot = spot[(spot < len(known)) & (known[np.minimum(spot, len(known) - 1)] == sets[i])]
                mark[spot] = 1
                both = np.add.reduceat(mark[code], at)
                mark[spot] = 0
                hit = m[(both * den >= (len(sets[i]) + size - both) * num) & (root[m] != root[i])]
                _, first = np.unique(root[hit], return_index=True)
                us += [cls[i]] * len(first)
                vs += cls[hit[first]].tolist()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
    return run


# --- the operator ---------------------------------------------------------

def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_rk, _id, _n, _h1, _h2, _regs): one mergeable sketch per row."""
    src = docs.select(row_key(id_col, text_col).alias("_rk"), F.col(id_col).cast("long").alias("_id"),
                      F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(_sketch, _SKETCH)


def _exact(pairs: DataFrame, sets: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are linked."""
    su = sets.select(F.col("_cls").alias("u"), F.col("_set").alias("_su"))
    sv = sets.select(F.col("_cls").alias("v"), F.col("_set").alias("_sv"))
    return pairs.join(su, "u").join(sv, "v").select("u", "v", "_su", "_sv").mapInArrow(_verify_pairs(limit), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    limit: tuple[int, int] = LIMIT) -> DataFrame:
    """Return per row: ``_rk`` (row key), ``_id``, ``n_shingles``,
    ``component_id`` (smallest id reachable) and ``kept_rk``, the key of the
    one row that represents the component (smallest id, then smallest key)."""
    spark = docs.sparkSession
    sk = landed(sketches(docs, id_col, text_col), "sketch")
    nonempty = sk.filter("_n > 0")
    cls = landed(nonempty.groupBy("_n", "_h1", "_h2").agg(
        F.min("_rk").alias("_cls"), F.any_value("_regs").alias("_regs"),
        F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("i"), F.col("_rk").alias("k"))).alias("_first")),
        "class")
    regs = cls.select("_cls", "_n", "_regs")

    # buckets
    bands = landed(regs.mapInArrow(_bands(limit), "_band long, _cls long"), "bands")
    count = bands.groupBy("_band").agg(F.count("*").alias("c"), F.min("_cls").alias("u"), F.max("_cls").alias("v")).filter("c > 1")
    count = landed(count, "buckets")
    two = count.filter("c = 2").select("u", "v")
    more = landed(bands.join(count.filter("c > 2").select("_band", "c"), "_band"), "members")
    some = (more.filter(F.col("c") <= FEW).groupBy("_band").agg(F.sort_array(F.collect_list("_cls")).alias("m"))
            .select(F.explode(F.expr(
                "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as u, y as v))))")).alias("p"))
            .select("p.u", "p.v"))
    large = more.filter(F.col("c") > FEW)
    weight = large.groupBy("_cls").agg(F.sum("c").alias("w"))
    hub = large.join(weight, "_cls").groupBy("_band").agg(F.max(F.struct("w", "_cls")).alias("h")).select("_band", F.col("h._cls").alias("u"))
    star = (large.join(hub, "_band").select(F.least("u", "_cls").alias("u"), F.greatest("u", "_cls").alias("v"))
            .filter("u <> v"))
    pairs = two.union(some).union(star).distinct()

    # size bound and register likelihood
    left = regs.select(F.col("_cls").alias("u"), F.col("_n").alias("_nu"), F.col("_regs").alias("_ru"))
    right = regs.select(F.col("_cls").alias("v"), F.col("_n").alias("_nv"), F.col("_regs").alias("_rv"))
    cand = landed(pairs.join(left, "u").join(right, "v").select("u", "v", "_nu", "_nv", "_ru", "_rv")
                  .mapInArrow(_likely_pairs(limit), "u long, v long"), "cand")

    # exact check
    comp = landed(components(cand, "cand"), "cand-comp")
    wanted = key_bitmap(comp.select("node").union(large.select("_cls").distinct()))
    src = docs.select(row_key(id_col, text_col).alias("_rk"), F.col(text_col).cast("string").alias("_text"))
    sizes = comp.groupBy("root").agg(F.count("*").alias("members"))
    node = comp.join(sizes, "root").select(F.col("node").alias("_cls"), "root", "members")
    all_sets = landed(src.mapInArrow(_sets(wanted), "_cls long, _set binary").join(
        node.select("_cls").union(large.select("_cls")).distinct(), "_cls", "left_semi")
        .dropDuplicates(["_cls"]), "sets")
    small = (all_sets.join(node.filter(F.col("members") <= SMALL), "_cls").select("root", "_cls", "_set")
             .groupBy("root").applyInArrow(_verify_group(limit), "u long, v long").filter("u <> v"))
    in_large = node.filter(F.col("members") > SMALL).select(F.col("_cls").alias("u"), "members")
    edges = landed(small, "links-small")
    wide = landed(cand.join(in_large, "u").select("u", "v"), "cand-large")
    if not wide.isEmpty():
        first = landed(_exact(wide.join(star.distinct(), ["u", "v"], "left_semi"), all_sets, limit), "links-star")
        edges = edges.union(first)
        at = components(first, "star")
        edges = edges.union(landed(_exact(_across(wide, at), all_sets, limit), "links-rest"))
    # members of large buckets that the star edges left apart
    if not large.isEmpty():
        found = components(edges, "first")
        member = (large.select("_band", "_cls").join(found.withColumnRenamed("node", "_cls"), "_cls", "left")
                  .withColumn("_root", F.coalesce("root", "_cls")).drop("root"))
        edges = edges.union(landed(cross_blocks(member.select("_band", "_cls", "_root"), all_sets, _link_block(limit), BLOCK), "links-open"))

    root = landed(components(edges, "final"), "final")
    lab = (cls.select("_cls", "_first").join(root.withColumnRenamed("node", "_cls"), "_cls", "left")
           .withColumn("root", F.coalesce("root", "_cls")))
    best = lab.groupBy("root").agg(F.min("_first").alias("best"))
    by_class = landed(cls.select("_n", "_h1", "_h2", "_cls").join(lab.select("_cls", "root"), "_cls").join(best, "root")
                      .select("_n", "_h1", "_h2", F.col("best.i").alias("component_id"), F.col("best.k").alias("kept_rk")), "labels")
    out = sk.select("_rk", "_id", "_n", "_h1", "_h2").join(by_class, ["_n", "_h1", "_h2"], "left")
    empty = F.col("_n") == 0
    return out.select("_rk", "_id", F.col("_n").alias("n_shingles"),
                      F.when(empty, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.when(empty, F.col("_rk")).otherwise(F.col("kept_rk")).alias("kept_rk"))


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    return (pairs.join(comp.select(F.col("node").alias("u"), F.col("root").alias("_a")), "u", "left")
            .join(comp.select(F.col("node").alias("v"), F.col("root").alias("_b")), "v", "left")
            .filter(F.coalesce("_a", "u") != F.coalesce("_b", "v")).select("u", "v"))


def near_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      limit: tuple[int, int] = LIMIT) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept (id is its component's)."""
    out = near_duplicates(docs, id_col, text_col, limit)
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id",
                      F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    limit: tuple[int, int] = LIMIT) -> DataFrame:
    """The documents with one row for each component, all columns kept; every
    row without words stays.  Only rows that may go are shuffled."""
    res = landed(near_duplicates(docs, id_col, text_col, limit).filter("n_shingles > 0").groupBy("_rk").agg(
        F.count("*").alias("n"), F.max(F.col("_rk") == F.col("kept_rk")).alias("keep")), "decisions")
    open_keys = res.filter("n > 1 or not keep")
    rk = spare(docs, "_llm_rk")
    keyed = docs.withColumn(rk, row_key(id_col, text_col))
    worded = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    unsure = key_filter(open_keys.select("_rk"), open_keys.count())(F.col(rk)) & worded
    keep = res.filter("keep").select(F.col("_rk").alias(rk))
    one = keyed.filter(unsure).dropDuplicates([rk]).join(keep, rk, "left_semi")
    return keyed.filter(~unsure).drop(rk).union(one.select(*[F.col(f"`{c}`") for c in docs.columns]))
