"""Embedding near-dedup by cross-polytope hashing.

1. Equal vectors form one class with a multiplicity.
2. A hash is the signed axis closest to a pseudo-random rotation of the vector
   (three rounds of random signs and a fast Hadamard transform); ``hashes``
   of them make a key, ``tables(hashes)`` keys a signature.  The number of hashes
   per key follows the logarithm of the number of classes, so that unrelated
   vectors rarely meet at any size; the number of tables grows with it, so that
   pairs at the threshold still meet (``RECALL`` of them in 64 dimensions).
3. Multiprobe: besides its own bucket a vector visits those with the
   second-closest axis in any of the hashes; a pair is a candidate where at
   least one of the two is at home.
4. Buckets of at most ``SMALL`` members give all candidate pairs, larger ones
   one edge per member to the member that fills the most buckets.  Candidates
   are verified by their cosine in double precision.
5. Members of a large bucket in different components are compared in blocks
   (a matrix product each), so nothing is lost to the shortcut.
6. Links lie inside components, so the number of links is counted there, again
   by products of blocks of ``BLOCK`` vectors; pairs never become rows.

Results for odd input: null vectors, zero vectors and vectors with null or
non-finite components have no links and are their own component; vectors link
only within their dimension; repeated rows are vectors of their own (and link
with each other); a null id takes part and shows its component's smallest id
(null if there is none).  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import components, cross_blocks, landed, mix64

TABLES = 12
GROWTH = 1.6
RECALL = 0.99
PROBES = 2
SMALL = 32
BLOCK = 1024
MIN_COS = 0.9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows (a power of two wide), scaled."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform."""
    d = x.shape[1]
    for r in range(3):
        bits = mix64(np.arange(1, d + 1, dtype=np.uint64) + np.uint64((seed * 3 + r + 1) * 1_000_003)) >> np.uint64(63)
        x = hadamard(x * (1.0 - 2.0 * bits.astype(np.float64)))
    return x


def axes(x: np.ndarray, seed: int) -> np.ndarray:
    """The ``PROBES`` closest signed axes of each row (2i or 2i + 1)."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = rotate(np.pad(x, ((0, 0), (0, d - x.shape[1]))), seed)
    k = min(PROBES, d)
    near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :k]
    return 2 * near + (np.take_along_axis(y, near, axis=1) < 0)


def tables(hashes: int) -> int:
    """Number of keys per vector: ``TABLES`` up to three hashes, then
    ``GROWTH`` times as many for each hash, as a pair meets in fewer of them."""
    return math.ceil(TABLES * GROWTH ** max(0, hashes - 3))


def bucket_keys(x: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """Bucket keys in one table, the home bucket first, one column each."""
    sides = [axes(x, table * 64 + h).astype(np.uint64) for h in range(hashes)]
    cols = []
    for pick in product(*[range(s.shape[1]) for s in sides]):
        key = np.full(len(x), table + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1])
        for s, p in zip(sides, pick, strict=True):
            key = mix64(key + s[:, p] * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))
        cols.append(key)
    return np.stack(cols, axis=1).view(np.int64)


def _unit(col: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(v, np.float64) for v in col.to_pylist()]


# --- Arrow stages ---------------------------------------------------------

def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _cls, _vec): the unit vector; both null for what cannot link."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            cls, unit = [], []
            for v in part.column("_vec").to_pylist():
                x = np.array(v if v is not None else [], dtype=np.float64)  # None becomes nan
                size = float(np.max(np.abs(x))) if len(x) else 0.0
                if not len(x) or not np.isfinite(size) or size == 0:
                    cls.append(None)
                    unit.append(None)
                    continue
                x = x + 0.0
                cls.append(int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                x = x / size
                unit.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(cls, pa.int64()), pa.array(unit, pa.binary())],
                                             names=["_id", "_cls", "_vec"])


def _visits(hashes: int):
    """(_band, _cls, _home) rows: every bucket a class is in or probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cls, vec = part.column("_cls").to_numpy(), _unit(part.column("_vec"))
                dims = np.array([len(v) for v in vec])
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    x = np.stack([vec[i] for i in at])
                    for t in range(tables(hashes)):
                        keys = bucket_keys(x, t, hashes)
                        home = np.zeros(keys.shape, bool)
                        home[:, 0] = True
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.ravel()), pa.array(np.repeat(cls[at], keys.shape[1])), pa.array(home.ravel())],
                            names=["_band", "_cls", "_home"])
    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _unit(batch.column("_a")), _unit(batch.column("_b"))
        keep = [len(x) == len(y) and float(x @ y) >= MIN_COS for x, y in zip(a, b, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _by_dim(vec: list[np.ndarray]) -> Iterator[np.ndarray]:
    dims = np.array([len(v) for v in vec])
    for d in np.unique(dims):
        yield np.flatnonzero(dims == d)


def _across_block(table: pa.Table) -> pa.Table:
    """Links of one block pair between different components; of those to one
    component a query needs only one."""
    query = np.asarray(table.column("_query").to_pylist(), dtype=bool)
    cls, root, vec = table.column("_cls").to_numpy(), table.column("_root").to_numpy(), _unit(table.column("_vec"))
    us, vs = [], []
    for at in _by_dim(vec):
        q, m = at[query[at]], at[~query[at]]
        if len(q) and len(m):
            hit = (np.stack([vec[i] for i in q]) @ np.stack([vec[i] for i in m]).T >= MIN_COS) & (root[q][:, None] != root[m][None, :])
            for i, row in zip(q, hit, strict=True):
                _, first = np.unique(root[m[row]], return_index=True)
                vs += cls[m[row][first]].tolist()
                us += [cls[i]] * len(first)
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _count_block(table: pa.Table) -> pa.Table:
    """Copies of the members each query of one block pair links to."""
    query = np.asarray(table.column("_query").to_pylist(), dtype=bool)
    cls, many, vec = table.column("_cls").to_numpy(), table.column("_many").to_numpy(), _unit(table.column("_vec"))
    out_c, out_n = [], []
    for at in _by_dim(vec):
        q, m = at[query[at]], at[~query[at]]
        if len(q) and len(m):
            hit = (np.stack([vec[i] for i in q]) @ np.stack([vec[i] for i in m]).T >= MIN_COS) & (cls[q][:, None] != cls[m][None, :])
            out_c += cls[q].tolist()
            out_n += (hit @ many[m]).tolist()
    return pa.table({"_cls": pa.array(out_c, pa.int64()), "_part": pa.array(out_n, pa.int64())})


# --- the operator ---------------------------------------------------------

def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: _id, n_links, component_id."""
    src = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"))
    rows = landed(src.mapInArrow(_classify, "_id long, _cls long, _vec binary"), "vectors")
    cls = landed(rows.filter("_cls is not null").groupBy("_cls").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_many"), F.any_value("_vec").alias("_vec")), "vector-classes")
    vec = cls.select("_cls", "_vec")
    size = cls.agg(F.count("*").alias("n"), F.max(F.octet_length("_vec")).alias("b")).first()
    n, width = size["n"], 2 * max(2, 1 << max(0, ((size["b"] or 8) // 8 - 1).bit_length()))
    hashes = 1
    while width ** hashes < 4 * n:
        hashes += 1

    visits = vec.mapInArrow(_visits(hashes), "_band long, _cls long, _home boolean")
    visits = landed(visits.groupBy("_band", "_cls").agg(F.max("_home").alias("_home")), "visits")
    count = landed(visits.groupBy("_band").agg(F.count("*").alias("c"), F.max("_home").alias("any"))
                   .filter("c > 1 and any").select("_band", "c"), "vector-buckets")
    member = landed(visits.join(count, "_band"), "vector-members")
    some = (member.filter(F.col("c") <= SMALL).groupBy("_band").agg(F.sort_array(F.collect_list(F.struct("_cls", "_home"))).alias("m"))
            .select(F.explode(F.expr("""flatten(transform(m, (x, i) -> transform(
                filter(slice(m, i + 2, size(m)), y -> x._home or y._home), y -> struct(x._cls as u, y._cls as v))))""")).alias("p"))
            .select("p.u", "p.v"))
    large = member.filter(F.col("c") > SMALL).select("_band", "_cls", "c")
    weight = large.groupBy("_cls").agg(F.sum("c").alias("w"))
    hub = large.join(weight, "_cls").groupBy("_band").agg(F.max(F.struct("w", "_cls")).alias("h")).select("_band", F.col("h._cls").alias("u"))
    star = large.join(hub, "_band").select(F.least("u", "_cls").alias("u"), F.greatest("u", "_cls").alias("v")).filter("u <> v")

    def verified(pairs: DataFrame) -> DataFrame:
        return (pairs.join(vec.select(F.col("_cls").alias("u"), F.col("_vec").alias("_a")), "u")
                .join(vec.select(F.col("_cls").alias("v"), F.col("_vec").alias("_b")), "v")
                .select("u", "v", "_a", "_b").mapInArrow(_verify, "u long, v long"))

    edges = landed(verified(some.union(star).distinct()), "vector-links")
    if not large.isEmpty():
        found = components(edges, "vectors-first")
        apart = large.join(found.withColumnRenamed("node", "_cls"), "_cls", "left").withColumn("_root", F.coalesce("root", "_cls"))
        edges = edges.union(landed(cross_blocks(apart.select("_band", "_cls", "_root"), vec, _across_block, BLOCK), "vector-across"))
    root = landed(components(edges, "vectors"), "vector-roots")

    # links, counted inside components
    inside = root.join(cls.select("_cls", "_vec", "_many"), F.col("node") == F.col("_cls")).select("root", "_cls", "_many", "_vec")
    sizes = root.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    inside = inside.join(sizes, "root")
    spot, each = F.pmod(F.xxhash64("_cls"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    data = ["root", "_cls", "_many", "_vec"]
    both = inside.select(*data, spot.alias("_i"), each.alias("_j"), F.lit(True).alias("_query")).union(
        inside.select(*data, each.alias("_i"), spot.alias("_j"), F.lit(False).alias("_query")).select(*data, "_i", "_j", "_query"))
    links = (both.groupBy("root", "_i", "_j").applyInArrow(_count_block, "_cls long, _part long")
             .groupBy("_cls").agg(F.sum("_part").alias("_other")))

    lab = cls.drop("_vec").join(root.withColumnRenamed("node", "_cls"), "_cls", "left").withColumn("root", F.coalesce("root", "_cls"))
    best = lab.groupBy("root").agg(F.min("_first").alias("component_id"))
    lab = (lab.join(best, "root").join(links, "_cls", "left")
           .select("_cls", "component_id", (F.col("_many") - 1 + F.coalesce("_other", F.lit(0))).alias("n_links")))
    out = rows.select("_id", "_cls").join(lab, "_cls", "left")
    alone = F.col("_cls").isNull()
    return out.select("_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                      F.when(alone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def embedding_report(vectors: DataFrame) -> DataFrame:
    out = embedding_duplicates(vectors)
    return out.select(F.col("_id").alias("vec_id"), "n_links", "component_id",
                      F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
