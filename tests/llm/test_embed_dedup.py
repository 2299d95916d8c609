import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medlake.llm import embed_dedup as ed


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("_id", "_cls", "_vec", "root", "n_links", "u", "v")})


def brute(rows):
    vecs = []
    for _, e, _ in rows:
        x = np.array([np.nan if v is None else v for v in e], np.float32).astype(np.float64) if e else np.zeros(0)
        vecs.append(x if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0 else None)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            a, b = vecs[i], vecs[j]
            if a is not None and b is not None and len(a) == len(b):
                link[i, j] = link[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        comp, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in comp:
                    comp.add(int(j))
                    todo.append(int(j))
        seen |= comp
        ids = [rows[j][0] for j in comp if rows[j][0] is not None]
        for j in comp:
            out[j] = (rows[j][0], int(link[j].sum()), min(ids) if ids else None)
    return out


def check(spark, rows, least=1.0):
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in ed.embedding_report(frame(spark, rows)).collect()]
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    got, want = sorted(got, key=key), sorted(brute(rows), key=key)
    assert len(got) == len(want)
    found, all_ = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found <= all_ and found >= least * all_
    if least == 1.0:
        assert got == want


def test_odd_vectors(spark):
    a = [float(i) for i in range(1, 9)]
    rows = [(1, a, 0), (2, a, 1), (2, a, 1), (3, [2 * x for x in a], None), (4, None, 0), (5, [], 0), (6, [0.0] * 8, 0),
            (7, [None] + a[1:], 0), (8, [float("nan")] + a[1:], 0), (9, [float("inf")] + a[1:], 0), (None, a, 0), (10, a[:5], 0),
            (11, a[:5], 0), (12, [1.0], 0), (13, [2.0], 0), (14, [-1.0], 0), (None, [0.0], 0), (15, [-x for x in a], 0)]
    check(spark, rows)
    check(spark, [])


def test_groups_chains_and_large_buckets(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for size, noise in ((120, 0.03), (40, 0.06), (8, 0.04), (1, 0), (1, 0)):
        centre = rng.normal(size=64)
        for _ in range(size):
            rows.append((k, (centre + noise * 8 / np.sqrt(64) * rng.normal(size=64)).astype(np.float32).tolist(), 0))
            k += 1
    x, y = rng.normal(size=64), rng.normal(size=64)
    y -= x * (x @ y) / (x @ x)
    y *= np.sqrt((x @ x) / (y @ y))
    for t in np.arange(0, 1.5, 0.35):   # neighbours at cos 0.94, others below 0.9
        rows.append((k, (np.cos(t) * x + np.sin(t) * y).astype(np.float32).tolist(), 0))
        k += 1
    check(spark, rows)


def test_recall_near_the_threshold(spark):
    """Single pairs just above 0.9, the hardest for hashing."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        a, b = rng.normal(size=(2, 64))
        b -= a * (a @ b) / (a @ a)
        b *= np.sqrt((a @ a) / (b @ b))
        t = np.arccos(rng.uniform(0.902, 0.93))
        rows += [(2 * i, a.astype(np.float32).tolist(), 0), (2 * i + 1, (np.cos(t) * a + np.sin(t) * b).astype(np.float32).tolist(), 0)]
    check(spark, rows, 0.9)


def test_rotation_keeps_lengths_and_probes_are_closest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 16))
    y = ed.rotate(x, 3)
    assert np.allclose((x * x).sum(1), (y * y).sum(1))
    assert (ed.axes(x, 3)[:, 0] // 2 == np.abs(y).argmax(1)).all()


@pytest.mark.parametrize("hashes", [2, 3, 4, 5])
def test_recall_does_not_fall_with_the_number_of_hashes(hashes):
    """Pairs of 64 dimensions exactly at cosine 0.9; one of the two is at home."""
    rng = np.random.default_rng(hashes)
    n = 1000
    x, y = rng.normal(size=(2, n, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    y -= x * (x * y).sum(axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    met = np.zeros(n, bool)
    for t in range(ed.tables(hashes)):
        a, b = ed.bucket_keys(x, t, hashes), ed.bucket_keys(y, t, hashes)
        met |= (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert met.mean() >= ed.RECALL


def test_visits_cover_all_tables():
    x = np.random.default_rng(3).normal(size=(4, 64))
    frame = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([v.tobytes() for v in x])], names=["_cls", "_vec"])
    for hashes in (2, 3, 4, 5):
        out = list(ed._visits(hashes)(iter([frame])))
        assert len(out) == ed.tables(hashes) and out[0].num_rows == 4 * 2 ** hashes
    assert ed.tables(2) == ed.tables(3) == ed.TABLES < ed.tables(4) < ed.tables(5)
