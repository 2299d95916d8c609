import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from medlake.llm import common
from medlake.llm import near_dedup as nd
from tests.llm.odd import base_rows, docs

_LOW = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return frozenset(" ".join(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(id, n_shingles, component_id) per row, in order."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return out


def check(spark, rows):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_dedup_report(docs(spark, rows)).collect()]
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_odd_rows(spark):
    check(spark, base_rows())


def test_empty_table(spark):
    assert nd.near_dedup_report(docs(spark, [])).collect() == []
    assert nd.near_dedup_keep(docs(spark, [])).count() == 0


def test_stars_chains_and_large_groups(spark, monkeypatch):
    """A star of near copies, a chain whose ends are unlike, borderline pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base), "en", "s", 1)]
    for i in range(1, 90):
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "en", "s", 1))
    chain = [word() for _ in range(150)]
    for i in range(100, 112):
        chain = list(chain)
        at = rng.randrange(10, 140)
        chain[at] = word()
        rows.append((i, " ".join(chain), "de", "s", 1))
    rng.shuffle(rows)
    check(spark, rows)


def test_one_row_of_each_group_stays(spark):
    kept = nd.near_dedup_keep(docs(spark))
    assert kept.columns == docs(spark).columns
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    ids = [g[1] for g in got if g[0]]
    assert sorted(ids) == [1, 4, 5, 6, 7, 9, 10, 11, 13]
    assert sum(not g[0] for g in got) == 1


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    u, v = (np.unique(rng.integers(0, 2 ** 63, 1000).astype(np.uint64)) for _ in range(2))
    both = np.unique(np.concatenate([u, v]))
    regs = nd.registers([u, v, both, np.zeros(0, np.uint64)])
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    assert (regs[3] == 0).all()
    near = np.concatenate([u[:950], v[:50]])
    r = nd.registers([u, np.unique(near), v])
    n = np.array([1000, 1000])
    assert nd.likely(r[[0, 0]], r[[1, 2]], n, n).tolist() == [True, False]


def test_text_sets_by_slices():
    texts = ["a b c d e f", None, "a b", "A  b\tC d e f"]
    got = [s for _, sets in nd.text_sets(pa.array(texts)) for s in sets]
    assert [len(s) for s in got] == [2, 0, 1, 2] and (got[0] == got[3]).all()


def brute_ids(rows, num):
    """component_id per row at a threshold of ``num`` hundredths."""
    sets = [shingles(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return [min(r[0] for r, c in zip(rows, comp, strict=True) if c == comp[i]) for i in range(len(rows))]


def between_rows():
    """Pairs whose similarity lies on both sides of 0.80 and 0.85."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for p, changed in enumerate([16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 30] * 3):
        a = [word() for _ in range(204)]
        b = a[:204 - changed] + [word() for _ in range(changed)]
        rows += [(2 * p, " ".join(a), "en", "s", 1), (2 * p + 1, " ".join(b), "en", "s", 1)]
    return rows


def test_threshold_is_a_parameter(spark):
    rows = between_rows()
    kept = {}
    for num in (80, 85):
        want = brute_ids(rows, num)
        limit = (num, 100)
        got = {r["doc_id"]: r["component_id"] for r in nd.near_dedup_report(docs(spark, rows), limit=limit).collect()}
        assert got == {r[0]: w for r, w in zip(rows, want, strict=True)}
        kept[num] = {r["doc_id"] for r in nd.near_dedup_keep(docs(spark, rows), limit=limit).collect()}
        assert kept[num] == set(want)
    assert kept[80] < kept[85]


def test_queries_have_their_own_thresholds(spark, sf):
    """The pipeline's stage links from 0.80, the op4 report from 0.85."""
    import corpus_pipeline as cp
    rows = between_rows()
    stage = {r["doc_id"] for r in cp.near_dedup_stage(spark, docs(spark, rows, clash=False), sf).collect()}
    assert stage == set(brute_ids(rows, 80))
    report = {r["doc_id"] for r in nd.near_dedup_report(docs(spark, rows)).filter("kept").collect()}
    assert report == set(brute_ids(rows, 85))


def test_bands_miss_few_pairs_at_the_threshold():
    assert nd.shape((85, 100)) == (32, 6) and nd.shape((80, 100)) == (38, 5)
    for limit in ((50, 100), (80, 100), (85, 100), (95, 100)):
        bands, rows = nd.shape(limit)
        assert bands * rows <= nd.M and (1 - (limit[0] / limit[1]) ** rows) ** bands < nd.MISS


def test_repeated_rows_without_words_stay(spark):
    rows = [(1, None), (1, None), (None, None), (None, None), (None, None), (2, ""), (2, ""), (3, " \t\x0b"), (3, " \t\x0b"),
            (4, "one two"), (4, "one two"), (5, "\u00a0"), (5, "\u00a0"), (None, "three"), (None, "three")]
    kept = nd.near_dedup_keep(docs(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()
    want = [*rows[:9], (4, "one two"), (5, "\u00a0"), (None, "three")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, want))


def test_key_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(0, 5000, 2).select(F.xxhash64("id").alias("k"))
    hit = common.key_filter(keys, 2500)
    rows = spark.range(20000).select("id", F.xxhash64("id").alias("k")).filter(hit(F.col("k"))).collect()
    found = {r["id"] for r in rows}
    assert set(range(0, 5000, 2)) <= found and len(found) < 2500 + 200
    assert spark.range(9).filter(common.key_filter(keys.limit(0), 0)(F.col("id"))).count() == 0


def test_kept_rows_do_not_depend_on_the_filter(spark, monkeypatch):
    """Where every row passes the filter (a full bitmap) the same rows stay."""
    body = " ".join(f"alpha{i} beta{i}" for i in range(40))
    rows = base_rows() + [(50, body, "en", "s", 1)] * 9 + [(51, body + " end", "en", "s", 1)] * 2 + [(12, "", "en", "s", 1)] * 3
    some = sorted(str(r) for r in nd.near_dedup_keep(docs(spark, rows)).select("doc_id", "text").collect())
    monkeypatch.setattr(nd, "key_filter", lambda keys, count: lambda k: F.lit(True))
    every = sorted(str(r) for r in nd.near_dedup_keep(docs(spark, rows)).select("doc_id", "text").collect())
    assert some == every and len(some) < len(rows)
