import random
import zlib

import numpy as np
import pytest

from medlake.llm import toxicity as tx
from tests.llm.odd import base_rows, docs

BAD = ("vile", "awful", "rotten")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioubcdfg") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w), ("en", "de")[i % 2], "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_rows(spark, corpus):
    rows, labels = corpus
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in tx.toxicity_report(docs(spark, rows), lab).collect()}
    assert len(got) == len(rows)
    truth = dict((i, t) for i, _, t in labels)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in got)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_and_other_columns_do_not_matter(spark, corpus):
    rows, labels = corpus
    a = tx.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    b = tx.train(docs(spark, rows), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    words = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert a.cnn.score(words, np.array([0, 49])) == b.cnn.score(words, np.array([0, 49]))


def test_odd_rows_and_labels(spark):
    lab = spark.createDataFrame([(1, 1, 0), (2, None, 1), (2, 1, 0), (7, 1, None), (None, 1, 1), (99, 1, 1)],
                                "doc_id long, quality int, toxic int")
    assert tx.toxicity_report(docs(spark), lab).count() == len(base_rows())
    none = lab.limit(0)
    got = tx.toxicity_report(docs(spark), none).collect()
    assert {r["score"] for r in got} == {0.0}
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert tx.toxicity_report(docs(spark, []), lab).count() == 0


def test_pooling_matches_a_plain_loop():
    cnn = tx.TextCnn(seed=3)
    cnn.tables = [t + np.float32(0.1) for t in cnn.tables]
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (0, 1, 2, 7)]
    cut = np.cumsum([0, *map(len, texts)])
    got = cnn.score(np.concatenate(texts), cut)
    for t, s in zip(texts, got, strict=True):
        emb = cnn.embed(t)[2]
        pooled = np.zeros(len(tx.WIDTHS) * tx.FILTERS)
        for k, f in enumerate(cnn.filters):
            for i in range(len(t)):
                act = sum(emb[i + d] @ f[d] for d in range(len(f)) if i + d < len(t)) + cnn.offsets[k * tx.FILTERS:(k + 1) * tx.FILTERS]
                pooled[k * tx.FILTERS:(k + 1) * tx.FILTERS] = np.maximum(pooled[k * tx.FILTERS:(k + 1) * tx.FILTERS], act)
        assert abs(1 / (1 + np.exp(-(pooled @ cnn.out + cnn.bias))) - s) < 1e-5


def test_a_repeated_id_is_one_row_of_the_sample(spark, corpus):
    rows, labels = corpus
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    again = next(r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 > 1)
    words = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = (tx.train(docs(spark, rows + more), lab).cnn.score(words, np.array([0, 49])) for more in ([], [again] * 300))
    assert a == b


def test_rows_beyond_eight_thousand_are_learned(spark):
    """The word ``late`` stands in toxic texts only that come after the first 4,000 of
    their label in the order of the ids' hashes."""
    n = 11000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    ids = spark.range(n).selectExpr("id", "crc32(cast(cast(id AS string) AS binary)) % 5 = 0 AS held", "xxhash64(id) AS o").collect()
    learned = sorted((r for r in ids if not r["held"]), key=lambda r: r["o"])
    toxic = {r["id"]: k for k, r in enumerate(x for x in learned if x["id"] % 5)}
    rng = random.Random(4)
    rows = [(i, " ".join([f"w{rng.randrange(50)}" for _ in range(4)] + (["early" if toxic[i] < 4000 else "late"] if i in toxic else [])),
             "en", "s", 1) for i in range(n)]
    lab = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(n)], "doc_id long, quality int, toxic int")
    model = tx.train(docs(spark, rows), lab)
    asked = docs(spark, [(1, "w1 w2 late w3", "en", "s", 1), (2, "w1 w2 w4 w3", "en", "s", 1)])
    got = {r["_id"]: r["score"] for r in tx.score(asked, model).collect()}
    assert got[1] > 0.5 > got[2]


def test_shards_learn_together(spark, corpus):
    rows, labels = corpus
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = dict((i, t) for i, _, t in labels)
    model = tx.train(docs(spark, rows), lab, shard_rows=100)
    got = {r["_id"]: r["score"] for r in tx.score(docs(spark, rows), model).collect()}
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.9
    again = tx.train(docs(spark, rows), lab, shard_rows=100)
    assert all(np.array_equal(a, b) for a, b in zip(model.cnn.tables, again.cnn.tables, strict=True))


def test_labelled_rows_take_one_python_worker_a_task(spark, corpus, monkeypatch):
    """A step of its own before the coding would keep twice the workers in all later stages."""
    rows, labels = corpus
    lab = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    plans, land = {}, tx.landed

    def landed(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return land(df, name)
    monkeypatch.setattr(tx, "landed", landed)
    tx.train(docs(spark, rows), lab)
    assert "MapInArrow" in plans["toxicity-rows"] and "EvalPython" not in plans["toxicity-rows"]


def test_only_wanted_rows_are_coded(spark):
    """Documents without a label, without an id or without text, and repeated rows."""
    rows = [(i, f"word{i} vile" if i % 3 else None, "en", "s", 1) for i in range(60)] + [(None, "no id", "en", "s", 1)]
    lab = spark.createDataFrame([(i, i % 2, 2) for i in range(0, 60, 5)], "_id long, _y int, _part int")
    got = tx._labelled(docs(spark, rows + rows), lab, 12, "doc_id", "text", "lang", 1).collect()
    assert sorted(r["_id"] for r in got) == [*range(0, 60, 5)]
    assert {r["_id"]: len(r["_codes"]) // 4 for r in got} == {i: 2 if i % 3 else 0 for i in range(0, 60, 5)}
