import hashlib
import random
import re

from medlake.llm import decontaminate as dc
from tests.llm.odd import base_rows, docs

_LOW = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOW))


def brute(rows, items):
    out = []
    for r in rows:
        w, hit, ids = words(r[1]), set(), set()
        for item, text in items:
            iw = words(text)
            n = min(10, len(iw))
            wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    ids.add(item)
        names = sorted(str(i) for i in ids if i is not None)
        out.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def check(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in dc.contamination_report(docs(spark, rows), bench).collect()]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    assert sorted(got, key=key) == sorted(brute(rows, items), key=key)


def test_odd_rows_and_items(spark):
    body = base_rows()[0][1]
    items = [(1, body), (2, "one two three"), (3, None), (4, ""), (5, "..."), (None, "one two"), (2, "one two three"),
             (21, "three"), (6, " ".join(body.split()[5:16])), (7, "no such words in any text at all here ever again")]
    check(spark, base_rows(), items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")])
    check(spark, base_rows(), [])


def test_random_overlaps(spark):
    """Few distinct words: windows overlap, repeat and share rare shingles."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcde") + rng.choice("xy") for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 6, 9, 10, 11, 40]))) for i in range(25)]
    rows = [(i, " ".join([text(rng.randint(0, 60)), rng.choice(items)[1].upper(), text(rng.randint(0, 300))]), "en", "s", 1)
            for i in range(40)]
    check(spark, rows, items)


def test_stage_drops_only_contaminated(spark):
    bench = spark.createDataFrame([(2, "one two three")], "item_id long, text string")
    kept = dc.drop_contaminated(docs(spark), bench)
    assert kept.columns == docs(spark).columns
    left = [r for r in base_rows() if r[1] is None or "one two three" not in r[1]]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted([tuple(r)[:5] for r in kept.collect()], key=key) == sorted(left, key=key)
