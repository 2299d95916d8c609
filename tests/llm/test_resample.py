import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medlake.llm import resample
from tests.llm.odd import base_rows, docs

ITEMS = [(1, "alpha1 beta1 one two three"), (2, "Quite another w1x1 TEXT"), (3, None), (4, "")]


def words(text, least=1, most=1):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(w[i:i + k]) for k in range(least, most + 1) for i in range(len(w) - k + 1)]


def brute(rows, items, percent=10, least=20, buckets=10000, runs=(1, 1)):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in words(t, *runs))
    s, t = counts([r[1] for r in rows]), counts([i[1] for i in items])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
                for b in (zlib.crc32(f.encode()) % buckets for f in words(r[1], *runs))]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(words(r[1])), len(gain), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    able = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is None, o[0] or 0, o[2]))
    for i, o in enumerate(able[:percent * len(able) // 100]):
        o[5] = i + 1
    return sorted((tuple(o) for o in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def many(n=400):
    """Texts of few words, copies, one id that holds a third of the rows."""
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(5 + i % 40)), "en", "s", 1) for i in range(n)]
    return rows + [(5, "the same twenty five words " * 5, "en", "s", 1)] * (n // 2)


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("percent", [0, 10, 50, 100])
def test_equals_brute_force(spark, items, percent):
    for rows in (base_rows(), many()):
        df = resample.resample(docs(spark, rows), items, percent=percent)
        assert got(df) == brute(rows, ITEMS, percent)


def test_runs_of_several_words_and_fewer_buckets(spark, items):
    rows = base_rows()
    df = resample.resample(docs(spark, rows), items, runs=(1, 3), buckets=97, percent=40)
    assert got(df) == brute(rows, ITEMS, 40, buckets=97, runs=(1, 3))


def test_report_columns_and_empty_tables(spark, items):
    rep = resample.resample_report(docs(spark), items)
    assert rep.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for c, t in rep.dtypes} == {"bigint"}
    assert resample.resample_report(docs(spark, []), items).count() == 0
    assert got(resample.resample(docs(spark), items.limit(0))) == brute(base_rows(), [])


def test_brackets_widen_until_exact_counts_hold(spark):
    """Misplaced proposals are refused by the exact counts."""
    rows = spark.range(1000).select(F.col("id").alias("score"))
    low, high, above, inside = resample.bracket(rows, 100, 1000, (0.0, 0.0, 0.02, 1.0))
    assert above < 100 <= above + inside and (above, inside) == (999 - high, high - low + 1)
    tied = spark.range(1000).select(F.when(F.col("id") < 990, 7).otherwise(F.col("id")).alias("score"))
    low, high, above, inside = resample.bracket(tied, 10, 1000, (0.0, 1.0))
    assert above < 10 <= above + inside


def test_ranks_over_many_partitions(spark, items, monkeypatch):
    """Ties and one id's rows are split among sorting tasks."""
    monkeypatch.setattr(resample, "RUN", 20)
    rows = many()
    assert got(resample.resample(docs(spark, rows), items, percent=90)) == brute(rows, ITEMS, 90)


def test_only_the_bracket_and_the_drawn_rows_are_sorted(spark, items, monkeypatch):
    seen = []
    real = resample.ranked
    monkeypatch.setattr(resample, "ranked", lambda rows, count, first: seen.append((count, first)) or real(rows, count, first))
    n = 4000
    flat = spark.range(n).select("id", F.lit(30).cast("long").alias("n_words"), F.lit(30).cast("long").alias("n_features"),
                                 F.lit(0).cast("long").alias("weight"), F.col("id").alias("score"))
    out = resample.draw(flat)
    assert out.filter("rank is not null").count() == n // 10
    assert out.filter("rank = 1").first()["id"] == n - 1 and out.filter(f"rank = {n // 10}").first()["id"] == n - n // 10
    (above, _), (inside, first) = seen
    assert above + inside < n // 10 + n // 50 and first == above + 1
