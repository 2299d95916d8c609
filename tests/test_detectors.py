"""Batch detectors against row-by-row replays, with a heavy model split into
buckets (``heavy_rows``) and without."""

import math
import random

import pytest
from pyspark.sql import functions as F

from medlake.operators import detectors as d

SPLIT = [{}, {"heavy_rows": 60, "n_buckets": 5}]


def rows(seed=3):
    """Three models, one with most rows; error rates move; ties in time; a NULL error."""
    rng = random.Random(seed)
    out = []
    for i in range(900):
        model = "hot" if i % 4 else f"m{i % 2}"
        rate = 0.1 if i < 300 else 0.6 if i < 500 else 0.15 if i < 700 else 0.9
        out.append((model, i // 3, i, None if i == 7 else int(rng.random() < rate)))
    return out


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(rows(), "model string, ts long, id long, err int").repartition(4)


def by_model():
    out = {}
    for m, ts, i, e in sorted(rows(), key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(m, []).append((i, e or 0))
    return out


def replay_ddm(seq, least=30):
    out, n, k, best = [], 0, 0, None
    for i, e in seq:
        n, k = n + 1, k + e
        p = k / n
        s = math.sqrt(p * (1 - p) / n)
        if n < least:
            continue
        if best is None or p + s < best[0] + best[1]:
            best = (p, s)
        if p + s > best[0] + 3 * best[1]:
            out.append((i, "drift", n))
            n, k, best = 0, 0, None
        elif p + s > best[0] + 2 * best[1]:
            out.append((i, "warning", n))
    return out


def replay_eddm(seq, least):
    out, n, last, gaps, top = [], 0, 0, [], 0.0
    for i, e in seq:
        n += 1
        if not e:
            continue
        gaps.append(n - last)
        last = n
        k = len(gaps)
        mean = n / k
        v = mean + 2 * math.sqrt(max(sum(g * g for g in gaps) / k - mean * mean, 0.0))
        if k < least:
            continue
        top = max(top, v)
        if v / top < 0.90:
            out.append((i, "drift", n))
            n, last, gaps, top = 0, 0, [], 0.0
        elif v / top < 0.95:
            out.append((i, "warning", n))
    return out


@pytest.mark.parametrize("heavy", SPLIT)
def test_ddm_with_resets(log, heavy):
    got = d.ddm_alarms(log, ["model"], "ts", "id", F.col("err") == 1, **heavy).collect()
    want = {(m, *a) for m, seq in by_model().items() for a in replay_ddm(seq)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r["level"] == "drift" and r["model"] == "hot" for r in got) >= 2


@pytest.mark.parametrize("heavy", SPLIT)
def test_eddm_with_resets(log, heavy):
    got = d.eddm_alarms(log, ["model"], "ts", "id", F.col("err") == 1, min_errors=10, **heavy).collect()
    want = {(m, *a) for m, seq in by_model().items() for a in replay_eddm(seq, 10)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r["level"] == "drift" for r in got) >= 3


def replay_adwin(values, seconds, delta=0.002):
    """``values``: (second, x) of one model; keeps every row of every bucket."""
    held = {}
    for t, x in values:
        held.setdefault(t // seconds, []).append(x)
    keys, out, start = sorted(held), [], 0
    for t in range(1, len(keys) + 1):
        for j in range(31):
            c = t - (1 << j)
            if c <= start:
                break
            a = [x for k in keys[start:c] for x in held[k]]
            b = [x for k in keys[c:t] for x in held[k]]
            if min(len(a), len(b)) < 5:
                continue
            n = len(a) + len(b)
            mean = (sum(a) + sum(b)) / n
            v = sum((x - mean) ** 2 for x in a + b) / n
            inv, lg = 1 / len(a) + 1 / len(b), math.log(2 * math.log(n) / delta)
            gap = abs(sum(a) / len(a) - sum(b) / len(b))
            if gap > math.sqrt(2 * inv * v * lg) + 2 / 3 * inv * lg:
                out.append((keys[t - 1], keys[c], len(a), len(b), round(sum(a) / len(a), 6), round(sum(b) / len(b), 6)))
                start = c
                break
    return out


@pytest.mark.parametrize("heavy", SPLIT)
def test_adwin_equals_replay_over_buckets(spark, heavy):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        level = 0.2 if i < 1000 else 0.7 if i < 1800 else 0.45
        data.append(("hot" if i % 5 else "cold", i * 20, round(level + rng.random() * 0.3, 3)))
    df = spark.createDataFrame([*data, ("hot", 10, None), ("none", 10, None)], "model string, sec long, x double").withColumn(
        "ts", F.timestamp_seconds("sec"))
    out = d.adwin_changes(df, ["model"], "ts", F.col("x"), seconds=600, **heavy).collect()
    got = sorted((r["model"], r["bucket"], r["cut"], r["n_before"], r["n_after"], round(r["mean_before"], 6), round(r["mean_after"], 6))
                 for r in out)
    want = sorted((m, *a) for m in ("hot", "cold") for a in replay_adwin([(t, x) for k, t, x in data if k == m], 600))
    assert got == want and len(got) >= 4
    per = df.groupBy("model").count()
    assert d.bucket_summaries(df, ["model"], "ts", F.col("x"), 600).count() <= per.count() * 101


def test_empty_tables(spark):
    none = spark.createDataFrame([], "model string, ts long, id long, err int")
    assert d.ddm_alarms(none, ["model"], "ts", "id", F.col("err") == 1).count() == 0
    assert d.eddm_alarms(none, ["model"], "ts", "id", F.col("err") == 1).count() == 0
    assert d.adwin_changes(none.withColumn("ts", F.timestamp_seconds("ts")), ["model"], "ts", F.col("err")).count() == 0
