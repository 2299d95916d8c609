"""Sorted neighbourhoods and learned agreement weights."""

import numpy as np

from medlake.operators import quality


def brute_pairs(left, right, reach):
    """(sort value, id) rows; NULL sorts first."""
    rows = sorted([(v is not None, v or "", 0, i) for i, v in left] + [(v is not None, v or "", 1, i) for i, v in right])
    return sorted((a[3], b[3]) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[2] == 0 and b[2] == 1 and abs(i - j) <= reach)


def test_pairs_equal_brute_force_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    def side(first, n):
        return [(first + i, None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"k{rng.integers(40):02d}") for i in range(n)]
    left, right = side(0, 150), side(1000, 170)
    a, b = (spark.createDataFrame(x, "id long, k string") for x in (left, right))
    for reach in (1, 4):
        got = sorted(tuple(r) for r in quality.neighbour_pairs(a, b, "id", "id", ["k"], reach).collect())
        assert got == brute_pairs(left, right, reach)
    assert quality.neighbour_pairs(a.limit(0), b, "id", "id", ["k"]).count() == 0
    assert quality.neighbour_pairs(a.limit(0), b.limit(0), "id", "id", ["k"]).count() == 0


def test_weights_are_recovered():
    rng = np.random.default_rng(5)
    share, m, u = 0.2, np.array([0.95, 0.9, 0.8, 0.97]), np.array([0.02, 0.1, 0.3, 0.05])
    match = rng.random(200_000) < share
    x = (rng.random((200_000, 4)) < np.where(match[:, None], m, u)).astype(int)
    x[rng.random((200_000, 4)) < 0.1] = -1          # missing at random
    values, counts = np.unique(x, axis=0, return_counts=True)
    got = quality.fit_agreement(list(zip(values.tolist(), counts.tolist(), strict=True)), 4)
    assert abs(got[0] - share) < 0.01 and np.abs(got[1] - m).max() < 0.01 and np.abs(got[2] - u).max() < 0.01
    assert quality.fit_agreement([], 2)[0] == 0.1


def test_matches_find_altered_records(spark):
    rng = np.random.default_rng(7)
    def person(i):
        return (f"name{rng.integers(10**6):06d}", int(rng.integers(30)), int(rng.integers(2000)), i)
    people = [person(i) for i in range(300)]
    copies = [(n + "x" if i % 7 == 0 else n, c if i % 5 else None, z, 1000 + i) for n, c, z, i in people]
    others = [person(2000 + i) for i in range(200)]
    schema = "name string, city int, zip int, id long"
    a, b = spark.createDataFrame(people, schema), spark.createDataFrame(copies + others, schema)
    got = {r["l_id"]: r["r_id"] for r in quality.learned_matches(a, b, "id", "id", [["name"], ["zip", "city"]], ["name", "city", "zip"]).collect()}
    assert sum(r == l + 1000 for l, r in got.items()) >= 0.97 * 300
    assert sum(r != l + 1000 for l, r in got.items()) <= 3
