import re
from itertools import permutations

import pytest

from medlake.llm import filter_audit
from tests.llm.odd import base_rows, docs

LABELS = [(1, 1, 0), (2, 1, 1), (7, 0, 1), (7, 1, 0), (8, None, None), (None, 1, 1), (11, 1, None), (99, 1, 1)]


def brute(rows, labels):
    def fails(r):
        text = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [o[0] for o in rows if (o[1] or "") == text]
        return {f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            re.search(r"[#$%&*|]", text), r[0] is not None and any(o is not None and o < r[0] for o in same))) if bad}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    held = [(r[3] or "", r[0], fails(r)) for r in rows]
    out = {}
    for part in {p for p, _, _ in held}:
        own = [(i, f) for p, i, f in held if p == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for at, x in enumerate(order):
                gone = [i for i, f in left if x in f]
                removed[x] += len(gone)
                before = set(order[:at])
                now = [(i, f) for i, f in left if x not in f]
                out[part, "".join(order), at + 1] = [
                    len(now), len(gone), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own),
                    sum(i in good for i in gone), sum(i in toxic for i in gone)]
                left = now
        for (p, order, at), v in out.items():
            if p == part:
                v.append(removed[order[at - 1]])
    return {k: tuple(v) for k, v in out.items()}


def mixed(n=120):
    rows = []
    for i in range(n):
        text = " ".join(f"w{(i * j) % (7 + i % 60)}" for j in range(40 + i % 25))
        text += " SHOUTED WORDS HERE" * (i % 3) + " 5% & more" * (i % 5 == 0)
        rows.append((i, text, "en", f"s{i % 4}", 1))
    return rows + [(1000 + i, rows[i % 6][1], "en", "s0", 1) for i in range(n // 2)] + [(2000 + i, None, "en", None, 1) for i in range(9)]


@pytest.mark.parametrize("rows", [base_rows(), mixed()])
def test_equals_brute_force(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs(spark, rows), labels)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()} == brute(rows, LABELS)
    assert got.count() == 600 * len({r[3] or "" for r in rows})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs(spark, []), none).count() == 0
    got = filter_audit.audit(docs(spark), none)
    assert got.agg({"good_lost": "max", "toxic_lost": "max"}).first()[:] == (0, 0)


def test_cells_are_few_and_count_every_row(spark):
    rows = mixed() * 3
    cells = filter_audit.mask_cells(docs(spark, rows), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    assert sum(c["n"] for c in cells) == len(rows)
    assert len(cells) == len({(c["part"], c["mask"]) for c in cells}) and all(0 <= c["mask"] < 32 for c in cells)


def test_plan_has_no_python_nodes(spark):
    plan = filter_audit.audit(docs(spark), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("InArrow", "InPandas", "PythonUDF", "CartesianProduct", "NestedLoop"))
