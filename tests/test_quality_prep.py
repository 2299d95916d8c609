"""Validation, imputation, encoding, scaling, splitting (FIXTURES A1-A4)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from medlake.functions import features as fx
from medlake.operators import joins, prep, quality
from medlake.sources import files

SAMPLE = """patient_id,age,bmi,blood_pressure,glucose,disease_risk
P001,45,28.1,140/90,110,1
P002,32,24.5,120/80,95,0
P003,60,31.2,150/95,130,1
```data source who```
"""


def test_v1_sample_file_junk_row_fails(spark):
    d = tempfile.mkdtemp(prefix="medlake-test-")
    p = os.path.join(d, "sample.csv")
    with open(p, "w") as f:
        f.write(SAMPLE)
    df = files.read_csv(spark, p, "patient_id string, age int, bmi double, blood_pressure string, glucose int, "
                                  "disease_risk int")
    flagged = {r["patient_id"]: r["is_valid"] for r in quality.flag_rows(df).collect()}
    assert flagged["P001"] and flagged["P002"] and flagged["P003"]
    assert flagged["```data source who```"] is False
    ok, msg = quality.validate(df)
    assert not ok and "patient_id" in msg
    ok2, _ = quality.validate(df.where("patient_id LIKE 'P0%'"))
    assert ok2


def test_v1_bounds_inclusive(spark):
    df = spark.createDataFrame([("P100", 18, 15.0, 0), ("P101", 120, 50.0, 1), ("P102", 121, 50.0, 1),
                                ("P1", 30, 20.0, 1), ("P103", 30, 20.0, 2)],
                               "patient_id string, age int, bmi double, disease_risk int")
    got = {r["patient_id"]: r["is_valid"] for r in quality.flag_rows(df).collect()}
    assert got == {"P100": True, "P101": True, "P102": False, "P1": False, "P103": False}


def test_v4_guard(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(joins.DuplicateKeyError):
        joins.key_join(a, b, "k", validate="one_to_one")


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, "x"), ("1", "y")], "k string, v string")
    b = spark.createDataFrame([(None, "z"), ("1", "w")], "k string, v string")
    assert joins.key_join(a, b, "k").count() == 1
    j = joins.key_join(a, b, "k", null_safe=True)
    assert j.count() == 2 and set(j.columns) == {"k", "v_x", "v_y"}


def test_a4_impute(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (3.0, "z")], "a double, b string")
    out, fills = prep.impute(df, ["a"], ["b"])
    rows = out.collect()
    assert fills == {"a": 2.0, "b": "x"}
    assert all(r["a"] is not None and r["b"] is not None for r in rows)


def test_median_even_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None)], "a double, z double")
    out, fills = prep.impute(df, ["a", "z"], [])
    assert fills["a"] == 2.5 and "z" not in out.columns


def test_one_hot_unknown_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    cats = prep.fit_categories(train, ["c"])
    assert cats == {"c": ["a", "b"]}
    test = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    got = [tuple(r) for r in prep.one_hot(test, cats).collect()]
    assert got == [(1, 0), (0, 0), (0, 0)]


def test_standard_scale_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    st = prep.fit_standard(df, ["x", "c"])
    got = [tuple(r) for r in prep.standard_scale(df, st).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_split_and_folds(spark):
    df = spark.range(0, 103).selectExpr("id", "cast(id % 3 = 0 AS int) AS y")
    s = prep.train_test_split(df, "id", 0.2, 7)
    assert s.where("is_test").count() == 21  # ceil(103 * 0.2)
    f = prep.stratified_folds(df, "y", "id", k=5)
    sizes = {(r["y"], r["fold"]): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        v = [sizes[(y, k)] for k in range(5)]
        assert max(v) - min(v) <= 1


def test_kbins_quantile(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    edges = prep.kbins_quantile_edges(df, "x", 5)
    assert edges[0] == 1.0 and edges[-1] == 10.0 and edges[1] == pytest.approx(2.8)
    bins = [r[0] for r in df.select(prep.kbins_apply("x", edges)).collect()]
    assert bins == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_sample_per_code_sorts_the_first_hash_ranges_only(spark):
    from medlake.functions.privacy import hash_unit
    from medlake.operators import rules
    rows = [(f"P{i % 3000}", d, c) for i in range(6000) for d, c in (("d1", "a"), ("d2", None))]
    rows += [(None, "d1", "a"), ("P7", "d3", "few"), ("P8", "d3", "few")]
    hits = spark.createDataFrame(rows, "patient_id string, disease string, code string")
    got = rules.sample_per_code(hits, k=3)
    unit = {r["patient_id"]: r["u"] for r in hits.select("patient_id", hash_unit("patient_id", seed=7).alias("u")).distinct().collect()}
    want = []
    for d, c in (("d1", "a"), ("d2", None), ("d3", "few")):
        own = sorted((r for r in rows if r[1:] == (d, c)), key=lambda r: (unit[r[0]] is not None, unit[r[0]] or 0.0, r[0] is not None, r[0] or ""))
        want += own[:3]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    few = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__range" in few and few.index("Window") < few.index("__last")
