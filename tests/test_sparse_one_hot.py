"""One-hot places over columns of any number of categories."""

from medlake.operators import prep


def test_places_nulls_unknown_and_clashes(spark):
    rows = [(1, "b", 10, "x"), (2, "a", None, "x"), (3, None, 9, "y"), (4, "b", 9, None), (4, "b", 9, None)]
    df = spark.createDataFrame(rows, "id int, a string, b int, index string")
    fit = prep.fit_category_index(df.where("id < 4"), ["a", "b"])
    assert sorted(tuple(r) for r in fit.collect()) == [("a", "a", 0, 2), ("a", "b", 1, 2), ("b", "10", 0, 2), ("b", "9", 1, 2)]
    new = df.unionByName(spark.createDataFrame([(5, "new", 10, "z")], df.schema))
    got = sorted((r["id"], r["index"], r["one_hot"]) for r in prep.one_hot_sparse(new, fit, ["a", "b"]).collect() if r["id"] != 4)
    assert got == [(1, "x", [1, 2]), (2, "x", [0]), (3, "y", [3]), (5, "z", [2])]
    assert prep.one_hot_sparse(df, fit, ["a", "b"]).where("id = 4").select("one_hot").collect() == [([1, 3],)] * 2
    empty = prep.fit_category_index(df.limit(0), ["a"])
    assert empty.count() == 0 and prep.one_hot_sparse(df, empty, ["a"]).where("size(one_hot) > 0").count() == 0


def test_more_categories_than_columns_could_hold(spark):
    df = spark.range(30_000).selectExpr("id", "cast(id * 7 % 25000 AS string) AS c")
    out = prep.one_hot_sparse(df, prep.fit_category_index(df, ["c"]), ["c"])
    names = sorted({str(i * 7 % 25000) for i in range(30_000)})
    place = {v: i for i, v in enumerate(names)}
    assert all(r["one_hot"] == [place[r["c"]]] for r in out.collect())
