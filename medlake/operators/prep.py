"""Imputation, encoding, scaling and splitting.

Each estimator is a ``fit`` (one aggregate job whose result is a handful
of numbers per column, brought to the driver) and a ``transform`` (a pure
projection).  Nothing row-sized ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.operators.ordered import exact_quantiles_df, running_totals
from medlake.session import materialize

MAX_CATEGORIES = 10_000


def _unpivot(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(cast).alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value")


def fit_median(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """I1 fit: exact median of the non-NULL values of each column (mean of
    the middle two).  All columns in one distributed job (unpivot, then
    per-column exact quantiles); an all-NULL column maps to None."""
    if not cols:
        return {}
    long = _unpivot(df, cols, "double")
    rows = exact_quantiles_df(long, "value", [0.5], group_cols=["column"]).collect()
    got = {r["column"]: r["q"] for r in rows}
    return {c: got.get(c) for c in cols}


def fit_mode(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """I2 fit: most frequent non-NULL value per column, smallest on ties.

    Values are counted with a distributed group-by (map-side partial
    counts), and the winner per column is a ``min_by`` on (-count, value):
    no column's values are ever gathered in one place.
    """
    if not cols:
        return {}
    long = _unpivot(df, cols, "string").where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("mode"))
    got = {r["column"]: r["mode"] for r in best.collect()}
    return {c: got.get(c) for c in cols}


def impute(df: DataFrame, num_cols: Sequence[str] = (), cat_cols: Sequence[str] = (),
           drop_all_null: bool = True) -> tuple[DataFrame, dict]:
    """I1+I2: fill numeric columns with the median, categorical with the mode.

    Returns the transformed frame and the fitted fill values.  Columns
    with no non-NULL value are dropped (``drop_all_null``).
    """
    med = fit_median(df, list(num_cols))
    mode = fit_mode(df, list(cat_cols))
    fills = {**med, **mode}
    dead = [c for c, v in fills.items() if v is None]
    out = df
    sel = []
    for c in df.columns:
        if c in dead and drop_all_null:
            continue
        if c in fills and fills[c] is not None:
            v = fills[c]
            typ = df.schema[c].dataType
            sel.append(F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(typ)).alias(c))
        else:
            sel.append(F.col(f"`{c}`"))
    out = df.select(*sel)
    return out, {k: v for k, v in fills.items() if v is not None}


def fit_categories(df: DataFrame, cols: Sequence[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list]:
    """I3 fit for one column per category: sorted distinct non-NULL categories per
    column (one job).  A frame as wide as its categories is refused above
    ``max_categories``; ``fit_category_index`` and ``one_hot_sparse`` take any number."""
    if not cols:
        return {}
    long = _unpivot(df, cols, "string").where("value IS NOT NULL").distinct()
    sizes = {r["column"]: r["n"] for r in long.groupBy("column").count().withColumnRenamed(
        "count", "n").collect()}
    big = {c: n for c, n in sizes.items() if n > max_categories}
    if big:
        raise ValueError(f"too many categories to one-hot encode: {big}")
    cats: dict[str, list] = {c: [] for c in cols}
    for r in long.collect():
        cats[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in cats.items()}


def fit_category_index(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """I3 fit for columns of any number of categories: landed table (column, value,
    index, size) that numbers each column's distinct non-NULL values from 0 in their
    order.  Values are placed by ranges, so no column is sorted in one task."""
    from medlake.operators.quality import sorted_positions
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, index long, size long")
    values = _unpivot(df, cols, "string").where("value IS NOT NULL").distinct()
    placed = materialize(sorted_positions(values, ["column", "value"]), "categories")
    firsts = placed.groupBy("column").agg(F.min("pos").alias("first"), F.count("*").alias("size"))     # a row for each column
    return placed.join(F.broadcast(firsts), "column").select("column", "value", (F.col("pos") - F.col("first")).alias("index"), "size")


def one_hot_sparse(df: DataFrame, index: DataFrame, cols: Sequence[str], out: str = "one_hot") -> DataFrame:
    """I3 transform for columns of any number of categories: ``out`` holds the sorted
    places of the ones, counted from 0 over the columns' categories one after the other
    (``sparse_offsets`` gives each one's first place).  Unknown and NULL values add no place.

    Each column is one equi-join on its value; a value that many rows share is split by
    the adaptive skew join, and the index has one row for a value."""
    offset, res = sparse_offsets(index, cols), df
    places = []
    for k, c in enumerate(cols):
        one = index.where(F.col("column") == c).select(F.col("value").alias(f"__v{k}"), (F.col("index") + offset[c]).alias(f"__i{k}"))
        res = res.join(one, F.col(f"`{c}`").cast("string") == F.col(f"__v{k}"), "left").drop(f"__v{k}")
        places.append(F.col(f"__i{k}"))
    ones = F.array_sort(F.filter(F.array(*places), lambda x: x.isNotNull())) if places else F.array().cast("array<bigint>")
    return res.select(*[F.col(f"`{c}`") for c in df.columns if c != out], ones.alias(out))


def sparse_offsets(index: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """First place of each column in ``one_hot_sparse`` (one number for each column)."""
    size = {r["column"]: r["size"] for r in index.select("column", "size").distinct().collect()}
    at, offsets = 0, {}
    for c in cols:
        offsets[c] = at
        at += size.get(c, 0)
    return offsets


def one_hot(df: DataFrame, categories: dict[str, list], drop_source: bool = True,
            sep: str = "_") -> DataFrame:
    """I3 transform: one 0/1 int column per known category, named
    ``{column}{sep}{value}``; unknown and NULL values give all zeros."""
    extra = []
    for c, values in categories.items():
        for v in values:
            extra.append(F.coalesce((F.col(f"`{c}`").cast("string") == F.lit(v)).cast("int"),
                                    F.lit(0)).alias(f"{c}{sep}{v}"))
    keep = [F.col(f"`{c}`") for c in df.columns if not (drop_source and c in categories)]
    return df.select(*keep, *extra)


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """I4 fit: (mean, population std) per column in one aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standard_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """I4 transform: (x - mean) / std; a constant column (std 0) maps to 0."""
    sel = []
    for c in df.columns:
        if c in stats:
            m, s = stats[c]
            scale = s if s else 1.0
            sel.append(((F.col(c) - F.lit(m)) / F.lit(scale)).alias(c))
        else:
            sel.append(F.col(f"`{c}`"))
    return df.select(*sel)


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the ``ceil(n * test_size)`` rows first in a
    seeded hash order of ``key`` are the test set.  Reproducible across
    partitionings (unlike ``randomSplit``); the row index comes from the
    bucketed running count, not a global window."""
    h = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__one", F.lit(1))
    r = running_totals(h, ["__h", key], ["__one"])
    n_test = F.ceil(F.col("total___one") * F.lit(float(test_size)))
    return r.withColumn("is_test", F.col("cum___one") <= n_test).drop("__h", "__one", "cum___one",
                                                                         "total___one")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """I8: ``fold`` = (rank within label in a seeded hash order - 1) % k, so
    each fold keeps the class ratio to within one row.  A large label
    class is spread over range buckets, not one task."""
    h = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__one", F.lit(1))
    r = running_totals(h, ["__h", key], ["__one"], partition_cols=[label], with_totals=False)
    return r.withColumn("fold", ((F.col("cum___one") - 1) % k).cast("int")).drop("__h", "__one", "cum___one")


def kbins_quantile_edges(df: DataFrame, col: str, n_bins: int = 5) -> list[float]:
    """P10 fit: exact quantile edges at 0, 1/n, ..., 1 (equal edges merged)."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    from medlake.operators.ordered import exact_quantiles
    edges = exact_quantiles(df, col, probs)
    out: list[float] = []
    for e in edges:
        if e is None:
            continue
        if not out or e > out[-1]:
            out.append(e)
    return out


def kbins_apply(col: str, edges: Sequence[float]):
    """P10 transform: ordinal bin = number of inner edges <= x, clipped to
    the last bin."""
    from medlake.functions.features import digitize
    inner = list(edges[1:-1])
    return digitize(col, inner)




def column_transformer(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                       binned: Sequence[str] = (), n_bins: int = 5, passthrough: Sequence[str] = ()
                       ) -> tuple[DataFrame, dict]:
    """Routed preprocessing fitted on ``df``: numeric -> median impute
    then standard scale; categorical -> mode impute then one-hot; binned ->
    quantile bins (ordinal).  Columns in ``passthrough`` (keys, labels) are
    kept as they are -- unlike the reference, nothing else is silently
    dropped.  Returns the transformed frame and the fitted parameters."""
    med = fit_median(df, list(numeric))
    mode = fit_mode(df, list(categorical))
    filled = df.select(*[F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)).alias(c)
                         if (c in med and med[c] is not None) or (c in mode and mode[c] is not None)
                         else F.col(f"`{c}`") for c in df.columns for v in [med.get(c, mode.get(c))]])
    stats = fit_standard(filled, list(numeric))
    cats = fit_categories(filled, list(categorical))
    edges = {c: kbins_quantile_edges(filled, c, n_bins) for c in binned}
    out_cols = [F.col(f"`{c}`") for c in passthrough]
    for c in numeric:
        m, s = stats[c]
        out_cols.append(((F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)).alias(c))
    for c, values in cats.items():
        for v in values:
            out_cols.append(F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    for c in binned:
        out_cols.append(kbins_apply(c, edges[c]).alias(f"{c}_bin"))
    return filled.select(*out_cols), {"median": med, "mode": mode, "scale": stats, "categories": cats, "edges": edges}
