"""Data drift (Q1-Q6): two-sample tests and stability indices between a
reference and a current table, one result row per feature.

All tests work on *counts per distinct value*, which Spark builds with a
partial (map-side) aggregate; the empirical CDFs for KS come from bucketed
running sums, so neither a feature nor a hot value ends up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from medlake.operators.ordered import exact_quantiles_df, running_totals

KS_TERMS = 100


def _long(df: DataFrame, cols: Sequence[str], side: str, cast: str) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast(cast).alias("value")) for c in cols
    ])).alias("kv")).select("kv.feature", "kv.value").where("value IS NOT NULL").withColumn("side", F.lit(side))


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = KS_TERMS) -> Column:
    """Asymptotic two-sided KS p-value with the Stephens small-sample
    correction: Q(lambda) = 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2)."""
    ne = n1 * n2 / (n1 + n2)
    lam = (F.sqrt(ne) + F.lit(0.12) + F.lit(0.11) / F.sqrt(ne)) * d
    s = F.lit(0.0)
    for k in range(1, terms + 1):
        s = s + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    return F.when(lam < 1e-3, F.lit(1.0)).otherwise(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))


def ks_drift(reference: DataFrame, current: DataFrame, features: Sequence[str], alpha: float = 0.05,
             correction: str = "bonferroni") -> DataFrame:
    """Q1 numeric part: per feature D = max |F_ref - F_cur| over the union
    of values, p-value, and a drift flag at ``alpha`` (Bonferroni over the
    features by default)."""
    long = _long(reference, features, "ref", "double").unionByName(_long(current, features, "cur", "double"))
    counts = long.groupBy("feature", "value").agg(F.count_if(F.col("side") == "ref").alias("n_ref"),
                                                  F.count_if(F.col("side") == "cur").alias("n_cur"))
    r = running_totals(counts, ["value"], ["n_ref", "n_cur"], partition_cols=["feature"])
    diff = F.abs(F.col("cum_n_ref") / F.col("total_n_ref") - F.col("cum_n_cur") / F.col("total_n_cur"))
    stat = r.groupBy("feature").agg(F.max(diff).alias("statistic"), F.first("total_n_ref").alias("n_ref"),
                                    F.first("total_n_cur").alias("n_cur"))
    level = alpha / len(features) if correction == "bonferroni" else alpha
    p = ks_pvalue(F.col("statistic"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
    return stat.withColumn("p_value", p).withColumn("drift", F.col("p_value") < F.lit(level)).withColumn(
        "test", F.lit("ks"))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Survival function of the chi-square distribution (regularized upper
    incomplete gamma Q(dof/2, x/2)); vectorised numpy, one value per feature."""
    out = np.empty(len(x))
    for i, (xi, ki) in enumerate(zip(x.to_numpy(dtype=float), dof.to_numpy(dtype=float))):
        out[i] = _gamma_q(ki / 2.0, xi / 2.0) if ki > 0 else np.nan
    return pd.Series(out)


def _gamma_q(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:  # series for P
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b = x + 1.0 - a  # continued fraction for Q
    c = 1.0 / 1e-300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_statistics(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Q1 categorical part: Pearson chi-square of the 2 x k table of level
    counts (reference vs current) per feature, with its degrees of freedom."""
    long = _long(reference, features, "ref", "string").unionByName(_long(current, features, "cur", "string"))
    counts = long.groupBy("feature", "value").agg(F.count_if(F.col("side") == "ref").alias("o_ref"),
                                                  F.count_if(F.col("side") == "cur").alias("o_cur"))
    from pyspark.sql import Window
    w = Window.partitionBy("feature")
    c = counts.select("feature", "value", "o_ref", "o_cur", F.sum("o_ref").over(w).alias("n_ref"),
                      F.sum("o_cur").over(w).alias("n_cur"))
    n = F.col("n_ref") + F.col("n_cur")
    row = F.col("o_ref") + F.col("o_cur")
    e_ref, e_cur = row * F.col("n_ref") / n, row * F.col("n_cur") / n
    term = F.pow(F.col("o_ref") - e_ref, 2) / e_ref + F.pow(F.col("o_cur") - e_cur, 2) / e_cur
    return c.groupBy("feature").agg(F.sum(term).alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"))


def chi2_drift(reference: DataFrame, current: DataFrame, features: Sequence[str], alpha: float = 0.05) -> DataFrame:
    s = chi2_statistics(reference, current, features)
    level = alpha / len(features)
    return s.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("dof").cast("double"))).withColumn(
        "drift", F.col("p_value") < F.lit(level)).withColumn("test", F.lit("chi2"))


def drift_table(reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                alpha: float = 0.05, share_limit: float = 0.5) -> DataFrame:
    """Q2: per-column drift (test chosen by column type [ours]) plus the
    dataset verdict (share of drifted columns >= ``share_limit``)."""
    k = len(numeric) + len(categorical)
    parts = []
    if numeric:
        parts.append(ks_drift(reference, current, numeric, alpha * len(numeric) / k)
                     .select("feature", "test", "statistic", "p_value", "drift"))
    if categorical:
        parts.append(chi2_drift(reference, current, categorical, alpha * len(categorical) / k)
                     .select("feature", "test", "statistic", "p_value", "drift"))
    t = parts[0]
    for p in parts[1:]:
        t = t.unionByName(p)
    from pyspark.sql import Window
    share = F.avg(F.col("drift").cast("double")).over(Window.partitionBy())
    return t.withColumn("drifted_share", share).withColumn("dataset_drift", F.col("drifted_share") >= share_limit)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Q3: rows, columns, missing cells, duplicated rows, constant columns.

    A column is constant when its min equals its max (or it is all NULL),
    so one cheap aggregate suffices; duplicates need one shuffle
    (``distinct``), which is inherent to the question."""
    cols = df.columns
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    mm = []
    for i, c in enumerate(cols):
        mm += [F.min(F.col(f"`{c}`")).alias(f"lo{i}"), F.max(F.col(f"`{c}`")).alias(f"hi{i}")]
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(missing).alias("n_missing_cells"), *mm)
    n_distinct_rows = df.distinct().count()
    const = sum((F.coalesce(F.col(f"lo{i}") == F.col(f"hi{i}"), F.lit(True)).cast("int")
                 for i in range(len(cols))), F.lit(0))
    return agg.select("n_rows", F.lit(len(cols)).alias("n_columns"), "n_missing_cells",
                      (F.col("n_rows") - F.lit(n_distinct_rows)).alias("n_duplicated_rows"),
                      const.alias("n_constant_columns"))


def psi(reference: DataFrame, current: DataFrame, feature: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Q6: population stability index over the reference's quantile bins
    (exact edges), with a floor for empty bins [ours]:
    sum (q - p) * ln(q / p)."""
    probs = [i / bins for i in range(1, bins)]
    edges_df = exact_quantiles_df(reference, feature, probs)
    edges = sorted({r["q"] for r in edges_df.collect() if r["q"] is not None})  # bins-1 numbers
    lvl = sum(((F.col(feature) >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    r = reference.where(F.col(feature).isNotNull()).groupBy(lvl.alias("bin")).agg(F.count(F.lit(1)).alias("n_ref"))
    c = current.where(F.col(feature).isNotNull()).groupBy(lvl.alias("bin")).agg(F.count(F.lit(1)).alias("n_cur"))
    j = r.join(c, "bin", "full_outer").fillna(0, subset=["n_ref", "n_cur"])
    from pyspark.sql import Window
    w = Window.partitionBy()
    p = F.greatest(F.col("n_ref") / F.sum("n_ref").over(w), F.lit(floor))
    q = F.greatest(F.col("n_cur") / F.sum("n_cur").over(w), F.lit(floor))
    per = j.select("bin", ((q - p) * F.log(q / p)).alias("term"))
    return per.agg(F.sum("term").alias("psi")).withColumn("feature", F.lit(feature))


def drift_trend(scores: DataFrame, group: Sequence[str], ts: str, tiebreak: str, score: str) -> DataFrame:
    """Q4: mean, max and OLS slope of the score against its row index
    (ordered by time, then id) per group; slope > 0 -> 'increasing'.
    The row index is a bucketed running count, not a global row_number."""
    s = scores.select(*group, ts, tiebreak, score).withColumn("__one", F.lit(1))
    r = running_totals(s, [ts, tiebreak], ["__one"], partition_cols=list(group), with_totals=False)
    idx = F.col("cum___one").cast("double")
    out = r.groupBy(*group).agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
                                F.regr_slope(F.col(score), idx).alias("slope"))
    return out.withColumn("trend", F.when(F.col("slope") > 0, "increasing").otherwise("decreasing"))
