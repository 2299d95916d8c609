"""Evaluation aggregates (E1-E12) over a scored table ``(group.., score, label)``.

Curve metrics (AUC, PR curve, AP, Youden) are computed from counts per
*distinct* score, then bucketed running sums (``running_totals``) -- exact,
with ties handled like the rank-based definitions, and no single-task
global window no matter how many rows or how skewed the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.operators.ordered import running_totals


def _div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion_counts(df: DataFrame, score: str, label: str, group: Sequence[str] = (), threshold: float = 0.5,
                     predicted: Column | None = None) -> DataFrame:
    """E1/E4 base: TP, FP, FN, TN per group (positive class 1, ``score >= threshold``)."""
    yhat = predicted if predicted is not None else (F.col(score) >= F.lit(threshold))
    y = F.col(label) == 1
    return df.groupBy(*group).agg(
        F.count_if(yhat & y).alias("tp"), F.count_if(yhat & ~y).alias("fp"),
        F.count_if(~yhat & y).alias("fn"), F.count_if(~yhat & ~y).alias("tn"))


def classification_metrics(df: DataFrame, score: str, label: str, group: Sequence[str] = (),
                           threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, f1 (zero denominators give 0)."""
    c = confusion_counts(df, score, label, group, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    return c.select(*group, "tp", "fp", "fn", "tn",
                    _div0(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _div0(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(df: DataFrame, score: str, label: str, group: Sequence[str] = (),
                     threshold: float = 0.5) -> DataFrame:
    """The complete 2x2 grid (zero cells included) as rows (actual, predicted, n)."""
    c = confusion_counts(df, score, label, group, threshold)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("n"))
                      for a, p, n in [(1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")]])
    return c.select(*group, F.explode(cells).alias("c")).select(*group, "c.actual", "c.predicted", "c.n")


def score_counts(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (map-side partial counts)."""
    return df.groupBy(*group, score).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                         F.count_if(F.col(label) != 1).alias("neg"))


def roc_auc(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC per group; tied scores count one half.

    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N), with neg_below
    from an ascending running sum over distinct scores.
    """
    c = running_totals(score_counts(df, score, label, group), [score], ["pos", "neg"], partition_cols=list(group))
    contrib = F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") / 2.0)
    return c.groupBy(*group).agg(
        (F.sum(contrib) / (F.first("total_pos") * F.first("total_neg"))).alias("auc"),
        F.first("total_pos").alias("n_pos"), F.first("total_neg").alias("n_neg"))


def pr_points(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """E3/E8 base: per distinct score (as threshold, ``score >= t``): TP, FP,
    precision, recall, TPR, FPR, from a descending running sum."""
    c = running_totals(score_counts(df, score, label, group), [score], ["pos", "neg"], partition_cols=list(group),
                       descending=True)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return c.select(*group, F.col(score).alias("threshold"), "pos", "neg", tp.alias("tp"), fp.alias("fp"),
                    F.col("total_pos").alias("n_pos"), F.col("total_neg").alias("n_neg"),
                    _div0(tp, tp + fp).alias("precision"), _div0(tp, F.col("total_pos")).alias("recall"),
                    _div0(fp, F.col("total_neg")).alias("fpr"))


def average_precision(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """E5: AP = sum (R_n - R_{n-1}) P_n with no interpolation; the recall
    step at a threshold is pos_t / P."""
    p = pr_points(df, score, label, group)
    return p.groupBy(*group).agg((F.sum(F.col("pos") * F.col("precision")) / F.first("n_pos")).alias("ap"))


def brier(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probability."""
    return df.groupBy(*group).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def threshold_sweep(df: DataFrame, score: str, label: str, group: Sequence[str] = (), steps: int = 10) -> DataFrame:
    """Precision / recall / f1 at thresholds i/steps, i = 0..steps (``score >= t``).

    Each row gets the index of the highest threshold it reaches (a sum of
    comparisons, no join); counts per (group, index) form a tiny table whose
    suffix sums give the confusion counts at every threshold.
    """
    level = sum(((F.col(score) >= F.lit(i / steps)).cast("int") for i in range(1, steps + 1)), F.lit(0))
    y = F.col(label) == 1
    c = df.groupBy(*group, level.alias("lvl")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    # one row per (group, threshold): explode the fixed threshold indices of the small table
    t = c.select(*group, "lvl", "pos", "neg", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    s = t.groupBy(*group, "i").agg(
        F.sum(F.when(F.col("lvl") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("lvl") >= F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("lvl") < F.col("i"), F.col("pos")).otherwise(0)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(*group, (F.col("i") / F.lit(float(steps))).alias("threshold"),
                    _div0(tp, tp + fp).alias("precision"), _div0(tp, tp + fn).alias("recall"),
                    _div0(2 * tp, 2 * tp + fp + fn).alias("f1"))


def youden_threshold(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Threshold maximising TPR - FPR; the highest threshold wins ties.

    Compared on the exact integer numerator ``tp*N - fp*P`` so float
    rounding cannot break ties differently.
    """
    p = pr_points(df, score, label, group)
    num = F.col("tp") * F.col("n_neg") - F.col("fp") * F.col("n_pos")
    best = p.groupBy(*group).agg(F.max_by(F.struct("threshold", "tp", "fp", "n_pos", "n_neg"),
                                          F.struct(num.alias("num"), F.col("threshold"))).alias("b"))
    b = F.col("b")
    return best.select(*group, b["threshold"].alias("threshold"),
                       (_div0(b["tp"], b["n_pos"]) - _div0(b["fp"], b["n_neg"])).alias("youden_j"))


def calibration_error(df: DataFrame, score: str, label: str, group: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins [ours]."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = df.groupBy(*group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("y"),
                                                 F.avg(score).alias("p"))
    w = Window.partitionBy(*group)
    return per.withColumn("tot", F.sum("n").over(w)).groupBy(*group).agg(
        F.sum(F.col("n") / F.col("tot") * F.abs(F.col("y") - F.col("p"))).alias("ece"))


def evaluation_report(df: DataFrame, score: str, label: str, group: Sequence[str]) -> DataFrame:
    """One row per group with AUC, AP, Brier, ECE, Youden threshold and
    the threshold-0.5 classification metrics (joins of small per-group tables)."""
    g = list(group)
    parts = [roc_auc(df, score, label, g).select(*g, "auc"), average_precision(df, score, label, g),
             brier(df, score, label, g), calibration_error(df, score, label, g),
             youden_threshold(df, score, label, g).select(*g, F.col("threshold").alias("best_threshold")),
             classification_metrics(df, score, label, g).select(*g, "accuracy", "precision", "recall", "f1")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, g, "inner")
    return out


def leaderboard(metrics: DataFrame, by: str = "f1", name: str = "model") -> DataFrame:
    """Rank models by a metric (ties share a rank).  The table has one
    row per model, so an unpartitioned window over it is tiny."""
    return metrics.withColumn("rank", F.rank().over(Window.orderBy(F.col(by).desc())))


def metrics_text(metrics: DataFrame, cols: Sequence[str], name: str = "model") -> DataFrame:
    """Three-decimal text of each metric."""
    return metrics.select(name, *[F.format_number(F.col(c), 3).alias(c) for c in cols])


def precision_recall_curve(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, from the highest threshold down to
    the first one reaching full recall, plus the closing point
    (precision 1, recall 0, no threshold) -- the usual library form."""
    g = list(group)
    p = pr_points(df, score, label, g)
    full = p.groupBy(*g).agg(F.max(F.when(F.col("tp") == F.col("n_pos"), F.col("threshold"))).alias("__t_full"))
    pts = _join_small(p, full, g)
    pts = pts.where(F.col("threshold") >= F.col("__t_full")).select(*g, "threshold", "precision", "recall")
    end = full.select(*g, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                      F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _join_small(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a one-row-per-group table (groups are few) by an equi-join on
    the group keys, or on a constant key when there are no groups."""
    if keys:
        from medlake.operators.joins import bounded_broadcast
        return big.join(bounded_broadcast(small), keys, "inner")
    return big.withColumn("__one", F.lit(1)).join(F.broadcast(small.withColumn("__one", F.lit(1))), "__one").drop(
        "__one")
