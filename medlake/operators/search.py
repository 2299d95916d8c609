"""Hyper-parameter search by successive halving (M6).

All sampled settings ("trials") start with few trees; after each rung the better part
goes on with more.  A trial's work is k-fold scoring on Spark ML; its held-out scores
are landed, and one grouped job computes the exact AUC of every (trial, fold) of the
rung.  Everything a rung has finished is in the store, so a search that was stopped
goes on where it was: landed trials are not fitted again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlake.operators import metrics
from medlake.operators.ml import positive_probability, sample_space, train
from medlake.operators.prep import stratified_folds

# fixed values: trials and folds of the search
TRIALS, FOLDS = 100, 3
RESULT = "rung int, trial int, trees int, params string, cv_auc double, cv_auc_min double, cv_auc_max double, promoted boolean"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where none was ever finished."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _settings(spark: SparkSession, store: str, settings: dict) -> None:
    """Write the settings of a new search; refuse a store that holds another one."""
    text = json.dumps(settings, sort_keys=True)
    had = _stored(spark, f"{store}/settings")
    if had is None:
        spark.createDataFrame([(text,)], "settings string").write.mode("overwrite").parquet(f"{store}/settings")
    elif had.first()["settings"] != text:
        raise ValueError("the store holds a search with other settings")


def _fit(folds: DataFrame, path: str, kind: str, params: dict, k: int, label: str, features: str) -> None:
    """Land the held-out scores of one trial, then mark it as finished."""
    for i in range(k):
        model = train(folds.where(F.col("fold") != i), kind, label, features, **params)
        held = positive_probability(model.transform(folds.where(F.col("fold") == i)), "p")
        held.select("p", F.col(label).cast("int").alias("y")).write.mode("overwrite").parquet(f"{path}/scores/fold={i}")
    folds.sparkSession.createDataFrame([(True,)], "done boolean").write.mode("overwrite").parquet(f"{path}/done")


def _rung_auc(spark: SparkSession, store: str, rung: int, trials: Sequence[int]) -> list[tuple[int, float, float, float]]:
    """(trial, mean, least and largest AUC over its folds), one job for the rung."""
    parts = [spark.read.option("basePath", f"{store}/rung={rung}/trial={t}/scores").parquet(
        f"{store}/rung={rung}/trial={t}/scores").withColumn("trial", F.lit(t)) for t in trials]
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    per = metrics.roc_auc(scores, "p", "y", ["trial", "fold"]).groupBy("trial").agg(
        F.avg("auc").alias("a"), F.min("auc").alias("lo"), F.max("auc").alias("hi"))
    return [(r["trial"], r["a"], r["lo"], r["hi"]) for r in per.collect()]      # one row a trial


def halving_search(df: DataFrame, key: str, store: str, label: str = "label", features: str = "features", n_trials: int = TRIALS,
                   k: int = FOLDS, least_trees: int = 10, eta: int = 2, kind: str = "gbt", seed: int = 42,
                   parallelism: int = 4) -> DataFrame:
    """M6: every (rung, trial) with its cross-validated AUC and whether it went on.

    Rung r gives each trial ``least_trees * eta^r`` trees, at most what its setting
    asks for; the best ``1/eta`` (ties: smaller trial) go on until one is left, whose
    last row alone is ``promoted``.  ``store`` is a shared folder; calling again with
    the same settings resumes or returns the finished search."""
    if eta < 2 or n_trials < 1:
        raise ValueError("eta must be 2 or more, n_trials 1 or more")
    spark = df.sparkSession
    space = sample_space(n_trials, seed)
    _settings(spark, store, {"n_trials": n_trials, "k": k, "least_trees": least_trees, "eta": eta, "kind": kind, "seed": seed,
                             "label": label, "features": features, "key": key})
    folds = stratified_folds(df, label, key, k=k, seed=seed).persist()
    alive, rows, rung = list(range(n_trials)), [], 0
    try:
        while True:
            trees = least_trees * eta ** rung
            params = {t: {**space[t], "num_trees": min(trees, space[t]["num_trees"])} for t in alive}
            todo = [t for t in alive if _stored(spark, f"{store}/rung={rung}/trial={t}/done") is None]
            with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
                for job in [pool.submit(_fit, folds, f"{store}/rung={rung}/trial={t}", kind, params[t], k, label, features) for t in todo]:
                    job.result()
            got = sorted(_rung_auc(spark, store, rung, alive), key=lambda r: (-r[1], r[0]))
            last = len(got) == 1
            best = {r[0] for r in got[:1 if last else max(1, math.ceil(len(got) / eta))]}
            rows += [(rung, t, params[t]["num_trees"], json.dumps(space[t], sort_keys=True), float(a), float(lo), float(hi), t in best)
                     for t, a, lo, hi in got]
            if last:
                break
            alive, rung = sorted(best), rung + 1
    finally:
        folds.unpersist()
    return spark.createDataFrame(rows, RESULT)      # a row for each trial and rung


def best_trial(results: DataFrame) -> DataFrame:
    """The one trial that was promoted out of the last rung."""
    return results.where("promoted").orderBy(F.col("rung").desc()).limit(1)
