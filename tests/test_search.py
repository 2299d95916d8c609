"""Successive halving: counts, promotion, reproducible best trial, resuming."""

import random

import pytest
from pyspark.sql import functions as F

from medlake.operators import ml, search
from medlake.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        x = [rng.random() for _ in range(3)]
        rows.append((i, x, float(x[0] + 0.3 * rng.random() > 0.6)))
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return ml.with_features(df, "x").select("id", "label", "features").coalesce(1).cache()


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_halving_and_resuming(spark, data, monkeypatch):
    store = scratch_path(spark, "search-test")
    kw = dict(n_trials=4, k=2, least_trees=1, seed=7)
    monkeypatch.setattr(search, "sample_space", lambda n, seed: [{"num_trees": 4, "max_depth": 2 + t, "learning_rate": 0.1 * (t + 1)}
                                                                 for t in range(n)])
    fitted, real = [], search._fit

    def counting(folds, path, *args):
        if len(fitted) == 5:
            raise RuntimeError("stopped")
        fitted.append(path)
        real(folds, path, *args)

    monkeypatch.setattr(search, "_fit", counting)
    with pytest.raises(RuntimeError, match="stopped"):
        search.halving_search(data, "id", store, parallelism=1, **kw)
    monkeypatch.setattr(search, "_fit", lambda folds, path, *a: (fitted.append(path), real(folds, path, *a)))
    out = search.halving_search(data, "id", store, **kw).cache()
    assert len(fitted) == len(set(fitted)) == 4 + 2 + 1       # nothing fitted twice
    assert out.groupBy("rung").count().orderBy("rung").collect() == [(0, 4), (1, 2), (2, 1)]
    assert [r[0] for r in out.select("trees").distinct().orderBy("trees").collect()] == [1, 2, 4]
    assert out.where("cv_auc < cv_auc_min or cv_auc > cv_auc_max or cv_auc_min < 0 or cv_auc_max > 1").count() == 0
    for rung, keep in ((0, 2), (1, 1), (2, 1)):
        ranked = [r["promoted"] for r in out.where(F.col("rung") == rung).orderBy(F.desc("cv_auc"), "trial").collect()]
        assert ranked == [True] * keep + [False] * (len(ranked) - keep)
    # a finished search is read back, a fresh one finds the same
    monkeypatch.setattr(search, "_fit", counting)
    assert plain(search.halving_search(data, "id", store, **kw)) == plain(out)
    monkeypatch.setattr(search, "_fit", real)
    again = search.halving_search(data, "id", scratch_path(spark, "search-again"), **kw)
    assert plain(again) == plain(out)
    assert search.best_trial(again).first()["trial"] == search.best_trial(out).first()["trial"]


def test_other_settings_are_refused(spark, data):
    store = scratch_path(spark, "search-settings")
    search._settings(spark, store, {"n_trials": 1})
    search._settings(spark, store, {"n_trials": 1})
    with pytest.raises(ValueError, match="other settings"):
        search._settings(spark, store, {"n_trials": 2})
    with pytest.raises(ValueError, match="eta"):
        search.halving_search(data, "id", store, eta=1)
