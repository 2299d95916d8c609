"""Registered queries for model training, scoring and model analytics (M, I6).

Training data: ``embeddings`` (64-d vectors) with the binary target
``label >= 5``; the permutation / SHAP queries use all dimensions as named
columns.  These are checked by row count (no SQL oracle) except
where the result is SQL-expressible (M11, M12, M15).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.operators import metrics, ml, search
from medlake.operators.prep import fit_standard, train_test_split
from medlake.plans.catalog import register
from medlake.session import scratch_path
from medlake.sources.derived import derived
from medlake.sources.tables import table

DIMS = [f"e{i}" for i in range(64)]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") >= 5).cast("double").alias("label"))


def _split(spark, sf):
    return ml.with_features(train_test_split(_emb(spark, sf), "vec_id", 0.2, 42), "embedding")


def _holdout(spark, sf, kind, **params):
    d = _split(spark, sf)
    tr, te = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    m = ml.train(tr, kind, "label", **params)
    s = ml.positive_probability(m.transform(te))
    a = metrics.roc_auc(s, "p", "label").select(F.lit(kind).alias("model"), r6("auc").alias("test_auc"))
    c = metrics.classification_metrics(s, "p", "label").select(F.lit(kind).alias("model"),
                                                               r6("accuracy").alias("test_accuracy"),
                                                               r6("f1").alias("test_f1"))
    return a.join(c, "model")


@register("M1_logistic_holdout")
def m1(spark, sf):
    return _holdout(spark, sf, "logistic")


@register("M2_random_forest_holdout")
def m2(spark, sf):
    return _holdout(spark, sf, "random_forest")


@register("M3_boosted_trees_holdout")
def m3(spark, sf):
    return _holdout(spark, sf, "gbt")


@register("M4_cross_validation")
def m4(spark, sf):
    d = ml.with_features(_emb(spark, sf), "embedding")
    return ml.cross_validate(d, ["logistic", "random_forest", "gbt"], "vec_id", "label", k=ml.CV_FOLDS)


@register("M5_best_model")
def m5(spark, sf):
    return ml.select_best(m4(spark, sf))


@register("M6_hyperparameter_search")
def m6(spark, sf, n_trials: int = 4):
    d = ml.with_features(_emb(spark, sf), "embedding").select("vec_id", "label", "features")
    out = search.halving_search(d, "vec_id", scratch_path(spark, "m6-search"), n_trials=n_trials, least_trees=1)
    return out.select("rung", "trial", "trees", r6("cv_auc").alias("cv_auc"), "promoted")


def _lr_model(spark, sf):
    d = _split(spark, sf)
    return ml.train(d.where(~F.col("is_test")), "logistic", "label"), d


@register("M7_batch_scoring")
def m7(spark, sf):
    m, d = _lr_model(spark, sf)
    return ml.score(m, d).select("vec_id", "probability_1", "risk_category")


@register("M8_save_load_roundtrip")
def m8(spark, sf):
    m, d = _lr_model(spark, sf)
    path = scratch_path(spark, "m8-package")
    train = d.where(~F.col("is_test")).select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIMS)])
    ml.save_package(m, path, fit_standard(train, DIMS), {"model": "logistic", "label": "label >= 5"})
    loaded, stats, meta = ml.load_package(spark, path)
    a = ml.positive_probability(m.transform(d)).select("vec_id", F.col("p").alias("p1"))
    b = ml.positive_probability(loaded.transform(d)).select("vec_id", F.col("p").alias("p2"))
    return a.join(b, "vec_id").select("vec_id", (F.abs(F.col("p1") - F.col("p2")) < 1e-12).alias("same"))


def _dims(spark, sf):
    e = _emb(spark, sf)
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIMS)])


@register("M9_permutation_importance")
def m9(spark, sf):
    d = _dims(spark, sf)
    m = ml.train(ml.with_features(d, DIMS), "logistic", "label")
    imp = ml.permutation_importance(m, d, DIMS, "vec_id", "label", repeats=ml.PERMUTATION_REPEATS, top_n=5)
    return imp.select("feature", r6("importance_mean").alias("importance_mean"))


@register("M10_linear_shap")
def m10(spark, sf):
    d = _dims(spark, sf)
    stats = fit_standard(d, DIMS)
    m = ml.train(ml.with_features(d, DIMS), "logistic", "label")
    sh = ml.linear_shap(d, m, DIMS, {k: v[0] for k, v in stats.items()}, "vec_id")
    return ml.mean_abs_shap(sh, DIMS).withColumn("mean_abs_shap", r6("mean_abs_shap"))


@register("M11_gradient_step")
def m11(spark, sf):
    e = _emb(spark, sf)
    w, b = ml.gradient_step(e, [0.0] * 64, 0.0, "embedding", "label", lr=0.1)
    rows = [(i, round(x, 6)) for i, x in enumerate(w)] + [(-1, round(b, 6))]
    return spark.createDataFrame(rows, "i int, weight double")


@register("M12_uncertain_cases")
def m12(spark, sf):
    u = ml.uncertain_cases(derived(spark, sf, "predictions"), "p", 0.3)
    return u.select("event_id", r6("uncertainty").alias("uncertainty"))


@register("M13_covariate_shift_weights")
def m13(spark, sf):
    d = ml.with_features(_emb(spark, sf), "embedding")
    new, old = d.where("vec_id % 3 = 0"), d.where("vec_id % 3 <> 0")
    return ml.covariate_shift_weights(new, old).select("vec_id", r6("weight").alias("weight"))


@register("M14_federated_average")
def m14(spark, sf):
    d = ml.with_features(_emb(spark, sf), "embedding").withColumn("site", (F.col("vec_id") % 4).cast("int"))
    rows = []
    for s in range(4):  # one distributed fit per site
        part = d.where(F.col("site") == s)
        m = ml.train(part, "logistic", "label", scale=False)  # shared (unit-norm) feature scale across sites
        rows.append((s, m.stages[-1].coefficients.toArray().tolist()))  # on each site's own scaling
    sm = spark.createDataFrame(rows, "site int, coefficients array<double>")
    return ml.federated_average(sm).withColumn("w", r6("w"))


@register("M15_replay_buffer")
def m15(spark, sf):
    b = ml.replay_buffer(derived(spark, sf, "predictions"), "model", "ts", "event_id", 1000)
    return b.select("model", "event_id", "slot")


@register("M15_replay_sample")
def m15b(spark, sf):
    b = ml.replay_buffer(derived(spark, sf, "predictions"), "model", "ts", "event_id", 1000)
    return ml.replay_sample(b, "model", 64).select("model", "draw", "slot", "event_id")


@register("I6_smote_samples")
def i6(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") >= 7).cast("int").alias("y"))
    s = ml.smote(e, "embedding", "y", "vec_id", minority=1, k=5)
    return s.select("vec_id", "y", F.size("embedding").alias("dim"))


@register("I6_smote_balance")
def i6b(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") >= 7).cast("int").alias("y"))
    s = ml.smote(e, "embedding", "y", "vec_id", minority=1, k=5)
    # a sample lies between its seed and another minority point, so inside their bounds
    box = e.where("y = 1").select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(
        F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    out = s.select("vec_id", F.posexplode("embedding").alias("i", "v")).join(box, "i").agg(
        F.count_if((F.col("v") < F.col("lo") - 1e-9) | (F.col("v") > F.col("hi") + 1e-9)).alias("n_outside"))
    return s.agg(F.count("*").alias("n_samples"), F.countDistinct("vec_id").alias("n_ids"),
                 F.min(F.size("embedding")).alias("dim")).join(F.broadcast(out))
