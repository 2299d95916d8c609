"""Model training, scoring and model-level analytics.

Training uses Spark ML estimators (distributed gradient / tree
building); everything around them -- folds, scaling statistics, metrics,
permutations, SHAP, federated averaging, replay buffers -- is DataFrame
work.  Only model parameters (a few numbers per feature) reach the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.operators import metrics
from medlake.operators.ordered import row_index
from medlake.session import ensure_checkpoint_dir, materialize

# fixed values: model defaults of the training loop
LOGISTIC_C = 1.0
LOGISTIC_MAX_ITER = 1000
FOREST_TREES = 200
BOOSTED_TREES = 100
CV_FOLDS = 5
PERMUTATION_REPEATS = 10

#: Rows of a task in the many small jobs of cross-validation: at least the first
#: number, up to the second before there are more tasks than cores.
CV_TASK_ROWS = (1000, 100_000)


# ---------------------------------------------------------------- features

def with_features(df: DataFrame, cols: Sequence[str] | str, out: str = "features") -> DataFrame:
    """Feature vector from numeric columns (``VectorAssembler``) or from
    one ARRAY<FLOAT|DOUBLE> column (``array_to_vector``)."""
    if isinstance(cols, str):
        return df.withColumn(out, array_to_vector(F.col(cols).cast("array<double>")))
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def estimator(kind: str, label: str = "label", features: str = "features", n_rows: int | None = None,
              seed: int = 42, **params):
    """M1/M2/M3 estimators with the reference's defaults.

    Logistic regression: L2 with ``C`` multiplying the *sum* of losses,
    i.e. ``regParam = 1 / (C * n)``, no internal standardisation -- ``train``
    puts a centring scaler in front of it, as the source scales before fitting."""
    if kind == "logistic":
        c = params.get("C", LOGISTIC_C)
        n = n_rows or 1
        return LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0,
                                  standardization=False, maxIter=params.get("max_iter", LOGISTIC_MAX_ITER))
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed,
                                      numTrees=params.get("num_trees", FOREST_TREES),
                                      maxDepth=params.get("max_depth", 5))
    if kind == "gbt":
        return GBTClassifier(featuresCol=features, labelCol=label, seed=seed,
                             maxIter=params.get("num_trees", BOOSTED_TREES), maxDepth=params.get("max_depth", 5),
                             stepSize=params.get("learning_rate", 0.1),
                             subsamplingRate=params.get("subsample", 1.0),
                             featureSubsetStrategy=str(params.get("colsample", "all")))
    raise ValueError(kind)


def positive_probability(scored: DataFrame, out: str = "p") -> DataFrame:
    """Probability of class 1 as a double column."""
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1])


def train(df: DataFrame, kind: str, label: str = "label", features: str = "features", scale: bool = True,
          **params) -> PipelineModel:
    """M1-M3: fit one model.  Logistic regression gets a centring +
    scaling stage first (Spark's ``StandardScaler``: unit *sample* std) and
    the row count for its exact penalty; trees need no scaling."""
    if kind != "logistic":
        return Pipeline(stages=[estimator(kind, label, features, **params)]).fit(df)
    n = df.count()
    stages = []
    feats = features
    if scale:
        from pyspark.ml.feature import StandardScaler
        feats = f"{features}__scaled"
        stages.append(StandardScaler(inputCol=features, outputCol=feats, withMean=True, withStd=True))
    stages.append(estimator(kind, label, feats, n_rows=n, **params))
    return Pipeline(stages=stages).fit(df)


def cv_tasks(rows: int, cores: int) -> int:
    """Tasks of each job of cross-validation.  Every task of the thousands of jobs sends
    its status and metrics to the driver, so tasks beyond the cores come only where
    the rows of one would be too many."""
    least, most = CV_TASK_ROWS
    return max(1, min(-(-rows // least), cores), -(-rows // most))


def cross_validate(df: DataFrame, kinds: Sequence[str], key: str, label: str = "label", features: str = "features",
                   k: int = CV_FOLDS, seed: int = 0, params: dict[str, dict] | None = None,
                   parallelism: int = 4) -> DataFrame:
    """M4: stratified k-fold ROC AUC per model kind (held-out folds, exact
    AUC), plus the training-data AUC of a refit on all rows -- reported
    separately, since the latter is optimistic.  Folds come from I8."""
    from medlake.operators.prep import stratified_folds
    spark = df.sparkSession
    params = params or {}
    cached = stratified_folds(df, label, key, k=k, seed=seed).persist()
    # boosting runs hundreds of jobs over the folds: few rows are not worth many tasks each
    f = cached.coalesce(cv_tasks(cached.count(), spark.sparkContext.defaultParallelism))

    def fold_auc(kind: str, i: int) -> float:
        tr, te = f.where(F.col("fold") != i), f.where(F.col("fold") == i)
        m = train(tr, kind, label, features, **params.get(kind, {}))
        return metrics.roc_auc(positive_probability(m.transform(te)), "p", label).first()["auc"]

    def full_auc(kind: str) -> float:
        full = train(f, kind, label, features, **params.get(kind, {}))
        return metrics.roc_auc(positive_probability(full.transform(f)), "p", label).first()["auc"]

    # Folds are independent jobs: submit them concurrently (like
    # CrossValidator(parallelism)) so small fits share the cluster.
    from concurrent.futures import ThreadPoolExecutor
    rows = []
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            jobs = {kind: ([pool.submit(fold_auc, kind, i) for i in range(k)], pool.submit(full_auc, kind))
                    for kind in kinds}
            for kind in kinds:
                aucs = [x.result() for x in jobs[kind][0]]
                rows.append((kind, float(sum(aucs) / len(aucs)), float(min(aucs)), float(max(aucs)),
                             float(jobs[kind][1].result())))
    finally:
        cached.unpersist()
    return spark.createDataFrame(rows, _CV_SCHEMA)


_CV_SCHEMA = "model string, cv_auc double, cv_auc_min double, cv_auc_max double, train_auc double"


def select_best(results: DataFrame, score: str = "cv_auc", name: str = "model") -> DataFrame:
    """M5: arg-max by score, first name wins ties (a top-1 report)."""
    return results.orderBy(F.col(score).desc(), F.col(name)).limit(1)


# fixed values: hyper-parameter search space (low, high, log-scale)
SEARCH_SPACE = {"num_trees": (100, 1000, False), "max_depth": (3, 10, False), "learning_rate": (1e-5, 0.5, True),
                "subsample": (0.5, 1.0, False), "colsample": (0.6, 1.0, False)}


def sample_space(n_trials: int, seed: int = 42, space=SEARCH_SPACE) -> list[dict]:
    """M6: seeded random draws from the search space (TPE itself is not reproduced)."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n_trials):
        d = {}
        for name, (lo, hi, log) in space.items():
            v = math.exp(rnd.uniform(math.log(lo), math.log(hi))) if log else rnd.uniform(lo, hi)
            d[name] = int(round(v)) if name in ("num_trees", "max_depth") else v
        d["colsample"] = round(d["colsample"], 2)
        out.append(d)
    return out


def random_search(df: DataFrame, key: str, label: str = "label", features: str = "features", n_trials: int = 100,
                  k: int = 3, seed: int = 42) -> DataFrame:
    """M6: k-fold CV ROC AUC of boosted trees for each sampled setting."""
    spark = df.sparkSession
    rows = []
    for i, p in enumerate(sample_space(n_trials, seed)):
        r = cross_validate(df, ["gbt"], key, label, features, k=k, params={"gbt": p}).first()
        rows.append((i, str(p), float(r["cv_auc"])))
    return spark.createDataFrame(rows, "trial int, params string, cv_auc double")


# ---------------------------------------------------------------- scoring

def score(model: PipelineModel, df: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """M7: probability of class 1 rounded to 3 places and its risk category."""
    from medlake.functions.features import categorize
    s = positive_probability(model.transform(df)).withColumn("probability_1", F.round("p", 3))
    return s.withColumn("risk_category", categorize("probability_1", thresholds or {"high": 0.7, "medium": 0.4}))


def save_package(model: PipelineModel, path: str, stats: dict[str, tuple[float, float]], metadata: dict) -> None:
    """M8: model + a metadata table that also stores the training feature
    means / stds the production monitor needs."""
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    rows = [(k, float(m) if m is not None else None, float(s) if s is not None else None) for k, (m, s) in stats.items()]
    ss.createDataFrame(rows, "feature string, mean double, std double").write.mode("overwrite").parquet(
        f"{path}/feature_stats")
    ss.createDataFrame([(k, str(v)) for k, v in metadata.items()], "key string, value string").write.mode(
        "overwrite").parquet(f"{path}/metadata")


def load_package(spark, path: str) -> tuple[PipelineModel, DataFrame, DataFrame]:
    return (PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/feature_stats"),
            spark.read.parquet(f"{path}/metadata"))


# ---------------------------------------------------------------- explanations

def permutation_importance(model: PipelineModel, df: DataFrame, feature_cols: Sequence[str], key: str,
                           label: str = "label", repeats: int = PERMUTATION_REPEATS, seed: int = 0,
                           top_n: int | None = None) -> DataFrame:
    """M9: mean drop of ROC AUC when one feature column is permuted.

    A repeat has one permutation that all features share: rows are ranked by
    key and by a seeded hash, and one equi-join on the rank brings each row its
    donor, so ranking and join handle ``repeats`` copies whatever the number of
    features.  A projection then swaps one feature at a time, and the exact AUC
    is computed per (feature, repeat)."""
    feats = list(feature_cols)
    base_scored = positive_probability(model.transform(with_features(df, feats)))
    base_auc = metrics.roc_auc(base_scored, "p", label).first()["auc"]
    own = df.select(key, label, F.array(*[F.col(f).cast("double") for f in feats]).alias("__own"))
    orig = row_index(own, [key], out="pos").withColumn("rep", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    rnd = orig.withColumn("__h", F.xxhash64(F.col(key), F.col("rep"), F.lit(seed)))
    donor = (row_index(rnd, ["__h", key], partition_cols=["rep"], out="src_pos")
             .select("rep", F.col("src_pos").alias("pos"), F.col("__own").alias("__donor")))
    perm = (orig.join(donor, ["rep", "pos"])
            .select(key, label, "rep", "__own", "__donor", F.posexplode(F.array(*[F.lit(f) for f in feats])).alias("__i", "feature"))
            .select(key, label, "rep", "feature", F.transform("__own", lambda v, k: F.when(
                k == F.col("__i"), F.get("__donor", k)).otherwise(v)).alias("__vals")))
    s = positive_probability(model.transform(with_features(perm, "__vals")))
    auc = metrics.roc_auc(s, "p", label, ["feature", "rep"])
    imp = auc.groupBy("feature").agg((F.lit(base_auc) - F.avg("auc")).alias("importance_mean"),
                                     F.stddev_pop(F.lit(base_auc) - F.col("auc")).alias("importance_std"))
    ranked = imp.orderBy(F.col("importance_mean").desc(), "feature")
    return ranked.limit(top_n) if top_n else ranked


def linear_shap(df: DataFrame, model: PipelineModel, feature_cols: Sequence[str], means: dict[str, float],
                key: str) -> DataFrame:
    """Exact SHAP of a linear (logistic) model in log-odds:
    phi_j = w_j * (x_j - E[x_j]); one column per feature."""
    lr = model.stages[-1]
    w = lr.coefficients.toArray().tolist()
    if len(model.stages) > 1 and hasattr(model.stages[0], "std"):  # fitted scaler in front
        sd = model.stages[0].std.toArray().tolist()
        w = [wi / s if s else 0.0 for wi, s in zip(w, sd)]
    return df.select(key, *[(F.lit(w[i]) * (F.col(f) - F.lit(means[f]))).alias(f"shap_{f}")
                            for i, f in enumerate(feature_cols)])


def mean_abs_shap(shap: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """M10 summary: mean |phi| per feature, as rows."""
    wide = shap.agg(*[F.avg(F.abs(F.col(f"shap_{f}"))).alias(f) for f in feature_cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_shap"))
                                           for f in feature_cols])).alias("s")).select("s.*")


# ---------------------------------------------------------------- online / federated

def gradient_step(batch: DataFrame, weights: Sequence[float], bias: float, vec: str, label: str,
                  lr: float = 0.1) -> tuple[list[float], float]:
    """One mini-batch logistic-regression gradient step; the gradient
    sum((p - y) x) is ONE aggregate over the batch (posexplode + groupBy)."""
    d = len(weights)
    w = F.array(*[F.lit(float(x)) for x in weights])
    z = F.aggregate(F.zip_with(F.col(vec).cast("array<double>"), w, lambda a, b: a * b), F.lit(float(bias)),
                    lambda acc, x: acc + x)
    err = (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))) - F.col(label)
    g = batch.select(err.alias("err"), F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    grads = g.groupBy("i").agg(F.sum(F.col("err") * F.col("x")).alias("g"), F.count(F.lit(1)).alias("n"))
    gb = batch.select(err.alias("err")).agg(F.sum("err").alias("g"), F.count(F.lit(1)).alias("n")).first()
    gi = {r["i"]: (r["g"], r["n"]) for r in grads.collect()}  # d numbers
    new_w = [weights[i] - lr * gi[i][0] / gi[i][1] if i in gi else weights[i] for i in range(d)]
    new_b = bias - lr * (gb["g"] / gb["n"]) if gb["n"] else bias
    return new_w, new_b


def uncertain_cases(scored: DataFrame, p: str = "p", band: float = 0.3) -> DataFrame:
    """Cases with |p - 0.5| < band (strict), closest to 0.5 first."""
    d = F.abs(F.col(p) - 0.5)
    return scored.where(d < band).withColumn("uncertainty", F.lit(0.5) - d)


def covariate_shift_weights(new: DataFrame, old: DataFrame, features: str = "features", key: str | None = None
                            ) -> DataFrame:
    """Fit new(1)-vs-old(0) and weight each new row by P(new | x)."""
    both = new.withColumn("__is_new", F.lit(1.0)).unionByName(old.withColumn("__is_new", F.lit(0.0)))
    m = train(both, "logistic", "__is_new", features)
    return positive_probability(m.transform(new), "weight").drop("rawPrediction", "probability", "prediction")


def federated_average(site_models: DataFrame, weight_col: str | None = None) -> DataFrame:
    """Unweighted (or ``weight_col``-weighted) mean of each coefficient
    over sites; ``site_models`` holds (site, coefficients ARRAY<DOUBLE>, n)."""
    e = site_models.select("site", F.posexplode("coefficients").alias("pos", "w"),
                           *([weight_col] if weight_col else []))
    if weight_col:
        agg = (F.sum(F.col("w") * F.col(weight_col)) / F.sum(weight_col)).alias("w")
    else:
        agg = F.avg("w").alias("w")
    return e.groupBy("pos").agg(agg)


def replay_buffer(events: DataFrame, shard: str, ts: str, tiebreak: str, capacity: int = 1000) -> DataFrame:
    """M15 store: the most recent ``capacity`` cases per shard (a top-k per
    group; Spark pushes the limit below the shuffle via WindowGroupLimit)."""
    w = Window.partitionBy(shard).orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    return events.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= capacity)


def replay_sample(buffer: DataFrame, shard: str, batch: int, seed: int = 0) -> DataFrame:
    """M15 sample: ``batch`` draws WITH replacement per shard: draw j picks
    slot 1 + floor(u(shard, j) * size), u a seeded hash uniform, joined back
    on (shard, slot)."""
    from medlake.functions.privacy import hash_unit
    sizes = buffer.groupBy(shard).agg(F.max("slot").alias("size"))
    draws = sizes.select(shard, "size", F.explode(F.sequence(F.lit(1), F.lit(batch))).alias("draw"))
    draws = draws.withColumn("slot", (F.floor(hash_unit(shard, "draw", seed=seed) * F.col("size")) + 1).cast("int"))
    return draws.join(buffer, [shard, "slot"]).drop("size")


# ---------------------------------------------------------------- I6 SMOTE

#: Bytes of vectors in a block of the neighbour search.
NEAR_BYTES = 8 << 20


def _nearest_block(k: int):
    """The ``k`` nearest members of each query of one block pair: (a, b, d).

    Products choose the members that can be among the nearest, with a slack
    for their rounding; the distances themselves are sums of squared
    differences.  Of members with equal vectors only the ``k + 1`` smallest
    keys can be wanted (one may be the query itself)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("a")))  # positions order as keys do
        key = table.column("a").combine_chunks()
        query = table.column("query").to_numpy()
        dim = table.column("dim")[0].as_py()
        x = np.concatenate([c.flatten().to_numpy() for c in table.column("x").chunks]).reshape(-1, dim)
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        out_q, out_m, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(q) and len(m):
            code = pc.rank(key, sort_keys="ascending", tiebreaker="dense").to_numpy()
            one, inv = np.unique(x[m], axis=0, return_inverse=True)
            inv = inv.ravel()
            by = np.argsort(inv, kind="stable")
            many = np.bincount(inv)
            copy = np.arange(len(m)) - np.repeat(np.cumsum(many) - many, many)
            kept = m[by[copy <= k]]
            many = np.minimum(many, k + 1)
            first = np.cumsum(many) - many
            size = (one * one).sum(axis=1)
            most = min(k + 1, len(one))
            for lo in range(0, len(q), 256):
                part = q[lo:lo + 256]
                own = (x[part] * x[part]).sum(axis=1)
                near = own[:, None] + size[None, :] - 2 * (x[part] @ one.T)
                slack = 8 * (dim + 4) * np.finfo(np.float64).eps * (own + size.max())
                at, col = np.nonzero(near <= (np.partition(near, most - 1, axis=1)[:, most - 1] + slack)[:, None])
                d = np.concatenate([((x[part[at[i:i + 8192]]] - one[col[i:i + 8192]]) ** 2).sum(axis=1)
                                    for i in range(0, len(at), 8192)])
                n = many[col]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, j, d = part[np.repeat(at, n)], kept[np.repeat(first[col], n) + step], np.repeat(d, n)
                other = code[i] != code[j]
                i, j, d = i[other], j[other], d[other]
                best = np.lexsort((j, d, i))
                i, j, d = i[best], j[best], d[best]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                out_q.append(i[rank < k])
                out_m.append(j[rank < k])
                out_d.append(d[rank < k])
        return pa.table({"a": key.take(pa.array(np.concatenate(out_q))), "b": key.take(pa.array(np.concatenate(out_m))),
                         "d": pa.array(np.concatenate(out_d), pa.float64())})
    return run


#: Most pivots, and most points they are picked from; these reach the driver.
MAX_PIVOTS, MAX_PICK = 1024, 4096


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the points, each the farthest from those taken before."""
    taken, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(taken) < most and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[taken[-1]]) ** 2).sum(axis=1))
    return x[taken]


def _cells(points: DataFrame, k: int, n: int, pivots: int | None) -> tuple[DataFrame, DataFrame]:
    """Points by their nearest pivot, and which cells must meet.

    Returns (a, x, dim, cell, r) with the distance r to the pivot, and (dim, cell, to,
    least): a member of ``cell`` can be among the ``k`` nearest of a point of cell
    ``to`` only if its r is ``least`` or more.  By the triangle inequality: every point
    of ``to`` has its k nearest within t = R + u, where R is the cell's radius and u
    the (k + 1)-th smallest of (distance of pivots + r) over all cells, and a member is
    at least (distance of pivots) - R - r away."""
    spark = points.sparkSession
    want = pivots or max(1, min(MAX_PIVOTS, math.isqrt(max(n, 1))))
    p = points.select("a", F.col("x").cast("array<double>").alias("x"), F.size("x").alias("dim"))
    want = min(want, MAX_PIVOTS)
    pick = p.orderBy(F.xxhash64("a"), "a").limit(min(4 * want, MAX_PICK)).collect()
    by_dim = {d: _spread(np.array([r["x"] for r in pick if r["dim"] == d]), want) for d in {r["dim"] for r in pick}}
    kind = points.schema["a"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            dims, xs = batch.column("dim").to_numpy(), batch.column("x")
            cell, r = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at, centre = np.flatnonzero(dims == d), by_dim.get(d)
                if centre is None:
                    continue            # a dimension without a pivot is one cell
                for lo in range(0, len(at), 256):
                    rows = at[lo:lo + 256]
                    x = xs.take(pa.array(rows)).flatten().to_numpy().reshape(-1, d)
                    near = (x * x).sum(axis=1)[:, None] + (centre * centre).sum(axis=1)[None, :] - 2 * (x @ centre.T)
                    cell[rows] = near.argmin(axis=1)
                    r[rows] = np.sqrt(((x - centre[cell[rows]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r)], names=["a", "x", "dim", "cell", "r"])

    ensure_checkpoint_dir(spark)
    placed = materialize(p.mapInArrow(place, f"a {kind}, x array<double>, dim int, cell int, r double"), "nearest-cells")
    w = Window.partitionBy("dim", "cell").orderBy("r")
    few = placed.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= k + 1).groupBy("dim", "cell").agg(
        F.sort_array(F.collect_list("r")).alias("low"))
    stats = placed.groupBy("dim", "cell").agg(F.max("r").alias("radius")).join(few, ["dim", "cell"]).collect()   # one row a cell
    rows = []
    for d in {s["dim"] for s in stats}:
        own = [s for s in stats if s["dim"] == d]
        ids, radius = [s["cell"] for s in own], np.array([s["radius"] for s in own])
        centre = by_dim[d][ids] if d in by_dim else np.zeros((1, 1))
        apart = np.stack([np.sqrt(((centre - c) ** 2).sum(axis=1)) for c in centre])
        for i in range(len(ids)):
            reach = np.sort(np.concatenate([apart[i, j] + np.array(s["low"]) for j, s in enumerate(own)]))
            u = reach[k] if len(reach) > k else np.inf
            least = apart[i] - 2 * radius[i] - u
            least -= 1e-9 * (apart[i] + radius[i] + (u if np.isfinite(u) else 0.0))
            rows += [(d, ids[j], ids[i], float(least[j])) for j in range(len(ids)) if least[j] <= radius[j]]
    return placed, spark.createDataFrame(rows, "dim int, cell int, to int, least double")


def nearest_neighbours(points: DataFrame, k: int, n: int, block: int | None = None, pivots: int | None = None) -> DataFrame:
    """(a, b, d, rank): the exact ``k`` nearest other points of each of the
    ``n`` points (a, x), by squared distance and then key.

    Points are dealt to cells by their nearest of ``pivots`` points (about the root of
    ``n`` if None, at most ``MAX_PIVOTS``), and a cell meets only the points that the
    triangle inequality leaves as possible neighbours (see ``_cells``): far parts of
    the table never meet.  Without structure in the data every pair is possible and
    the work is quadratic.  A cell's points and its possible neighbours meet in blocks
    of ``block`` points (as many as ``NEAR_BYTES`` hold if None), so no task holds a
    cell.  Points compare within their dimension; null, empty and not finite vectors
    have no neighbours."""
    length = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    points = points.where(F.col("a").isNotNull() & (F.size("x") > 0) & (length < 1e300))
    if block is None:
        dim = points.agg(F.max(F.size("x"))).first()[0] or 1
        block = max(1, min(NEAR_BYTES // (8 * dim), max(512, -(-n // 8))))
    placed, meets = _cells(points, k, n, pivots)
    member = placed.join(F.broadcast(meets), ["dim", "cell"]).where(F.col("r") >= F.col("least")).select("a", "x", "dim", F.col("to").alias("cell"))
    shape = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("rows")).join(
        member.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("cols")), ["dim", "cell"])
    # one row a cell
    shape = F.broadcast(materialize(shape, "nearest-shape"))

    def spot(parts: str) -> Column:
        return F.pmod(F.xxhash64("a"), F.col(parts)).cast("int")

    def each(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    names = ["a", "x", "dim", "cell", "i", "j", "query"]
    both = placed.join(shape, ["dim", "cell"]).select("a", "x", "dim", "cell", spot("rows").alias("i"), each("cols").alias("j"),
                                                      F.lit(True).alias("query")).select(*names).union(
        member.join(shape, ["dim", "cell"]).select("a", "x", "dim", "cell", each("rows").alias("i"), spot("cols").alias("j"),
                                                   F.lit(False).alias("query")).select(*names))
    kind = points.schema["a"].dataType.simpleString()
    got = both.groupBy("dim", "cell", "i", "j").applyInArrow(_nearest_block(k), f"a {kind}, b {kind}, d double")
    w = Window.partitionBy("a").orderBy("d", "b")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def smote(df: DataFrame, vec: str, label: str, key: str, minority: int = 1, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority samples new = x + u * (neighbour - x) until the
    classes balance, u uniform from a hash of (key, draw, seed).

    Neighbours are the exact k nearest minority points; every minority point
    that has one is a possible seed, and the interpolation is exact.  Returns
    the synthetic rows only (same columns as the input's key/label/vector plus
    ``synthetic``)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_min = counts.get(minority, 0)
    n_maj = max(v for c, v in counts.items() if c != minority) if len(counts) > 1 else 0
    need = n_maj - n_min
    if need <= 0 or n_min < 2:
        return df.limit(0).withColumn("synthetic", F.lit(True))
    mino = df.where(F.col(label) == minority).select(F.col(key).alias("a"), F.col(vec).cast("array<double>").alias("x"))
    ensure_checkpoint_dir(df.sparkSession)
    nb = materialize(nearest_neighbours(mino, k, n_min), "smote-neighbours")
    deg = nb.groupBy("a").agg(F.max("rank").alias("deg"))
    n_src = deg.count()  # all minority points with a neighbour
    if not n_src:
        return df.limit(0).withColumn("synthetic", F.lit(True))
    per = math.ceil(need / n_src)
    draws = deg.select("a", "deg", F.explode(F.sequence(F.lit(1), F.lit(per))).alias("draw"))
    draws = draws.withColumn("rank", (F.pmod(F.xxhash64("a", "draw", F.lit(seed)), F.col("deg")) + 1).cast("int"))
    j = draws.join(nb, ["a", "rank"])
    src = df.select(F.col(key).alias("a"), F.col(vec).cast("array<double>").alias("xa"))
    dst = df.select(F.col(key).alias("b"), F.col(vec).cast("array<double>").alias("xb"))
    j = j.join(src, "a").join(dst, "b")
    u = (F.pmod(F.xxhash64("a", "draw", F.lit(seed + 1)), F.lit(1 << 30)).cast("double") / float(1 << 30))
    syn = j.select(F.concat_ws("_", F.lit("syn"), F.col("a").cast("string"), F.col("draw").cast("string")).alias(key),
                   F.lit(minority).alias(label),
                   F.zip_with("xa", "xb", lambda x, y: x + u * (y - x)).alias(vec),
                   F.xxhash64("a", "draw", F.lit(seed + 2)).alias("__order"))
    # exactly `need` samples: the first ones in a seeded hash order (the count is the feature)
    ranked = row_index(syn, ["__order", key], out="__n")
    return ranked.where(F.col("__n") <= need).drop("__n", "__order").withColumn("synthetic", F.lit(True))
