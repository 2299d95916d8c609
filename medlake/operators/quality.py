"""Validation and data-quality checks (V1-V11) as table jobs.

Row rules are SQL predicates evaluated in one projection; the verdicts
are aggregates (``count_if``), so a check over any table size is one scan
plus a tiny result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.session import materialize

# fixed values: the medical schema constraints
MEDICAL_RULES: list[tuple[str, str, str]] = [
    # (column, check name, SQL predicate that must hold)
    ("patient_id", "matches ^P\\d{3}$", "patient_id IS NOT NULL AND patient_id RLIKE '^P[0-9]{3}$'"),
    ("age", "int in [18, 120]", "age IS NOT NULL AND age BETWEEN 18 AND 120"),
    ("bmi", "float in [15.0, 50.0]", "bmi IS NOT NULL AND bmi BETWEEN 15.0 AND 50.0"),
    ("disease_risk", "isin {0, 1}", "disease_risk IS NOT NULL AND disease_risk IN (0, 1)"),
]


def _failures(rules: Sequence[tuple[str, str, str]]) -> Column:
    """ARRAY<STRING> of '<column>: <check>' for every rule the row breaks."""
    arr = F.array(*[F.when(~F.coalesce(F.expr(pred), F.lit(False)), F.lit(f"{col}: {name}"))
                    for col, name, pred in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def flag_rows(df: DataFrame, rules: Sequence[tuple[str, str, str]] = MEDICAL_RULES,
              out: str = "failures") -> DataFrame:
    """V1 per row: adds ``failures`` (array of broken rules) and ``is_valid``."""
    missing = [c for c, _, _ in rules if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    f = df.withColumn(out, _failures(rules))
    return f.withColumn("is_valid", F.size(out) == 0)


def valid_rows(df: DataFrame, rules: Sequence[tuple[str, str, str]] = MEDICAL_RULES) -> DataFrame:
    """V1 filter: rows passing every rule."""
    preds = [F.coalesce(F.expr(p), F.lit(False)) for _, _, p in rules]
    cond = preds[0]
    for p in preds[1:]:
        cond = cond & p
    return df.where(cond)


def rule_report(df: DataFrame, rules: Sequence[tuple[str, str, str]] = MEDICAL_RULES) -> DataFrame:
    """V2: every failure, lazily collected: one row per rule with
    ``(column, check, n_failed, n_rows)`` -- one scan for all rules."""
    aggs = [F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(f"f{i}") for i, (_, _, p) in enumerate(rules)]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(n).alias("check"), F.col(f"f{i}").alias("n_failed"))
        for i, (c, n, _) in enumerate(rules)]))
    return wide.select("n_rows", stack.alias("r")).select("r.column", "r.check", "r.n_failed", "n_rows")


def validate(df: DataFrame, rules: Sequence[tuple[str, str, str]] = MEDICAL_RULES) -> tuple[bool, str]:
    """V1 verdict ``(ok, message)`` like the reference's validator."""
    rep = [r for r in rule_report(df, rules).collect() if r["n_failed"] > 0]
    if not rep:
        return True, "ok"
    return False, "; ".join(f"{r['column']} {r['check']}: {r['n_failed']} rows" for r in rep)


def require_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """V3: missing required column names (driver-side, schema only)."""
    return [c for c in required if c not in df.columns]


def null_shares(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.05) -> DataFrame:
    """V5: share of NULL (and NaN for floating columns) per column, one aggregate;
    ``flagged`` when the share is strictly above ``threshold``."""
    cols = list(cols or df.columns)
    float_cols = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def missing(c):
        m = F.col(f"`{c}`").isNull()
        if c in float_cols:
            m = m | F.isnan(F.col(f"`{c}`"))
        return m

    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(missing(c)).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"))
                               for i, c in enumerate(cols)]))
    out = wide.select("n_rows", rows.alias("r")).select("r.column", "r.n_missing", "n_rows")
    share = F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows"))
    return out.withColumn("missing_share", share).withColumn("flagged", F.coalesce(share > F.lit(threshold), F.lit(False)))


def type_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """V6: per column, rows whose non-NULL value does not parse as the
    expected type (``try_cast`` is NULL)."""
    aggs = []
    for i, (c, t) in enumerate(expected.items()):
        v = F.col(f"`{c}`").cast("string")
        aggs.append(F.count_if(v.isNotNull() & v.try_cast(t).isNull()).alias(f"b{i}"))
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("expected"),
                                        F.col(f"b{i}").alias("n_bad")) for i, (c, t) in enumerate(expected.items())]))
    return wide.select("n_rows", rows.alias("r")).select("r.column", "r.expected", "r.n_bad", "n_rows")


def range_check(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """V7: per column, non-NULL values outside the inclusive range."""
    aggs = [F.count_if(F.col(c).isNotNull() & ~F.col(c).between(lo, hi)).alias(f"o{i}")
            for i, (c, (lo, hi)) in enumerate(ranges.items())]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(lo)).alias("lo"),
                                        F.lit(float(hi)).alias("hi"), F.col(f"o{i}").alias("n_out"))
                               for i, (c, (lo, hi)) in enumerate(ranges.items())]))
    return wide.select(rows.alias("r")).select("r.*")


def feature_store_check(features: DataFrame, source: DataFrame, key: str, ts: str, as_of: str,
                        compare: Sequence[str], freshness_seconds: int = 3600,
                        completeness_min: float = 0.99, consistency_min: float = 0.95) -> DataFrame:
    """V8: freshness (as_of - max(ts) <= limit), completeness (share of
    non-NULL cells), consistency (share of rows whose compared columns
    equal the source's, NULL-safe).  One row."""
    cols = list(compare)
    cells = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    s = source.select(key, F.lit(True).alias("__in_src"), *[F.col(c).alias(f"__s_{c}") for c in cols])
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    j = features.join(s, key, "left")
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_ts")
    return j.agg(
        F.max(F.col(ts).cast("timestamp")).alias("last_ts"),
        (F.sum(cells) / (F.count(F.lit(1)) * len(cols))).alias("completeness"),
        F.avg(F.when(F.col("__in_src"), ok.cast("double"))).alias("consistency"),
    ).select(
        "last_ts", age.alias("staleness_seconds"), (age <= freshness_seconds).alias("fresh"),
        "completeness", (F.col("completeness") >= completeness_min).alias("complete"),
        "consistency", (F.col("consistency") >= consistency_min).alias("consistent"))


def heartbeat_gaps(log: DataFrame, pipeline: str, ts: str, max_gap_seconds: int,
                   tiebreak: str | None = None) -> DataFrame:
    """V9 heartbeat: consecutive heartbeats of a pipeline further apart
    than the limit.  The previous beat comes from ``bucketed_lag`` so one
    chatty pipeline is not a single task."""
    from medlake.operators.ordered import bucketed_lag
    order = [ts] + ([tiebreak] if tiebreak else [])
    g = bucketed_lag(log.select(pipeline, ts, *([tiebreak] if tiebreak else [])), order, ts,
                     partition_cols=[pipeline], out="prev_ts")
    gap = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.col("prev_ts").cast("timestamp"))
    return g.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > max_gap_seconds)


def error_rate(log: DataFrame, pipeline: str, ts: str, is_error: Column, window: str = "1 hour",
               limit: float = 0.05) -> DataFrame:
    """V9 error_rate: error share per pipeline and tumbling window, flagged above ``limit``."""
    g = log.groupBy(pipeline, F.window(F.col(ts).cast("timestamp"), window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_error).alias("n_error"))
    return g.withColumn("error_rate", F.col("n_error") / F.col("n")).withColumn(
        "alert", F.col("error_rate") > limit)


def unmapped_codes(codes: DataFrame, code_map: DataFrame, code: str = "code") -> DataFrame:
    """Local codes with no entry in the terminology map (``left_anti``)."""
    return codes.join(code_map.select(code).distinct(), code, "left_anti")


def map_codes(codes: DataFrame, code_map: DataFrame, code: str = "code") -> DataFrame:
    """Attach standard codes (left join keeps unmapped rows with NULL)."""
    return codes.join(code_map, code, "left")


def deterministic_matches(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str
                          ) -> DataFrame:
    """V11 deterministic: pairs whose normalised keys are all equal
    (trimmed, lower-cased strings); an equi-join, so only true matches
    are produced."""
    def norm(df, side):
        return df.select(F.col(left_id if side == "l" else right_id).alias(f"{side}_id"),
                         *[F.lower(F.trim(F.col(k).cast("string"))).alias(f"__k{i}") for i, k in enumerate(keys)])
    a, b = norm(left, "l"), norm(right, "r")
    return a.join(b, [f"__k{i}" for i in range(len(keys))]).select("l_id", "r_id")


def probabilistic_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                          blocks: Sequence[Sequence[str]], weights: dict[str, float], name: str | None = None,
                          max_edits: int = 2, name_weight: float = 2.0, threshold: float = 5.0) -> DataFrame:
    """V11 probabilistic [ours]: candidate pairs come only from equi-joins on
    several blocking keys (each a tuple of fields that must agree exactly) --
    no all-pairs product.  Each candidate is scored by summed agreement
    weights (Fellegi-Sunter style) plus a name similarity bonus (edit distance
    <= ``max_edits``); the best candidate per left record above ``threshold``
    wins (ties by smallest id).

    Records with equal fields score alike, so each set of them is joined once, by
    its smallest id.  Pairs are scored as the join makes them and only the smallest
    ``r_id`` per left set and score is kept, so a task holds left sets, not pairs.
    A record whose id has other fields too is a candidate through any of them; those
    few take the pairs themselves (``_many``)."""
    fields = sorted({f for blk in blocks for f in blk} | set(weights) | ({name} if name else set()))
    a = left.select(F.col(left_id).alias("l_id"), *[F.col(f).alias(f"l_{f}") for f in fields])
    b = right.select(F.col(right_id).alias("r_id"), *[F.col(f).alias(f"r_{f}") for f in fields])

    def versions(df: DataFrame, key: str) -> DataFrame:
        one = df.where(F.col(key).isNotNull()).distinct()
        return one.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(key)) > 1)

    def sets(df: DataFrame, side: str) -> DataFrame:
        return df.where(~F.col("_many")).groupBy(*[f"{side}_{f}" for f in fields]).agg(F.min(f"{side}_id").alias(f"{side}_id"))

    def agree(blk: Sequence[str]) -> Column:
        cond = F.lit(True)
        for f in blk:
            cond = cond & (F.col(f"l_{f}") == F.col(f"r_{f}"))
        return cond

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        """Every pair of records that agrees in a block, in the first such block only."""
        out = None
        for i, blk in enumerate(blocks):
            p = x.join(y, agree(blk))
            for had in blocks[:i]:
                p = p.where(~F.coalesce(agree(had), F.lit(False)))
            out = p if out is None else out.unionByName(p)
        return out

    score = F.lit(0.0)
    for f, w in weights.items():
        score = score + F.when(F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(w)).otherwise(F.lit(0.0))
    if name:
        score = score + F.when(F.levenshtein(F.col(f"l_{name}"), F.col(f"r_{name}")) <= max_edits,
                               F.lit(name_weight)).otherwise(F.lit(0.0))

    def best(scored: DataFrame, key: str = "l_id") -> DataFrame:
        top = scored.where(F.col("score") >= threshold).groupBy(key, "score").agg(F.min("r_id").alias("r_id"))
        return top.groupBy(key).agg(F.max_by(F.struct("r_id", "score"), F.struct(
            F.col("score"), (-F.col("r_id")).alias("neg_id"))).alias("b")).select(key, "b.r_id", "b.score")

    va, vb = versions(a, "l_id"), versions(b, "r_id")
    sa, sb = sets(va, "l"), sets(vb, "r")
    per_set = best(pairs(sa, sb).select("l_id", "r_id", score.alias("score"))).withColumnRenamed("l_id", "_set")
    members = va.where(~F.col("_many")).alias("m").join(sa.withColumnRenamed("l_id", "_set").alias("s"), [
        F.col(f"m.l_{f}").eqNullSafe(F.col(f"s.l_{f}")) for f in fields]).select("m.l_id", "_set")
    plain = members.join(per_set, "_set").select("l_id", "r_id", "score")

    la, lb = va.drop("_many"), vb.drop("_many")
    ids = [pairs(va.where("_many").drop("_many"), lb), pairs(va.where(~F.col("_many")).drop("_many"), vb.where("_many").drop("_many"))]
    again = ids[0].unionByName(ids[1]).select("l_id", "r_id").distinct().join(la, "l_id").join(lb, "r_id")
    return best(plain.unionByName(best(again.select("l_id", "r_id", score.alias("score")))).select("l_id", "r_id", "score"))


def sorted_positions(df: DataFrame, order: Sequence[str], out: str = "pos") -> DataFrame:
    """1-based position of each row in the order of any sortable columns, NULLs first.

    Rows are dealt by ranges of all of ``order`` (which must be unique, so that no value
    is a hot range) and written once, since the ranges come from a sample; positions
    are those inside a range plus the rows of the ranges before it."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select(     # a row for each range
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "__range").withColumn(out, inside + F.col("__before")).drop("__range", "__before")


def neighbour_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, order: Sequence[str],
                    reach: int = 5) -> DataFrame:
    """V11 candidates by sorted neighbourhood: (l_id, r_id) of a left and a right record
    at most ``reach`` places apart in the common order of both tables.

    Places are cut into stretches of ``reach``; a right record is also put in the
    stretches beside its own, so a key meets at most ``reach`` left and ``3 * reach``
    right records however many share one value.  Equal values are ordered by side and
    id, which must be unique in its table."""
    both = left.select(F.col(left_id).alias("id"), F.lit(0).alias("side"), *order).unionByName(
        right.select(F.col(right_id).alias("id"), F.lit(1).alias("side"), *order))
    p = sorted_positions(both, [*order, "side", "id"]).select("id", "side", "pos", F.floor(F.col("pos") / reach).alias("stretch"))
    a = p.where("side = 0").select(F.col("id").alias("l_id"), F.col("pos").alias("i"), "stretch")
    b = p.where("side = 1").select(F.col("id").alias("r_id"), F.col("pos").alias("j"),
                                   F.explode(F.array(*[F.col("stretch") + k for k in (-1, 0, 1)])).alias("stretch"))
    return a.join(b, "stretch").where(F.abs(F.col("i") - F.col("j")) <= reach).select("l_id", "r_id")


def agreement(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, fields: Sequence[str]) -> DataFrame:
    """Distinct pairs with ``pattern``, for each field 1 where both sides agree, 0
    where they differ and -1 (no evidence) where one is NULL."""
    a = left.select(F.col(left_id).alias("l_id"), *[F.col(f).alias(f"l_{f}") for f in fields])
    b = right.select(F.col(right_id).alias("r_id"), *[F.col(f).alias(f"r_{f}") for f in fields])
    state = [F.coalesce((F.col(f"l_{f}") == F.col(f"r_{f}")).cast("int"), F.lit(-1)) for f in fields]
    return pairs.distinct().join(a, "l_id").join(b, "r_id").select("l_id", "r_id", F.array(*state).alias("pattern"))


def fit_agreement(patterns: Sequence[tuple[Sequence[int], int]], n_fields: int, rounds: int = 50,
                  start: tuple[float, float, float] = (0.1, 0.9, 0.1), floor: float = 1e-6) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of matches and each field's probability to agree among matches and
    among others, by ``rounds`` steps of expectation maximisation over counted
    patterns (at most 3 ** n_fields).  Probabilities stay ``floor`` away from 0 and 1;
    fields are taken as independent.  Without patterns the start is returned."""
    share, m, u = start[0], np.full(n_fields, start[1]), np.full(n_fields, start[2])
    if not patterns:
        return share, m, u
    x = np.array([p for p, _ in patterns], dtype=float).reshape(len(patterns), n_fields)
    n = np.array([c for _, c in patterns], dtype=float)
    known, agree = x >= 0, x == 1
    for _ in range(rounds):
        like = [np.where(known, np.where(agree, q, 1 - q), 1.0).prod(axis=1) for q in (m, u)]
        g = share * like[0] / (share * like[0] + (1 - share) * like[1])
        share = float(np.clip((n * g).sum() / n.sum(), floor, 1 - floor))
        m, u = (np.clip((w[:, None] * agree).sum(axis=0) / np.maximum((w[:, None] * known).sum(axis=0), floor), floor, 1 - floor)
                for w in (n * g, n * (1 - g)))
    return share, m, u


def learned_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, orders: Sequence[Sequence[str]],
                    fields: Sequence[str], reach: int = 5, least: float = 0.9, rounds: int = 50) -> DataFrame:
    """V11 with weights learned from the tables: the best right record (ties: smallest
    id) of each left one whose probability of being a match is ``least`` or more, with
    ``score``, the sum of log2 agreement weights.

    Candidates come from one sorted neighbourhood for each of ``orders``; weights are
    fitted to the counts of agreement patterns, the only thing that reaches the driver."""
    cands = None
    for order in orders:
        near = neighbour_pairs(left, right, left_id, right_id, order, reach)
        cands = near if cands is None else cands.unionByName(near)
    pairs = materialize(agreement(cands, left, right, left_id, right_id, fields), "agreement")
    counted = [(r["pattern"], r["n"]) for r in pairs.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()]
    share, m, u = fit_agreement(counted, len(fields), rounds)
    score = F.lit(0.0)
    for k in range(len(fields)):
        s = F.col("pattern")[k]
        score = score + F.when(s == 1, float(np.log2(m[k] / u[k]))).when(s == 0, float(np.log2((1 - m[k]) / (1 - u[k])))).otherwise(0.0)
    cut = float(np.log2(least / (1 - least)) - np.log2(share / (1 - share)))
    best = pairs.select("l_id", "r_id", score.alias("score")).where(F.col("score") >= cut).groupBy("l_id").agg(
        F.min_by(F.struct("r_id", "score"), F.struct(-F.col("score"), F.col("r_id"))).alias("b"))
    return best.select("l_id", "b.r_id", "b.score")


def failing_samples(df: DataFrame, key: str, rules: Sequence[tuple[str, str, str]] = MEDICAL_RULES, k: int = 2,
                    seed: int = 0) -> DataFrame:
    """V2: up to ``k`` failing rows per rule, in a seeded hash order of the
    key (a top-k per group: Spark limits each group before the shuffle)."""
    from medlake.functions.privacy import hash_unit
    hits = F.filter(F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(f"{c}: {n}"))
                              for c, n, p in rules]), lambda x: x.isNotNull())
    e = df.select(key, F.explode(hits).alias("rule"))
    w = Window.partitionBy("rule").orderBy(hash_unit(key, seed=seed), key)
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
