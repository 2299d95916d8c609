"""Registered queries for validation (V), features (P), joins (J),
preparation (I), EDA (N) and column-level privacy (A1-A5, A8-A11, A22).

Each reads whole landed tables (or projections Spark derives from them).
Doubles are rounded to 6 places so engines agree to the last digit shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlake.functions import features as fx
from medlake.functions import privacy as px
from medlake.operators import joins, prep, quality
from medlake.plans.catalog import register
from medlake.sources.derived import derived, zone_rings
from medlake.sources.tables import table


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _medical_with_age_bmi(spark, sf):
    return derived(spark, sf, "medical").withColumn("age", fx.age_from_birth_year("birth_year", 2024)) \
        .withColumn("bmi", fx.bmi("weight_kg", "height_m"))


# ---------------------------------------------------------------- V
@register("V1_flag_medical_rows")
def v1(spark: SparkSession, sf: str) -> DataFrame:
    f = quality.flag_rows(_medical_with_age_bmi(spark, sf))
    return f.select("patient_id", "is_valid", F.size("failures").alias("n_failures"),
                    F.array_join("failures", "; ").alias("failures"))


@register("V2_rule_failure_report")
def v2(spark, sf):
    return quality.rule_report(_medical_with_age_bmi(spark, sf))


@register("V4_duplicate_keys")
def v4(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@register("V5_missing_value_shares")
def v5(spark, sf):
    j = derived(spark, sf, "medical").join(derived(spark, sf, "lifestyle"), "patient_id", "left")
    out = quality.null_shares(j, ["fasting_glucose", "triglycerides", "smoking_status", "alcohol_consumption",
                                  "diet_quality", "hdl_cholesterol"], threshold=0.05)
    return out.withColumn("missing_share", r6("missing_share"))


@register("V6_type_check")
def v6(spark, sf):
    return quality.type_check(derived(spark, sf, "medical"),
                              {"blood_pressure": "int", "patient_id": "int", "zip_code": "string",
                               "birth_year": "double"})


@register("V7_range_check")
def v7(spark, sf):
    return quality.range_check(derived(spark, sf, "medical"),
                               {"weight_kg": (50.0, 100.0), "height_m": (1.5, 1.9), "fasting_glucose": (70.0, 170.0)})


@register("V8_feature_store_check")
def v8(spark, sf):
    feats = derived(spark, sf, "medical").select("patient_id", "exam_date", "weight_kg", "hdl_cholesterol",
                                                "fasting_glucose")
    src = table(spark, sf, "customer").selectExpr(
        "printf('P%03d', c_custkey) AS patient_id",
        "cast(50 + (c_custkey * 13) % 60 + CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END AS double) AS weight_kg",
        "cast(30 + (c_custkey * 5) % 50 as double) AS hdl_cholesterol",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE cast(70 + (c_custkey * 17) % 110 as double) END AS fasting_glucose")
    out = quality.feature_store_check(feats, src, "patient_id", "exam_date", "2024-12-31 12:00:00",
                                      ["weight_kg", "hdl_cholesterol", "fasting_glucose"])
    return out.select(F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"),
                      F.col("staleness_seconds").cast("long").alias("staleness_seconds"), "fresh",
                      r6("completeness").alias("completeness"), "complete",
                      r6("consistency").alias("consistency"), "consistent")


def _pipeline_log(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "cast(user_id % 4 as int) AS pipeline", "ts",
                                                 "event_type = 'error' AS is_error")


@register("V9_heartbeat_gaps")
def v9a(spark, sf):
    g = quality.heartbeat_gaps(_pipeline_log(spark, sf), "pipeline", "ts", max_gap_seconds=1800,
                               tiebreak="event_id")
    return g.select("pipeline", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                    F.col("gap_seconds").cast("long").alias("gap_seconds"))


@register("V9_error_rate_windows")
def v9b(spark, sf):
    g = quality.error_rate(_pipeline_log(spark, sf), "pipeline", "ts", F.col("is_error"), "1 day", 0.3)
    return g.select("pipeline", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "n", "n_error", r6("error_rate").alias("error_rate"), "alert")


def _code_map(spark, sf):
    return table(spark, sf, "part").where("p_partkey % 50 < 40").selectExpr(
        "printf('D%02d', p_partkey % 50) AS code", "p_brand AS standard_code").groupBy("code").agg(
        F.min("standard_code").alias("standard_code"))


@register("V10_unmapped_codes")
def v10(spark, sf):
    codes = derived(spark, sf, "meds").select(F.col("drug").alias("code")).distinct()
    return quality.unmapped_codes(codes, _code_map(spark, sf), "code")


@register("V10_mapped_code_counts")
def v10b(spark, sf):
    m = derived(spark, sf, "meds").select(F.col("drug").alias("code"))
    j = quality.map_codes(m, _code_map(spark, sf), "code")
    return j.groupBy("standard_code").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- P
@register("P1_P2_age_bmi")
def p12(spark, sf):
    m = _medical_with_age_bmi(spark, sf)
    return m.select("patient_id", "age", r6("bmi").alias("bmi"))


@register("P3_metabolic_score")
def p3(spark, sf):
    m = derived(spark, sf, "medical")
    return m.select("patient_id", r6(fx.metabolic_score()).alias("metabolic_score"))


@register("P4_lifestyle_risk")
def p4(spark, sf):
    life = derived(spark, sf, "lifestyle")
    return life.select("patient_id", r6(fx.lifestyle_risk()).alias("lifestyle_risk"))


def _zones(spark, sf):
    return zone_rings(derived(spark, sf, "zones"))


@register("P5_pollution_index_spatial")
def p5(spark, sf):
    m = derived(spark, sf, "medical").select("patient_id", "longitude", "latitude", "years_in_location")
    z = joins.spatial_within_join(m, _zones(spark, sf).select("zip_code", "ring", "pm2_5", "no2_level"))
    idx = fx.pollution_index()
    return z.select("patient_id", F.col("zip_code").alias("zone"), r6(idx).alias("pollution_index"),
                    r6(fx.cumulative_exposure(idx)).alias("cumulative_exposure"))


@register("P6_J3_pollution_exposure")
def p6(spark, sf):
    m = derived(spark, sf, "medical").select("patient_id", "zip_code")
    z = joins.key_join(m, derived(spark, sf, "zones").select("zip_code", "pm2_5"), "zip_code",
                       broadcast_right_rows=100_000)
    return z.select("patient_id", r6(fx.pollution_exposure()).alias("pollution_exposure"))


def activity_frequencies(df: DataFrame, col: str) -> DataFrame:
    """P7 fit: share of each value among non-NULL values (one group-by)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(col, (F.col("n") / F.sum("n").over(Window.partitionBy()))
                         .alias("activity_score"))


@register("P7_activity_score")
def p7(spark, sf):
    life = derived(spark, sf, "lifestyle")
    freq = activity_frequencies(life, "exercise_frequency")
    j = life.join(joins.bounded_broadcast(freq, 100_000), "exercise_frequency", "left")
    return j.select("patient_id", r6("activity_score").alias("activity_score"))


@register("P9_risk_category_counts")
def p9(spark, sf):
    p = derived(spark, sf, "predictions")
    cat = fx.categorize("p", {"high": 0.7, "medium": 0.4})
    return p.groupBy("model", cat.alias("risk_category")).agg(F.count(F.lit(1)).alias("n"))


@register("P10_kbins_quantile")
def p10(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice")
    edges = prep.kbins_quantile_edges(li, "l_extendedprice", 5)
    b = li.select(prep.kbins_apply("l_extendedprice", edges).alias("bin"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@register("P11_digitize_age")
def p11(spark, sf):
    m = _medical_with_age_bmi(spark, sf)
    return m.groupBy(fx.digitize("age", [30, 45, 60, 75]).alias("age_bin")).agg(F.count(F.lit(1)).alias("n"))


@register("P12_generalize_bmi")
def p12g(spark, sf):
    m = _medical_with_age_bmi(spark, sf)
    g = fx.generalize_ranges("bmi", [("under", 0.0, 18.5), ("normal", 18.5, 25.0), ("over", 25.0, 30.0),
                                     ("obese", 30.0, 45.0)])
    return m.groupBy(g.alias("bmi_group")).agg(F.count(F.lit(1)).alias("n"))


@register("P13_blood_pressure_parse")
def p13(spark, sf):
    m = derived(spark, sf, "medical")
    s, d = fx.blood_pressure_parts("blood_pressure")
    return m.select("patient_id", s.alias("systolic"), d.alias("diastolic"))


# ---------------------------------------------------------------- J
@register("J1_medical_lifestyle_join")
def j1(spark, sf):
    j = joins.key_join(derived(spark, sf, "medical").select("patient_id", "sex", "zip_code"),
                       derived(spark, sf, "lifestyle"), "patient_id")
    return j


@register("J2_zip_zone_join")
def j2(spark, sf):
    m = derived(spark, sf, "medical").select("patient_id", "zip_code")
    z = derived(spark, sf, "zones").select("zip_code", "pm2_5", "no2_level")
    return joins.key_join(m, z, "zip_code", broadcast_right_rows=100_000)


@register("J4_one_to_one_join_counts")
def j4(spark, sf):
    j = joins.key_join(derived(spark, sf, "medical"), derived(spark, sf, "lifestyle"), "patient_id",
                       validate="one_to_one")
    return j.groupBy("diet_quality", "sex").agg(F.count(F.lit(1)).alias("n"),
                                                F.round(F.avg("weight_kg"), 6).alias("avg_weight"))


@register("J5_spatial_within_join")
def j5(spark, sf):
    m = derived(spark, sf, "medical").select("patient_id", "longitude", "latitude")
    z = joins.spatial_within_join(m, _zones(spark, sf).select("zip_code", "ring"), how="left")
    return z.select("patient_id", F.col("zip_code").alias("zone"))


@register("J7_fuse_modalities")
def j7(spark, sf):
    clinical = derived(spark, sf, "medical").where("disease_risk = 1").select("patient_id", "weight_kg")
    life = derived(spark, sf, "lifestyle").where("exercise_frequency >= 4").select("patient_id", "diet_quality")
    gen = derived(spark, sf, "genotypes").where("genotype IS NOT NULL AND genotype <> 'NN'").groupBy(
        "patient_id").agg(F.count(F.lit(1)).alias("n_called"))
    f = joins.fuse_modalities({"clinical": clinical, "lifestyle": life, "genomic": gen})
    return f.select("patient_id", "weight_kg", "diet_quality", "n_called", "has_clinical", "has_lifestyle",
                    "has_genomic")


@register("J8_risk_profile")
def j8(spark, sf):
    base = derived(spark, sf, "medical").select("patient_id")
    clin = derived(spark, sf, "medical").select("patient_id", fx.metabolic_score().alias("metabolic_score"))
    env = derived(spark, sf, "medical").select("patient_id", "zip_code").join(
        derived(spark, sf, "zones").select("zip_code", "pm2_5"), "zip_code").select("patient_id", "pm2_5")
    life = derived(spark, sf, "lifestyle").select("patient_id", fx.lifestyle_risk().alias("lifestyle_risk"))
    prof = joins.build_profile(base, {"clinical": clin, "environmental": env, "lifestyle": life})
    return prof.select("patient_id", r6("clinical.metabolic_score").alias("metabolic_score"),
                       r6("environmental.pm2_5").alias("pm2_5"), r6("lifestyle.lifestyle_risk").alias("lifestyle_risk"))


# ---------------------------------------------------------------- I
@register("I1_I2_impute_median_mode")
def i12(spark, sf):
    j = derived(spark, sf, "medical").select("patient_id", "fasting_glucose", "triglycerides").join(
        derived(spark, sf, "lifestyle").select("patient_id", "smoking_status", "alcohol_consumption"), "patient_id")
    out, _ = prep.impute(j, ["fasting_glucose", "triglycerides", "alcohol_consumption"], ["smoking_status"])
    return out


@register("I3_one_hot_encode")
def i3(spark, sf):
    life = derived(spark, sf, "lifestyle").select("patient_id", "smoking_status", "diet_quality")
    cats = prep.fit_categories(life, ["smoking_status", "diet_quality"])
    return prep.one_hot(life, cats)


@register("I4_standard_scale")
def i4(spark, sf):
    m = derived(spark, sf, "medical").select("patient_id", "weight_kg", "height_m", "hdl_cholesterol")
    stats = prep.fit_standard(m, ["weight_kg", "height_m", "hdl_cholesterol"])
    s = prep.standard_scale(m, stats)
    return s.select("patient_id", *[r6(c).alias(c) for c in ["weight_kg", "height_m", "hdl_cholesterol"]])


@register("I7_train_test_split_sizes")
def i7(spark, sf):
    s = prep.train_test_split(derived(spark, sf, "medical").select("patient_id", "disease_risk"), "patient_id",
                              0.2, 42)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@register("I8_stratified_fold_sizes")
def i8(spark, sf):
    s = prep.stratified_folds(derived(spark, sf, "medical").select("patient_id", "disease_risk"), "disease_risk",
                              "patient_id", k=5)
    return s.groupBy("disease_risk", "fold").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- N
NUMERIC_DESCRIBE = ["weight_kg", "height_m", "fasting_glucose", "hdl_cholesterol", "triglycerides"]


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, sample std, min, interpolated quartiles, max per
    numeric column.  Moments in one aggregate; quartiles by the exact
    distributed quantile operator (``summary()`` would be approximate)."""
    from medlake.operators.ordered import exact_quantiles_df
    long = prep._unpivot(df, cols, "double")
    mom = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                     F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                     F.max("value").alias("max"))
    q = exact_quantiles_df(long, "value", [0.25, 0.5, 0.75], group_cols=["column"])
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                   for p, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]])
    return mom.join(qw, "column", "left")


@register("N1_describe_medical")
def n1(spark, sf):
    d = describe(derived(spark, sf, "medical"), NUMERIC_DESCRIBE)
    return d.select("column", "count", *[r6(c).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


@register("N2_value_counts")
def n2(spark, sf):
    m = derived(spark, sf, "medical")
    c = m.groupBy("disease_risk").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return c.select("disease_risk", "n", F.format_string("%.1f%%", F.round(share, 1)).alias("share"))


# ---------------------------------------------------------------- A (columns)
@register("A1_pseudonymize_ids")
def a1(spark, sf):
    return derived(spark, sf, "medical").select("patient_id", px.pseudonymize("patient_id").alias("pid_hash"))


@register("A2_generalize_columns")
def a2(spark, sf):
    m = _medical_with_age_bmi(spark, sf)
    return m.select("patient_id", fx.digitize("age", [30, 50, 70]).alias("age_band"),
                    fx.generalize_ranges("weight_kg", [("light", 0.0, 69.0), ("medium", 70.0, 89.0),
                                                       ("heavy", 90.0, 200.0)]).alias("weight_band"))


@register("A4_mask_document_text")
def a4(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    m = d.select("doc_id", px.mask_tail("text", 4).alias("masked"))
    return m.select("doc_id", F.length("masked").alias("n_chars"), F.right("masked", F.lit(4)).alias("tail"),
                    F.sha2("masked", 256).alias("masked_sha"))


@register("A5_deidentify")
def a5(spark, sf):
    c = table(spark, sf, "customer")
    return c.drop("c_name")


@register("A8_encrypt_roundtrip")
def a8(spark, sf):
    key = "00112233445566778899aabbccddeeff00112233445566778899aabbccddeeff"
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    e = c.select("c_custkey", "c_name", px.encrypt("c_name", key).alias("enc"))
    return e.select("c_custkey", F.length("enc").alias("enc_bytes"),
                    (px.decrypt("enc", key) == F.col("c_name")).alias("roundtrip_ok"))


@register("A9_hmac_signature")
def a9(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return c.select("c_custkey", px.hmac_sha256("c_name", "secret-key").alias("signature"))


@register("A10_dlp_keyword_hits")
def a10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    kw = ["token", "license", "mail", "password", "ssn"]
    h = d.select("doc_id", F.explode(px.keyword_hits("text", kw)).alias("keyword"))
    return h.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@register("A11_sanitize_input")
def a11(spark, sf):
    d = table(spark, sf, "pages").select("page_id", "html")
    s = d.select("page_id", px.sanitize("html").alias("clean"))
    return s.select("page_id", F.length("clean").alias("n_chars"), F.sha2("clean", 256).alias("clean_sha"))


@register("A22_suspicious_code_scan")
def a22(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    needles = px.SUSPICIOUS_CODE + ['token = "']
    return d.where(px.contains_any("text", needles, lower=False)).select("doc_id")


def _registry_b(spark, sf):
    """A second patient registry derived from customer with planted errors."""
    return table(spark, sf, "customer").selectExpr(
        "c_custkey + 100000 AS rid",
        "CASE WHEN c_custkey % 7 = 0 THEN concat(substr(c_name, 1, length(c_name) - 1), 'X') ELSE c_name END AS c_name",
        "CASE WHEN c_custkey % 11 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS c_nationkey",
        "c_mktsegment", "cast(floor(c_acctbal) AS bigint) AS bal")


@register("V11_deterministic_matches")
def v11a(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return quality.deterministic_matches(a, _registry_b(spark, sf), ["c_name", "c_nationkey"], "c_custkey", "rid")


@register("V11_probabilistic_matches")
def v11b(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "c_nationkey", "c_mktsegment",
                                                "cast(floor(c_acctbal) AS bigint) AS bal")
    m = quality.probabilistic_matches(a, _registry_b(spark, sf), "c_custkey", "rid",
                                      blocks=[["c_name"], ["c_nationkey", "bal"], ["c_mktsegment", "bal"]],
                                      weights={"c_name": 4.0, "c_nationkey": 2.0, "bal": 3.0, "c_mktsegment": 1.0},
                                      name="c_name", threshold=5.0)
    return m


@register("I3_one_hot_sparse")
def i3b(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    ones = prep.one_hot_sparse(o, prep.fit_category_index(o, cols), cols)
    return ones.select("o_orderkey", F.array_join("one_hot", ",").alias("places"))


@register("V11_learned_matches")
def v11c(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "c_nationkey", "c_mktsegment",
                                                "cast(floor(c_acctbal) AS bigint) AS bal")
    m = quality.learned_matches(a, _registry_b(spark, sf), "c_custkey", "rid",
                                orders=[["c_name"], ["bal", "c_mktsegment"]],
                                fields=["c_name", "c_nationkey", "bal", "c_mktsegment"], reach=3, rounds=20)
    return m.select("l_id", "r_id", F.round("score", 4).alias("score"))


@register("A3_gaussian_noise")
def a3(spark, sf):
    m = derived(spark, sf, "medical").select("patient_id", "weight_kg")
    return m.select("patient_id", F.round(px.gaussian_noise("weight_kg", 2.0, "patient_id", seed=11), 6)
                    .alias("weight_noisy"))


@register("I5_column_transformer")
def i5(spark, sf):
    j = _medical_with_age_bmi(spark, sf).select("patient_id", "fasting_glucose", "triglycerides", "bmi").join(
        derived(spark, sf, "lifestyle").select("patient_id", "smoking_status"), "patient_id")
    out, _ = prep.column_transformer(j, numeric=["fasting_glucose", "triglycerides"], categorical=["smoking_status"],
                                     binned=["bmi"], n_bins=5, passthrough=["patient_id"])
    return out.select("patient_id", r6("fasting_glucose").alias("fasting_glucose"),
                      r6("triglycerides").alias("triglycerides"), "smoking_status_current", "smoking_status_former",
                      "smoking_status_never", "bmi_bin")


@register("V2_failing_samples")
def v2s(spark, sf):
    return quality.failing_samples(_medical_with_age_bmi(spark, sf), "patient_id", k=2, seed=5)
