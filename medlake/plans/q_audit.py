"""Registered queries for sources/sinks (S) and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.operators import audit, joins, registry
from medlake.plans.catalog import register
from medlake.session import materialize, scratch_path
from medlake.sources import files
from medlake.sources.derived import derived, zone_rings, zone_shapes
from medlake.sources.tables import table


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- S
_MED_CSV_SCHEMA = ("patient_id string, birth_year int, sex string, exam_date string, weight_kg double, "
                   "zip_code string, blood_pressure string, disease_risk int")


@register("S1_csv_roundtrip")
def s1(spark, sf):
    m = derived(spark, sf, "medical").select("patient_id", "birth_year", "sex", "exam_date", "weight_kg", "zip_code",
                                             "blood_pressure", "disease_risk")
    path = scratch_path(spark, "s1-csv")
    files.write_table(m, path, "csv")
    back = files.read_csv(spark, path, _MED_CSV_SCHEMA, date_cols=["exam_date"])
    return back.select("patient_id", "birth_year", "sex", F.date_format("exam_date", "yyyy-MM-dd").alias("exam_date"),
                       "weight_kg", "zip_code", "blood_pressure", "disease_risk",
                       F.col(files.CORRUPT).isNull().alias("well_formed"))


@register("S2_json_lines_roundtrip")
def s2(spark, sf):
    life = derived(spark, sf, "lifestyle")
    path = scratch_path(spark, "s2-json")
    files.write_table(life, path, "json")
    return files.read_json(spark, path, "patient_id string, smoking_status string, exercise_frequency int, "
                                        "alcohol_consumption double, diet_quality string")


@register("S3_geojson_zones")
def s3(spark, sf):
    z = zone_rings(derived(spark, sf, "zones"))
    feat = z.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.create_map(F.lit("zip_code"), F.col("zip_code"), F.lit("pm2_5"), F.col("pm2_5").cast("string")).alias(
            "properties"),
        F.struct(F.lit("Polygon").alias("type"),
                 F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates")).alias(
            "geometry"))).alias("value"))
    path = scratch_path(spark, "s3-geojsonseq")
    feat.write.mode("overwrite").text(path)
    g = files.read_geojson(spark, path, seq=True)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return g.select(F.col("properties")["zip_code"].alias("zip_code"),
                    F.col("properties")["pm2_5"].cast("double").alias("pm2_5"),
                    F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"),
                    F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"))


def _collections(spark, sf):
    """The shaped zones, and one huge zone with a hole, landed as
    FeatureCollection files (one a column of zones) and read back."""
    z = derived(spark, sf, "zones").select("zip_code", "min_x", "max_x", "min_y", "max_y", "pm2_5")
    huge = z.agg(F.lit("Z02").alias("zip_code"), F.lit(-50000.0).alias("min_x"), F.lit(50000.0).alias("max_x"),
                 F.lit(-50000.0).alias("min_y"), F.lit(50000.0).alias("max_y"), F.max("pm2_5").alias("pm2_5"))
    shaped = zone_shapes(z.union(huge)).withColumn("part", F.col("min_x").cast("long"))
    shaped = shaped.withColumn("zip_code", F.when(F.col("min_x") < -1000, "ALL").otherwise(F.col("zip_code")))
    path = scratch_path(spark, "s3-collections")
    files.feature_collections(shaped.select("zip_code", "pm2_5", "kind", "polygons", "part"), "kind", "polygons",
                              ["part"]).write.mode("overwrite").partitionBy("part").text(path)
    g = files.read_geojson(spark, path)
    return g.select(F.col("properties")["zip_code"].alias("zip_code"),
                    F.col("properties")["pm2_5"].cast("double").alias("pm2_5"), "rings")


@register("S3_geojson_collections")
def s3_collections(spark, sf):
    pts = F.flatten("rings")
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return _collections(spark, sf).select(
        "zip_code", "pm2_5", F.size("rings").cast("long").alias("n_rings"), F.size(pts).cast("long").alias("n_points"),
        F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"),
        F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"))


@register("J5_holes_and_parts")
def j5_holes(spark, sf):
    m = derived(spark, sf, "medical").select("patient_id", "longitude", "latitude")
    z = joins.spatial_within_join(m, _collections(spark, sf).select("zip_code", "rings"), ring="rings", how="left")
    return z.select("patient_id", F.col("zip_code").alias("zone"))


@register("S4_clean_dataset_roundtrip")
def s4(spark, sf):
    j = derived(spark, sf, "medical").select("patient_id", "sex", "zip_code").join(derived(spark, sf, "lifestyle"),
                                                                                 "patient_id")
    path = scratch_path(spark, "s4-clean")
    files.write_table(j, path, "parquet")
    return spark.read.parquet(path)


def _snapshot_new(spark, sf):
    c = table(spark, sf, "customer")
    kept = c.where("c_custkey % 50 <> 0")
    return kept.selectExpr(
        "printf('P%03d', c_custkey) AS patient_id",
        "cast(50 + (c_custkey * 13) % 60 + CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END AS double) AS weight_kg",
        "cast(30 + (c_custkey * 5) % 50 as double) AS hdl_cholesterol").unionByName(
        c.where("c_custkey % 97 = 0").selectExpr("printf('N%03d', c_custkey) AS patient_id",
                                                 "cast(70 as double) AS weight_kg",
                                                 "cast(40 as double) AS hdl_cholesterol"))


@register("S5_snapshot_delta")
def s5(spark, sf):
    old = derived(spark, sf, "medical").select("patient_id", "weight_kg", "hdl_cholesterol")
    return files.snapshot_delta(old, _snapshot_new(spark, sf), "patient_id")


@register("S5_snapshot_digest")
def s5b(spark, sf):
    return files.snapshot_digest(derived(spark, sf, "medical"))


@register("S6_report_points")
def s6(spark, sf):
    from medlake.operators.ordered import running_totals
    p = derived(spark, sf, "predictions").select(
        "ts", "event_id", ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int").alias("ok"),
        # p has three decimals, so the squared error is a whole number of millionths
        F.pow(F.round(F.col("p") * 1000) - F.col("y") * 1000, 2).cast("long").alias("se"), F.lit(1).alias("one"))
    r = running_totals(p, ["ts", "event_id"], ["ok", "se", "one"], with_totals=False)
    pts = r.where(F.col("cum_one") % 100 == 0)
    return pts.select(F.col("cum_one").alias("row_index"), (F.col("cum_ok") / F.col("cum_one")).alias("accuracy"),
                      (F.col("cum_se") / (F.col("cum_one") * 1000000)).alias("brier"))


# fixed values: external record mapping used by the S9 query (target, source expression, type)
EVENT_MAPPING = [("event_key", "event_id", "bigint"), ("kind", "event_type", "string"),
                 ("k", "get_json_object(props, '$.k')", "int"), ("amount", "value", "double")]


@register("S9_standardize_records")
def s9(spark, sf):
    return files.standardize(table(spark, sf, "events"), EVENT_MAPPING)


@register("S10_risk_resources")
def s10(spark, sf):
    c = derived(spark, sf, "clinical").select(
        "patient_id", F.when(F.col("p") >= 0.7, "high").when(F.col("p") >= 0.4, "medium").otherwise("low")
        .alias("category"), "sex")
    return files.risk_resources(c, "patient_id", ["category", "sex"])


# ---------------------------------------------------------------- A vault
@register("A6_tokenize_roundtrip")
def a6(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    tok, vault = audit.tokenize(c, "c_name", "c_custkey", "a6-vault")
    back = audit.detokenize(tok.withColumnRenamed("c_name", "tok").withColumn("c_name", F.col("tok")), "c_name", vault)
    j = back.join(c.withColumnRenamed("c_name", "orig"), "c_custkey")
    return j.select("c_custkey", F.length("tok").alias("token_len"), (F.col("c_name") == F.col("orig")).alias(
        "roundtrip_ok"))


@register("A7_consent_revocation")
def a7(spark, sf):
    m = derived(spark, sf, "medical").select("patient_id")
    _, vault = audit.tokenize(m, "patient_id", "patient_id", "a7-vault")
    revoked = table(spark, sf, "customer").where("c_custkey % 100 = 1").selectExpr(
        "printf('P%03d', c_custkey) AS patient_id")
    return audit.revoke_consent(vault, revoked).select(F.col("value").alias("patient_id"))


# ---------------------------------------------------------------- A audits
def _access(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "ts",
        "CASE user_id % 3 WHEN 0 THEN 'doctor' WHEN 1 THEN 'nurse' ELSE 'admin' END AS role",
        "CASE event_type WHEN 'view' THEN 'patient_records' WHEN 'click' THEN 'prescriptions' "
        "WHEN 'purchase' THEN 'vital_signs' WHEN 'signup' THEN 'medication_admin' ELSE 'billing' END AS resource")


@register("A12_rbac_violations")
def a12(spark, sf):
    v = audit.rbac_violations(_access(spark, sf))
    return v.groupBy("role", "resource").agg(F.count(F.lit(1)).alias("n"))


@register("A13_abac_audit")
def a13(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS clearance",
        "CASE user_id % 4 WHEN 0 THEN 'cardiology' WHEN 1 THEN 'oncology' ELSE 'icu' END AS department")
    ok = audit.abac_allowed(F.col("clearance"), F.col("department"))
    return e.groupBy(ok.alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@register("A14_out_of_hours_access")
def a14(spark, sf):
    e = table(spark, sf, "events")
    return e.where(audit.out_of_hours(F.col("ts"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("A15_intrusion_windows")
def a15(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "user_id", "ts", "CASE event_type WHEN 'error' THEN 'brute_force' WHEN 'signup' THEN 'port_scan' "
        "ELSE 'normal' END AS signal")
    w = audit.intrusion_windows(e, "user_id", "ts", "signal", "1 day")
    return w.where("intrusion").select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_hits")


@register("A16_block_list_audit")
def a16(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    blocked = table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return audit.list_audit(c, blocked, "c_nationkey", "block").select("c_custkey")


@register("A16_allow_list_audit")
def a16b(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk"))
    allowed = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nk")).where("nk % 3 = 0")
    return audit.list_audit(s, allowed, "nk", "allow").select("s_suppkey")


@register("A17_file_integrity")
def a17(spark, sf):
    # two stored versions of the pages, a file for each 25 page ids: the second lacks
    # some files, has others that the first lacks, and some with one altered page
    pages = table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 25).alias("part"),
                                             F.coalesce("html", F.lit("")).alias("html"))
    altered = F.when((F.col("part") % 10 == 4) & (F.col("page_id") % 25 == 7), F.concat("html", F.lit("x"))).otherwise(F.col("html"))

    def stored(df, name):
        path = scratch_path(spark, name)
        # the files' bytes depend on the order of their lines
        df.repartition("part").sortWithinPartitions("part", "page_id").select("part", "html").write.partitionBy("part").text(path)
        # each folder holds one file
        return audit.file_hashes(spark, path, chunk_bytes=16 << 10).select(F.regexp_extract("name", "part=(\\d+)/", 1).alias("name"), "sha256")

    before = materialize(stored(pages.where("part % 10 <> 3"), "pages-v1"), "file-baseline")
    return audit.integrity_diff(stored(pages.withColumn("html", altered).where("part % 10 <> 5"), "pages-v2"), before)


@register("A18_audit_hash_chain")
def a18(spark, sf):
    e = table(spark, sf, "events")
    d = audit.day_digests(e, "ts", F.concat_ws("|", "event_id", "event_type", "user_id"))
    ch = audit.hash_chain(d)
    return ch.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "digest", "n_lines", "chain")


@register("A19_missing_approvals")
def a19(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.collect_set("event_type").alias("approvals"))  # at most one entry per event type
    m = audit.missing_approvals(e, "approvals", ["purchase", "view"])
    return m.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"),
                    F.array_join(F.array_sort("missing"), ",").alias("missing"))


@register("A20_config_audit")
def a20(spark, sf):
    s = table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "s_suppkey % 3 <> 0 AS ssl", "s_suppkey % 4 <> 0 AS firewall",
        "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 5 = 1 END AS debug",
        "s_suppkey % 2 = 0 AS encrypted", "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE true END AS passcode",
        "s_suppkey % 6 = 0 AS jailbroken")
    return s.select("s_suppkey", audit.config_ok(F.col("ssl"), F.col("firewall"), F.col("debug")).alias("config_ok"),
                    audit.device_ok(F.col("encrypted"), F.col("passcode"), F.col("jailbroken")).alias("device_ok"))


@register("A21_risk_register")
def a21(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", audit.risk_product((F.col("s_suppkey") % 5 + 1).cast("int"),
                                                    (F.col("s_nationkey") % 5 + 1)).alias("risk"),
                    (F.col("s_acctbal") / 1000.0 >= 8.5).alias("vendor_high_risk"),
                    audit.incident_response((F.col("s_nationkey") % 4).cast("int")).alias("plan"))


@register("A23_expired_artifacts")
def a23(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return registry.expired_artifacts(o, "o_orderdate", "2001-01-01 00:00:00", 1500).select("o_orderkey")


@register("A24_phi_access_counts")
def a24(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id", "cast(event_id % 50 AS int) AS patient", "ts")
    c = audit.access_counts(e, "user_id", "patient", "ts")
    return c.select("user_id", "patient", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_access")
