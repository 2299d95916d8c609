"""Deterministic patient-shaped tables derived from the landed tables.

The landed data has no patient tables, so each one is a projection of a
landed table by integer arithmetic on its key.  The expressions are plain
SQL accepted by both Spark and DuckDB; Spark evaluates them with
``selectExpr`` (projection only: no shuffle, whole-stage codegen) and the
correctness oracle repeats the same text in a CTE, so both engines start
from identical rows.

Every table grows linearly with its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlake.sources.tables import table

# (source table, WHERE clause or None, [(expression, alias), ...])
_PID = "printf('P%03d', c_custkey)"

SPECS: dict[str, tuple[str, str | None, list[tuple[str, str]]]] = {
    "medical": ("customer", None, [
        (_PID, "patient_id"),
        ("cast(1935 + (c_custkey * 7) % 70 as int)", "birth_year"),
        ("case when c_custkey % 2 = 0 then 'F' else 'M' end", "sex"),
        ("date '2024-01-01' + cast(c_custkey % 365 as int)", "exam_date"),
        ("cast(50 + (c_custkey * 13) % 60 as double)", "weight_kg"),
        ("cast(150 + (c_custkey * 11) % 50 as double) / 100", "height_m"),
        ("case when c_custkey % 7 = 0 then null else cast(70 + (c_custkey * 17) % 110 as double) end",
         "fasting_glucose"),
        ("cast(30 + (c_custkey * 5) % 50 as double)", "hdl_cholesterol"),
        ("case when c_custkey % 11 = 0 then null else cast(80 + (c_custkey * 29) % 220 as double) end",
         "triglycerides"),
        ("printf('Z%02d', c_nationkey)", "zip_code"),
        ("cast((c_custkey * 37) % 1000 as double) / 10", "longitude"),
        ("cast((c_custkey * 53) % 500 as double) / 10", "latitude"),
        ("cast(1 + (c_custkey * 3) % 30 as int)", "years_in_location"),
        ("printf('%d/%d', 110 + (c_custkey * 19) % 60, 60 + (c_custkey * 23) % 45)", "blood_pressure"),
        ("case when (c_custkey * 31) % 100 < 35 then 1 else 0 end", "disease_risk"),
    ]),
    "lifestyle": ("customer", "c_custkey % 10 <> 0", [
        (_PID, "patient_id"),
        ("case c_custkey % 4 when 0 then 'never' when 1 then 'former' when 2 then 'current' end",
         "smoking_status"),
        ("cast(c_custkey % 8 as int)", "exercise_frequency"),
        ("case when c_custkey % 13 = 0 then null else cast((c_custkey * 3) % 15 as double) end",
         "alcohol_consumption"),
        ("case c_custkey % 3 when 0 then 'poor' when 1 then 'fair' else 'good' end", "diet_quality"),
    ]),
    "zones": ("nation", None, [
        ("printf('Z%02d', n_nationkey)", "zip_code"),
        ("cast(20 * (n_nationkey % 5) as double)", "min_x"),
        ("cast(20 * (n_nationkey % 5) + 18 as double)", "max_x"),
        ("cast(10 * cast((n_nationkey - n_nationkey % 5) / 5 as int) as double)", "min_y"),
        ("cast(10 * cast((n_nationkey - n_nationkey % 5) / 5 as int) + 9 as double)", "max_y"),
        ("cast(5 + (n_nationkey * 7) % 40 as double)", "pm2_5"),
        ("cast(10 + (n_nationkey * 3) % 50 as double)", "no2_level"),
    ]),
    "predictions": ("events", None, [
        ("event_id", "event_id"),
        ("ts", "ts"),
        ("event_type", "model"),
        ("cast((event_id * 7919) % 1000 as double) / 1000", "p"),
        ("case when (event_id * 7919) % 1000 + (event_id * 104729) % 700 > 850 then 1 else 0 end", "y"),
    ]),
    "vitals": ("events", None, [
        ("event_id", "event_id"),
        ("user_id", "patient_key"),
        ("ts", "ts"),
        ("case event_id % 6 when 0 then 'heart_rate' when 1 then 'resp_rate' when 2 then 'temperature' "
         "when 3 then 'spo2' when 4 then 'glucose' else 'potassium' end", "metric"),
        ("value", "value"),
    ]),
    # Clinical record for the rule engine and the risk scores (our own
    # recipe, same style as above).  NULLs are planted on purpose.
    "clinical": ("customer", None, [
        (_PID, "patient_id"),
        ("cast(12 + (c_custkey * 7) % 76 as int)", "age"),
        ("case when c_custkey % 2 = 0 then 'F' else 'M' end", "sex"),
        ("cast((c_custkey * 7919) % 1000 as double) / 1000", "p"),
        ("cast(70 + (c_custkey * 13) % 160 as double)", "ldl"),
        ("cast(100 + (c_custkey * 19) % 80 as int)", "systolic"),
        ("cast(60 + (c_custkey * 23) % 45 as int)", "diastolic"),
        ("c_custkey % 3 = 0", "on_antihypertensives"),
        ("cast((c_custkey * 17) % 100 as double) / 100", "ascvd_risk"),
        ("cast(10 + (c_custkey * 11) % 40 as double) / 10", "fev1"),
        ("cast(20 + (c_custkey * 13) % 40 as double) / 10", "fvc"),
        ("cast(30 + (c_custkey * 29) % 80 as double)", "fev1_pct"),
        ("cast((c_custkey * 3) % 50 as double)", "pack_years"),
        ("case when c_custkey % 9 = 0 then null else cast(-40 + (c_custkey * 7) % 50 as double) / 10 end",
         "t_score"),
        ("cast((c_custkey * 5) % 25 as double)", "fev1_variability"),
        ("cast((c_custkey * 31) % 25 as double)", "fev1_reversibility"),
        ("cast(c_custkey % 5 as int)", "saba_uses"),
        ("cast(10 + (c_custkey * 37) % 110 as double)", "egfr"),
        ("cast((c_custkey * 41) % 400 as double)", "acr"),
        ("cast((c_custkey * 43) % 500 as double) / 100", "fibrosis_score"),
        ("case when c_custkey % 8 = 0 then null else cast((c_custkey * 3) % 28 as int) end", "phq9"),
        ("cast((c_custkey * 7) % 60 as double) / 10", "joint_space"),
        ("cast((c_custkey * 11) % 40 as double)", "ahi"),
        ("cast((c_custkey * 5) % 6 as int)", "family_history_score"),
        ("c_custkey % 5 = 0", "ccp_positive"),
        ("c_custkey % 7 < 3", "joint_inflammation"),
        ("cast((c_custkey * 13) % 100 as double) / 10", "tsh"),
        ("c_custkey % 4 = 1", "hypothyroid_symptoms"),
        ("cast((c_custkey * 17) % 400 as double)", "calprotectin"),
        ("cast(80 + (c_custkey * 19) % 100 as double) / 10", "hemoglobin"),
        ("cast(60 + (c_custkey * 23) % 50 as double)", "mcv"),
        ("cast((c_custkey * 3) % 30 as int)", "headache_frequency"),
        ("case c_custkey % 3 when 0 then 'positive' when 1 then 'negative' end", "amyloid_pet"),
        ("c_custkey % 4 = 0", "cognitive_decline"),
        ("case when c_custkey % 6 = 0 then null else cast(40 + (c_custkey * 7) % 60 as double) / 10 end",
         "hba1c"),
        ("cast(70 + (c_custkey * 17) % 110 as double)", "fpg"),
        ("cast(30 + (c_custkey * 5) % 50 as double)", "hdl"),
        ("cast(80 + (c_custkey * 29) % 220 as double)", "triglycerides"),
        ("cast(60 + (c_custkey * 7) % 70 as double)", "waist_cm"),
        ("cast(170 + (c_custkey * 3) % 140 as double) / 10", "bmi"),
        ("c_custkey % 6 = 1", "chf"),
        ("c_custkey % 3 = 1", "hypertension"),
        ("c_custkey % 5 = 2", "diabetes"),
        ("c_custkey % 10 = 3", "stroke_history"),
        ("c_custkey % 9 = 4", "vascular_disease"),
        ("cast((c_custkey * 7) % 200 as double) / 10", "psa"),
        ("cast(10 + (c_custkey * 11) % 90 as double)", "prostate_volume"),
        ("cast((c_custkey * 3) % 20 as int)", "education_years"),
        ("c_custkey % 4 = 2", "physically_inactive"),
        ("cast((c_custkey * 13) % 50 as double)", "egfr_drop_pct"),
        ("c_custkey % 8 = 5", "sepsis"),
        ("c_custkey % 7 = 6", "nephrotoxins"),
        ("cast((c_custkey * 19) % 40 as double) / 10 - 1", "ascvd_base"),
        ("cast((c_custkey * 23) % 30 as double) / 10", "qdiabetes_terms"),
        ("cast(5 + (c_custkey * 7) % 20 as double) / 10", "gail_factor"),
        ("cast((c_custkey * 3) % 4 as int)", "fev1_points"),
        ("cast((c_custkey * 5) % 5 as int)", "dyspnea_points"),
        ("cast((c_custkey * 7) % 4 as int)", "walk_points"),
        ("cast((c_custkey * 11) % 10 as double)", "inflammatory_score"),
        ("cast((c_custkey * 13) % 10 as double)", "metabolic_points"),
        ("cast((c_custkey * 7) % 15 as double)", "weight_loss_pct"),
        ("c_custkey % 11 = 0", "acute_illness"),
        # inputs of the long guideline sets, NULL where a key would be absent
        ("case when c_custkey % 5 = 0 then null else cast(120 + (c_custkey * 23) % 140 as double) end", "ppg"),
        ("case when c_custkey % 7 < 2 then null else cast(60 + (c_custkey % 3) * 30 as int) end", "ppg_minutes"),
        ("case when c_custkey % 6 = 1 then null else cast(50 + (c_custkey * 11) % 50 as double) end", "bmi_percentile"),
        ("case when c_custkey % 2 = 0 then c_custkey % 10 = 4 end", "gestational_diabetes"),
        ("c_custkey % 8 = 2", "pcos"),
        ("case when c_custkey % 3 = 0 then null else cast(c_custkey % 9 as int) end", "pcos_years"),
        ("case when c_custkey % 4 = 3 then null else cast((c_custkey * 7) % 40 as double) / 10 end", "c_peptide"),
        ("case when c_custkey % 3 = 1 then c_custkey % 9 = 1 end", "gad65"),
        ("c_custkey % 17 = 5", "ia2"),
        ("case when c_custkey % 5 = 3 then null else c_custkey % 19 = 6 end", "zn8"),
        ("case when c_custkey % 10 = 7 then null else cast((c_custkey * 13) % 60 as double) / 10 end", "homa_ir"),
        ("split(case c_custkey % 5 when 0 then 'thiazides,metformin' when 1 then 'steroids' when 2 then 'metformin' "
         "when 3 then 'antipsychotics,statins' end, ',')", "medications"),
        ("case when c_custkey % 6 = 5 then null else cast((c_custkey * 17) % 90 as double) / 10 end", "crp"),
        ("case when c_custkey % 7 = 4 then null else cast(5 + (c_custkey * 3) % 50 as double) end", "vitamin_d"),
        ("case when c_custkey % 9 = 2 then null else cast(10 + (c_custkey * 19) % 120 as double) end", "alt"),
        ("case c_custkey % 6 when 0 then 'none' when 1 then 'mild' when 2 then 'moderate' when 3 then 'severe' end", "retinopathy"),
        ("case when c_custkey % 4 = 0 then null else c_custkey % 7 = 1 end", "neuropathy_symptoms"),
        ("c_custkey % 9 = 1", "neuropathy_confirmed"),
        ("c_custkey % 13 = 2", "foot_ulcers"),
        ("case c_custkey % 4 when 0 then 'normal' when 1 then 'abnormal' end", "monofilament"),
        ("case c_custkey % 5 when 0 then 'mild' when 1 then 'moderate' when 2 then 'severe' end", "covid_severity"),
        ("c_custkey % 10 = 1", "post_covid_hyperglycemia"),
        ("case when c_custkey % 3 = 2 then null else cast(c_custkey % 12 as int) end", "prediabetes_years"),
        ("c_custkey % 6 = 4", "prediabetes"),
        ("case when c_custkey % 8 = 7 then null else 1 + cast((c_custkey * 7) % 9 as double) / 10 end", "ethnicity_factor"),
        ("case when c_custkey % 7 = 0 then 'regimen-' || cast(c_custkey % 3 as varchar(9)) end", "hiv_art_regimen"),
        ("cast((c_custkey * 5) % 7 as int)", "pediatric_risk_score"),
        ("c_custkey % 11 < 3", "edc_exposure"),
        ("case when c_custkey % 5 = 1 then null else cast((c_custkey * 29) % 101 as double) end", "prs_pct"),
        ("case when c_custkey % 9 = 8 then null else cast((c_custkey * 31) % 100 as double) / 100 end", "social_vulnerability"),
        ("case when c_custkey % 4 = 2 then null else cast(105 + (c_custkey * 13) % 50 as int) end", "abpm_day_systolic"),
        ("case when c_custkey % 6 = 3 then null else cast(c_custkey % 5 as int) end", "antihypertensive_trials"),
        ("c_custkey % 2 = 0 and c_custkey % 14 = 2", "pregnant"),
        ("case when c_custkey % 3 = 1 then null else c_custkey % 28 = 2 end", "proteinuria"),
        ("c_custkey % 7 = 5", "typical_angina"),
        ("case when c_custkey % 5 = 4 then null else cast(c_custkey % 6 as int) end", "exacerbations"),
        ("cast((c_custkey * 37) % 600 as double)", "calcium_score"),
        ("case when c_custkey % 4 = 1 then null else cast((c_custkey * 13) % 101 as double) end", "stenosis_pct"),
        ("cast(150 + (c_custkey * 23) % 400 as double)", "csf_tau"),
        ("cast((c_custkey * 7) % 80 as double) / 10", "das28"),
        ("cast((c_custkey * 11) % 90 as double) / 10", "cdai"),
        ("case when c_custkey % 3 = 0 then cast((c_custkey * 7) % 120 as double) end", "viral_load"),
        ("cast(100 + (c_custkey * 41) % 900 as double)", "cd4"),
    ]),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a lazy projection of its landed source."""
    if name == "genotypes":
        return genotypes(spark, sf_dir)
    if name == "meds":
        return meds(spark, sf_dir)
    source, where, cols = SPECS[name]
    df = table(spark, sf_dir, source)
    if where:
        df = df.where(where)
    return df.selectExpr(*[f"{e} AS {a}" for e, a in cols])


# --- fixed values: genotype fixture SNPs (rsid, risk allele), in panel order
GENOTYPE_SNPS = [
    ("rs7903146", "T"),
    ("rs4506565", "A"),
    ("rs12779790", "G"),
    ("rs7412", "C"),
]


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long genotype table (patient_id, rsid, genotype): 4 rows per customer.

    ``(k + index) % 4`` picks two risk alleles, one, ``'NN'`` or NULL.
    ``posexplode`` of a literal array: a per-row generator, not a join.
    """
    snps = F.array(*[F.struct(F.lit(r).alias("rsid"), F.lit(a).alias("allele")) for r, a in GENOTYPE_SNPS])
    c = table(spark, sf_dir, "customer").select("c_custkey")
    x = c.select("c_custkey", F.posexplode(snps).alias("idx", "snp"))
    sel = (F.col("c_custkey") + F.col("idx")) % 4
    allele = F.col("snp.allele")
    return x.select(
        F.format_string("P%03d", "c_custkey").alias("patient_id"),
        F.col("snp.rsid").alias("rsid"),
        F.when(sel == 0, F.concat(allele, allele))
        .when(sel == 1, F.concat(allele, F.lit("N")))
        .when(sel == 2, F.lit("NN"))
        .alias("genotype"),
    )


def meds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medication dispensing log from lineitem joined to orders on the order key.

    The join is a shuffle (sort-merge at scale) on ``o_orderkey``, the
    natural key of orders: no key is hot by construction of the schema.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate",
                                                 "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.format_string("P%03d", "o_custkey").alias("patient_id"),
        F.format_string("D%02d", F.col("l_partkey") % 50).alias("drug"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("qty"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
    )


def zone_rings(zones: DataFrame) -> DataFrame:
    """Add a closed polygon ring ``ARRAY<STRUCT<x,y>>`` from the zone bbox."""
    def pt(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return zones.withColumn(
        "ring", F.array(pt("min_x", "min_y"), pt("max_x", "min_y"), pt("max_x", "max_y"),
                        pt("min_x", "max_y"), pt("min_x", "min_y")))


def zone_shapes(zones: DataFrame) -> DataFrame:
    """Zones with real geometry, from their boxes: by number modulo 3 a Polygon
    with a hole, a MultiPolygon of two strips, or a plain Polygon.  Adds ``kind``
    and ``polygons`` (polygons of rings of points)."""
    def box(x0, y0, x1, y1):
        x0, y0, x1, y1 = (F.expr(v) for v in (x0, y0, x1, y1))
        return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in
                         ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    number = F.substring("zip_code", 2, 9).cast("int") % 3
    whole = box("min_x", "min_y", "max_x", "max_y")
    hole = box("min_x + 4", "min_y + 3", "max_x - 4", "max_y - 3")
    strips = F.array(F.array(box("min_x", "min_y", "min_x + 7", "max_y")),
                     F.array(box("max_x - 7", "min_y", "max_x", "max_y")))
    return (zones.withColumn("kind", F.when(number == 1, "MultiPolygon").otherwise("Polygon"))
            .withColumn("polygons", F.when(number == 0, F.array(F.array(whole, hole))).when(number == 1, strips)
                        .otherwise(F.array(F.array(whole)))))
