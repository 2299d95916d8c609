"""Clinical rule engine.

A rule is a data row ``(disease, code, predicate, message)``; the
predicate is a Spark SQL boolean over the patient table and ``p`` (the
model's predicted probability).  ``apply_rules`` evaluates every rule of
every disease in ONE projection (an array of ``when`` per disease),
keeps the hits and explodes them: one scan, no shuffle, no UDF.

Policies per disease: ``first`` (stop at the first failing rule) or
``all`` (collect every discrepancy).  A NULL input makes a rule not fire
[ours]; ``.get(k, 0)`` inputs of the source are ``coalesce(k, 0)`` here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: guideline discrepancy rules (disease, code, predicate, message)
RULES: list[tuple[str, str, str, str]] = [
    # R1 cardiovascular, first failure wins
    ("cardiovascular", "ldl_high_low_p", "ldl > 190 AND p < 0.4", "LDL above 190 with low predicted risk"),
    ("cardiovascular", "sbp_untreated_low_p", "systolic > 140 AND NOT on_antihypertensives AND p < 0.5",
     "untreated systolic above 140 with low predicted risk"),
    ("cardiovascular", "ascvd_mismatch", "abs(p - ascvd_risk) > 0.2", "prediction differs from ASCVD by > 0.2"),
    # R2-R16 single-rule diseases
    ("copd", "obstruction_smoker", "fev1 / fvc < 0.7 AND pack_years > 20 AND p < 0.6",
     "obstructive ratio in a heavy smoker with low predicted risk"),
    ("osteoporosis", "low_t_score", "coalesce(t_score, 0) <= -2.5 AND p < 0.3", "T-score <= -2.5 with low risk"),
    ("asthma", "variability", "fev1_variability > 12 AND p < 0.4", "FEV1 variability > 12% with low risk"),
    ("ckd", "egfr_acr", "egfr < 60 AND acr > 30 AND p < 0.5", "eGFR < 60 and ACR > 30 with low risk"),
    ("nafld", "fibrosis", "fibrosis_score >= 2.67 AND p < 0.4", "fibrosis score >= 2.67 with low risk"),
    ("depression", "phq9", "coalesce(phq9, 0) >= 15 AND p < 0.6", "PHQ-9 >= 15 with low risk"),
    ("osteoarthritis", "joint_space", "joint_space < 3 AND p < 0.4", "joint space < 3 mm with low risk"),
    ("sleep_apnea", "ahi", "ahi >= 15 AND p < 0.5", "AHI >= 15 with low risk"),
    ("cancer", "family_history", "family_history_score > 2 AND p < 0.3", "family history score > 2 with low risk"),
    ("rheumatoid_arthritis", "ccp_inflammation", "ccp_positive AND joint_inflammation AND p < 0.4",
     "anti-CCP positive with joint inflammation and low risk"),
    ("thyroid", "tsh_symptoms", "tsh > 4.5 AND hypothyroid_symptoms AND p < 0.4",
     "TSH > 4.5 with hypothyroid symptoms and low risk"),
    ("ibd", "calprotectin", "calprotectin > 200 AND p < 0.5", "calprotectin > 200 with low risk"),
    ("anemia", "microcytic", "hemoglobin < 11 AND mcv < 80 AND p < 0.4", "microcytic anemia with low risk"),
    ("migraine", "frequency", "headache_frequency > 15 AND p < 0.4", "headache frequency > 15 with low risk"),
    ("alzheimers", "amyloid_decline", "amyloid_pet = 'positive' AND cognitive_decline AND p < 0.5",
     "positive amyloid PET with decline and low risk"),
    # R18 diabetes, collect all: 22 rules, the third with two outcomes
    ("diabetes", "hba1c", "hba1c >= 6.5 AND p < 0.3", "HbA1c >= 6.5 with low risk"),
    ("diabetes", "fpg", "fpg >= 126 AND p < 0.25", "fasting glucose >= 126 with low risk"),
    ("diabetes", "ppg_untimed", "ppg >= 200 AND coalesce(ppg_minutes, 0) = 0", "postprandial glucose without a time"),
    ("diabetes", "ppg", "ppg >= 200 AND coalesce(ppg_minutes, 0) <> 0 AND p < 0.4", "postprandial glucose >= 200 with low risk"),
    ("diabetes", "pediatric_bmi", "age < 18 AND bmi_percentile >= 95 AND p < 0.35", "child above the 95th BMI percentile with low risk"),
    ("diabetes", "gestational", "gestational_diabetes AND p < 0.5", "earlier gestational diabetes with low risk"),
    ("diabetes", "pcos", "pcos AND sex = 'F' AND p < 0.4 + 0.05 * coalesce(pcos_years, 0) - 0.15",
     "risk below what the years with PCOS suggest"),
    ("diabetes", "metabolic_syndrome", "metabolic_points >= 3 AND p < 0.3", "metabolic syndrome with low risk"),
    ("diabetes", "c_peptide", "c_peptide < 0.8 AND p < 0.6", "low C-peptide with low risk"),
    ("diabetes", "autoantibodies", "(coalesce(gad65, false) OR coalesce(ia2, false) OR coalesce(zn8, false)) AND p < 0.7",
     "islet autoantibodies with low risk"),
    ("diabetes", "insulin_resistance", "homa_ir > 2.5 AND p < 0.4", "HOMA-IR above 2.5 with low risk"),
    ("diabetes", "family_risk", "p + 0.15 * family_history_score < 0.5 AND family_history_score > 2",
     "strong family history not reflected"),
    ("diabetes", "medications", "(array_contains(medications, 'thiazides') OR array_contains(medications, 'steroids')) AND p < 0.35",
     "diabetogenic medication with low risk"),
    ("diabetes", "sleep_apnea", "ahi >= 15 AND p < 0.3", "sleep apnea with low diabetes risk"),
    ("diabetes", "inflammation", "crp >= 3.0 AND p < 0.25 + crp / 10", "CRP not reflected in the risk"),
    ("diabetes", "vitamin_d", "vitamin_d <> 0 AND vitamin_d < 20 AND p < 0.3", "vitamin D below 20 with low risk"),
    ("diabetes", "liver", "alt >= 40 AND p < 0.25 + alt / 200", "ALT not reflected in the risk"),
    ("diabetes", "retinopathy", "retinopathy IN ('mild', 'moderate', 'severe') AND p < 0.8", "retinopathy with low risk"),
    ("diabetes", "neuropathy", "neuropathy_symptoms AND p < 0.6", "neuropathy symptoms with low risk"),
    ("diabetes", "foot_exam", "(coalesce(foot_ulcers, false) OR coalesce(monofilament, '') = 'abnormal') AND p < 0.7",
     "abnormal foot exam with low risk"),
    ("diabetes", "post_covid", "covid_severity IN ('moderate', 'severe') AND "
     "p < 0.3 + CASE WHEN covid_severity = 'severe' THEN 0.15 ELSE 0.08 END", "risk below what COVID severity suggests"),
    ("diabetes", "prediabetes_years", "prediabetes_years > 3 AND p < 0.05 * prediabetes_years", "years of prediabetes not reflected"),
    ("diabetes", "ethnicity", "ethnicity_factor > 1.3 AND p * ethnicity_factor < 0.5", "ethnicity multiplier not reflected"),
    # R17 diabetes, short form (superseded by R18, kept as its own set)
    ("diabetes_basic", "hba1c", "hba1c >= 6.5 AND p < 0.3", "HbA1c >= 6.5 with low risk"),
    # R19 diabetes guideline rules found inside the hypertension validator, plus its own rule
    ("hypertension_r19", "systolic", "systolic > 130 AND p < 0.4", "systolic above 130 with low risk"),
    ("diabetes_r19", "hba1c", "hba1c >= 6.5 AND p < 0.3", "HbA1c >= 6.5 with low risk"),
    ("diabetes_r19", "fpg", "fpg >= 126 AND p < 0.25", "fasting glucose >= 126 with low risk"),
    ("diabetes_r19", "ppg", "ppg >= 200 AND p < 0.4", "2h postprandial glucose >= 200 with low risk"),
    ("diabetes_r19", "metabolic", "metabolic_points >= 3 AND p < 0.35", "metabolic syndrome with low risk"),
    ("diabetes_r19", "sleep_apnea", "ahi >= 15 AND p < 0.3", "sleep apnea with low risk"),
    ("diabetes_r19", "fibrosis", "fibrosis_score >= 2.67 AND p < 0.4", "liver fibrosis with low risk"),
    ("diabetes_r19", "medication", "(array_contains(medications, 'steroids') OR array_contains(medications, 'antipsychotics')) "
     "AND p < 0.4", "steroids or antipsychotics with low risk"),
    ("diabetes_r19", "hiv_art", "coalesce(hiv_art_regimen, '') <> '' AND p < 0.35", "antiretroviral regimen with low risk"),
    ("diabetes_r19", "gestational", "gestational_diabetes AND p < 0.5", "earlier gestational diabetes with low risk"),
    ("diabetes_r19", "pediatric", "age < 18 AND pediatric_risk_score > 2 AND p < 0.4", "child with a high risk score and low risk"),
    ("diabetes_r19", "c_peptide", "c_peptide <> 0 AND c_peptide < 0.8 AND p < 0.6", "low C-peptide with low risk"),
    ("diabetes_r19", "inflammatory", "inflammatory_score >= 4 AND p < 0.3", "inflammatory burden with low risk"),
    ("diabetes_r19", "retinopathy", "retinopathy IN ('moderate', 'severe') AND p < 0.8", "advanced retinopathy with low risk"),
    ("diabetes_r19", "neuropathy", "neuropathy_confirmed AND p < 0.7", "confirmed neuropathy with low risk"),
    ("diabetes_r19", "post_covid", "post_covid_hyperglycemia AND p < 0.35", "hyperglycemia after COVID with low risk"),
    ("diabetes_r19", "toxins", "edc_exposure AND p < 0.25", "endocrine disruptor exposure with low risk"),
    ("diabetes_r19", "genetic", "prs_pct >= 90 AND p < 0.45", "polygenic score above the 90th percentile with low risk"),
    ("diabetes_r19", "prediabetes", "prediabetes AND p < 0.2", "prediabetes with low risk"),
    ("diabetes_r19", "ethnicity", "ethnicity_factor > 1.5 AND p * ethnicity_factor < 0.5", "ethnicity multiplier not reflected"),
    ("diabetes_r19", "social", "social_vulnerability >= 0.7 AND p < 0.4", "high social vulnerability with low risk"),
    # R20 hypertension, collect all
    ("hypertension", "stage_hypertension",
     "(systolic >= 140 OR diastolic >= 90) AND p < 0.4", "hypertensive BP class with low risk"),
    ("hypertension", "white_coat", "abpm_day_systolic < 130 AND systolic >= 140 AND p > 0.6",
     "white coat pattern with high risk"),
    ("hypertension", "resistant", "antihypertensive_trials >= 3 AND systolic >= 140 AND p < 0.7",
     "resistant hypertension with low risk"),
    ("hypertension", "pregnancy", "pregnant AND systolic >= 140 AND "
     "p < CASE WHEN coalesce(proteinuria, false) THEN 0.8 ELSE 0.6 END", "hypertension in pregnancy with low risk"),
    # R21 cardiovascular guideline set, collect all
    ("cardiovascular_guideline", "ascvd_mismatch", "abs(p - ascvd_risk) > 0.15", "prediction differs from ASCVD by > 0.15"),
    ("cardiovascular_guideline", "ldl", "ldl >= 190 AND p < 0.5", "LDL >= 190 with low risk"),
    ("cardiovascular_guideline", "angina", "typical_angina AND p < 0.6", "typical angina with low risk"),
    # R22 copd guideline set, collect all
    ("copd_guideline", "gold_obstruction", "fev1 / fvc < 0.7 AND fev1_pct < 80 AND p < 0.5",
     "GOLD obstruction with low risk"),
    ("copd_guideline", "exacerbations", "exacerbations >= 2 AND p < least(0.5 + exacerbations * 0.1, 0.8)",
     "risk below what the exacerbations suggest"),
    ("copd_guideline", "smoking", "pack_years > 20 AND p < 0.6", "more than 20 pack-years with low risk"),
    # R23 asthma guideline set, collect all
    ("asthma_guideline", "variability_reversibility", "fev1_variability >= 12 AND fev1_reversibility >= 12 AND p < 0.5",
     "variable, reversible obstruction with low risk"),
    ("asthma_guideline", "saba_use", "saba_uses > 2 AND p < 0.6", "SABA use > 2 with low risk"),
]

FIRST_FAILURE = {"cardiovascular"}


def rules_frame(spark, rules: Sequence[tuple[str, str, str, str]] = RULES) -> DataFrame:
    """The rule table as a DataFrame (for reporting / joins)."""
    return spark.createDataFrame([(d, c, p, m, i) for i, (d, c, p, m) in enumerate(rules)],
                                 "disease string, code string, predicate string, message string, rule_order int")


def apply_rules(df: DataFrame, key: str = "patient_id", rules: Sequence[tuple[str, str, str, str]] = RULES,
                first_failure: set[str] | None = None, with_message: bool = True) -> DataFrame:
    """One row per (patient, disease, failing rule)."""
    ff = FIRST_FAILURE if first_failure is None else first_failure
    by_disease: dict[str, list[tuple[str, str, str]]] = {}
    for d, c, p, m in rules:
        by_disease.setdefault(d, []).append((c, p, m))
    arrays = []
    for d, rs in by_disease.items():
        hits = F.filter(F.array(*[
            F.when(F.coalesce(F.expr(p), F.lit(False)),
                   F.struct(F.lit(d).alias("disease"), F.lit(c).alias("code"), F.lit(m).alias("message")))
            for c, p, m in rs]), lambda x: x.isNotNull())
        arrays.append(F.slice(hits, 1, 1) if d in ff else hits)
    allhits = F.flatten(F.array(*arrays))
    out = df.select(key, F.explode(allhits).alias("h")).select(key, "h.disease", "h.code", "h.message")
    return out if with_message else out.drop("message")


def rule_evaluability(df: DataFrame, rules: Sequence[tuple[str, str, str, str]] = RULES) -> DataFrame:
    """Per rule, how many rows it could be decided for and how many it
    fired on, so that "did not fire" and "input missing" stay apart.  One
    aggregate over the table; the counts are unpivoted afterwards."""
    aggs = []
    for i, (_, _, p, _) in enumerate(rules):
        aggs += [F.count(F.expr(p)).alias(f"e{i}"), F.count_if(F.expr(p)).alias(f"f{i}")]
    rows = F.array(*[F.struct(F.lit(d).alias("disease"), F.lit(c).alias("code"), F.col(f"e{i}").alias("n_evaluable"),
                              F.col(f"f{i}").alias("n_fired")) for i, (d, c, _, _) in enumerate(rules)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def rule_summary(hits: DataFrame, population: DataFrame, key: str = "patient_id") -> DataFrame:
    """Per (disease, code): number of flagged patients and the rate
    over the evaluated population (map-side partial counts)."""
    n = population.count()
    return hits.groupBy("disease", "code").agg(F.count(F.lit(1)).alias("n_flagged")).withColumn(
        "rate", F.col("n_flagged") / F.lit(float(n)))


#: Hash ranges in which the hits of a code are counted before its first ones are sorted.
SAMPLE_RANGES = 4096


def sample_per_code(hits: DataFrame, k: int = 3, key: str = "patient_id", seed: int = 7) -> DataFrame:
    """Up to ``k`` example cases per rule code in a seeded hash order
    (a top-k per group: the limit *is* the feature).

    Hits are first counted by code and hash range (``SAMPLE_RANGES``); those of the
    first ranges that hold ``k`` together are all that is sorted, so that no task
    sorts every hit of its input."""
    from medlake.functions.privacy import hash_unit
    code = ["disease", "code"]
    at = hits.withColumn("__u", hash_unit(key, seed=seed)).withColumn(
        "__range", F.coalesce(F.floor(F.col("__u") * SAMPLE_RANGES), F.lit(-1)))
    n = at.groupBy(*code, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*code).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    # the last range that is needed, a row for each code
    last = n.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < k).groupBy(
        *[F.col(c).alias(f"__{c}") for c in code]).agg(F.max("__range").alias("__last"))
    few = at.join(F.broadcast(last), (F.col("__range") <= F.col("__last")) & F.col("disease").eqNullSafe(F.col("__disease"))
                  & F.col("code").eqNullSafe(F.col("__code"))).select(*hits.columns, "__u")
    w = Window.partitionBy(*code).orderBy("__u", key)
    return few.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn", "__u")


# ---------------------------------------------------------------- R24 staging

def bp_class(sys="systolic", dia="diastolic") -> Column:
    s, d = F.col(sys), F.col(dia)
    return (F.when((s >= 140) | (d >= 90), "Hypertension").when(s.isNull() | d.isNull(), None)
            .when((s >= 130) | (d >= 80), "Elevated").otherwise("Normal"))


def gfr_stage(egfr="egfr") -> Column:
    e = F.col(egfr)
    return (F.when(e >= 90, "G1").when(e >= 60, "G2").when(e >= 45, "G3a").when(e >= 30, "G3b")
            .when(e >= 15, "G4").when(e < 15, "G5"))


def acr_stage(acr="acr") -> Column:
    a = F.col(acr)
    return F.when(a < 30, "A1").when(a < 300, "A2").when(a >= 300, "A3")


# fixed values: CKD risk matrix entries given in the source; others 0.5
CKD_MATRIX = {("G1", "A1"): 0.1, ("G1", "A2"): 0.2, ("G1", "A3"): 0.3}


def ckd_risk(gfr: Column, acr: Column, default: float = 0.5) -> Column:
    m = F.create_map(*[x for (g, a), v in CKD_MATRIX.items() for x in (F.lit(f"{g}|{a}"), F.lit(v))])
    return F.coalesce(m[F.concat_ws("|", gfr, acr)], F.lit(default))


# ---------------------------------------------------------------- R26 thresholds

# fixed values: bands of the disease profiles (profile, marker, predicate)
PROFILE_BANDS: list[tuple[str, str, str]] = [
    ("diabetes", "hba1c", "hba1c >= 6.5"),
    ("diabetes", "fpg", "fpg >= 126"),
    ("diabetes", "bmi", "bmi >= 30"),
    ("metabolic_syndrome", "waist_cm", "waist_cm > CASE sex WHEN 'M' THEN 102 WHEN 'F' THEN 88 END"),
    ("metabolic_syndrome", "triglycerides", "triglycerides >= 150"),
    ("metabolic_syndrome", "hdl", "hdl < CASE sex WHEN 'M' THEN 40 WHEN 'F' THEN 50 END"),
    ("hypertension_stage1", "systolic", "systolic >= 130 AND systolic < 140"),
    ("hypertension_stage1", "diastolic", "diastolic >= 80 AND diastolic < 90"),
    ("hypertension_stage2", "systolic", "systolic >= 140"),
    ("hypertension_stage2", "diastolic", "diastolic >= 90"),
    ("coronary_low", "calcium_score", "calcium_score >= 0 AND calcium_score <= 100"),
    ("coronary_moderate", "calcium_score", "calcium_score > 100 AND calcium_score <= 400"),
    ("coronary_high", "calcium_score", "calcium_score > 400"),
    ("stenosis_mild", "stenosis_pct", "stenosis_pct < 50"),
    ("stenosis_moderate", "stenosis_pct", "stenosis_pct >= 50 AND stenosis_pct <= 70"),
    ("stenosis_severe", "stenosis_pct", "stenosis_pct > 70"),
    ("copd_gold_1", "fev1_pct", "fev1_pct >= 80"),
    ("copd_gold_2", "fev1_pct", "fev1_pct >= 50 AND fev1_pct < 80"),
    ("copd_gold_3", "fev1_pct", "fev1_pct >= 30 AND fev1_pct < 50"),
    ("copd_gold_4", "fev1_pct", "fev1_pct < 30"),
    ("asthma_controlled", "saba_uses", "saba_uses <= 2"),
    ("asthma_partly_controlled", "saba_uses", "saba_uses > 2"),
    ("alzheimers", "csf_tau", "csf_tau > 300"),
    ("arthritis_remission", "das28", "das28 < 2.6"),
    ("arthritis_low", "das28", "das28 >= 2.6 AND das28 <= 3.2"),
    ("arthritis_moderate", "das28", "das28 > 3.2 AND das28 <= 5.1"),
    ("arthritis_high", "das28", "das28 > 5.1"),
    ("arthritis_remission", "cdai", "cdai <= 2.8"),
    ("kidney_g1", "egfr", "egfr >= 90"),
    ("kidney_g5", "egfr", "egfr < 15"),
    ("bone_normal", "t_score", "t_score > -1.0"),
    ("bone_osteopenia", "t_score", "t_score <= -1.0 AND t_score > -2.5"),
    ("bone_osteoporosis", "t_score", "t_score <= -2.5"),
    ("hiv_target", "viral_load", "viral_load < 50"),
    ("hiv_target", "cd4", "cd4 > 500"),
]


def profile_hits(df: DataFrame, key: str = "patient_id", bands: Sequence[tuple[str, str, str]] = PROFILE_BANDS) -> DataFrame:
    """(patient, profile, marker) for every band the patient is in -- a
    fixed, small list applied as one projection, not as a join."""
    hits = [F.when(F.coalesce(F.expr(p), F.lit(False)), F.struct(F.lit(prof).alias("profile"), F.lit(marker).alias("marker")))
            for prof, marker, p in bands]
    arr = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return df.select(key, F.explode(arr).alias("h")).select(key, "h.profile", "h.marker")
