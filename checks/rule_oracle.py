"""Expected clinical rules, written out from the specification.

Nothing here is taken from the implementation's lists: every rule states its
condition on its own, as the ``WHERE`` clause of rows that must be flagged.
``None`` codes cannot occur; a rule that is missing on either side shows up as
a row-count mismatch.
"""

from __future__ import annotations

# (set, code, condition); order matters only where the first failure wins
EXPECTED: list[tuple[str, str, str]] = [
    ("cardiovascular", "ldl_high_low_p", "ldl > 190 AND p < 0.4"),
    ("cardiovascular", "sbp_untreated_low_p", "systolic > 140 AND on_antihypertensives = false AND p < 0.5"),
    ("cardiovascular", "ascvd_mismatch", "p - ascvd_risk > 0.2 OR ascvd_risk - p > 0.2"),
    ("copd", "obstruction_smoker", "p < 0.6 AND pack_years > 20 AND fev1 / fvc < 0.7"),
    ("osteoporosis", "low_t_score", "t_score IS NOT NULL AND t_score <= -2.5 AND p < 0.3"),
    ("asthma", "variability", "p < 0.4 AND fev1_variability > 12"),
    ("ckd", "egfr_acr", "p < 0.5 AND egfr < 60 AND acr > 30"),
    ("nafld", "fibrosis", "p < 0.4 AND fibrosis_score >= 2.67"),
    ("depression", "phq9", "phq9 IS NOT NULL AND phq9 >= 15 AND p < 0.6"),
    ("osteoarthritis", "joint_space", "p < 0.4 AND joint_space < 3"),
    ("sleep_apnea", "ahi", "p < 0.5 AND ahi >= 15"),
    ("cancer", "family_history", "p < 0.3 AND family_history_score > 2"),
    ("rheumatoid_arthritis", "ccp_inflammation", "p < 0.4 AND ccp_positive = true AND joint_inflammation = true"),
    ("thyroid", "tsh_symptoms", "p < 0.4 AND tsh > 4.5 AND hypothyroid_symptoms = true"),
    ("ibd", "calprotectin", "p < 0.5 AND calprotectin > 200"),
    ("anemia", "microcytic", "p < 0.4 AND hemoglobin < 11 AND mcv < 80"),
    ("migraine", "frequency", "p < 0.4 AND headache_frequency > 15"),
    ("alzheimers", "amyloid_decline", "p < 0.5 AND amyloid_pet IS NOT DISTINCT FROM 'positive' AND cognitive_decline = true"),
    ("diabetes", "hba1c", "hba1c IS NOT NULL AND NOT hba1c < 6.5 AND p < 0.3"),
    ("diabetes", "fpg", "NOT fpg < 126 AND p < 0.25"),
    ("diabetes", "ppg_untimed", "ppg IS NOT NULL AND NOT ppg < 200 AND (ppg_minutes IS NULL OR ppg_minutes = 0)"),
    ("diabetes", "ppg", "ppg IS NOT NULL AND NOT ppg < 200 AND ppg_minutes IS NOT NULL AND ppg_minutes <> 0 AND p < 0.4"),
    ("diabetes", "pediatric_bmi", "age < 18 AND bmi_percentile IS NOT NULL AND bmi_percentile >= 95 AND p < 0.35"),
    ("diabetes", "gestational", "p < 0.5 AND gestational_diabetes IS TRUE"),
    ("diabetes", "pcos", "pcos IS TRUE AND sex = 'F' AND p < 0.4 + 0.05 * CASE WHEN pcos_years IS NULL THEN 0 ELSE pcos_years END - 0.15"),
    ("diabetes", "metabolic_syndrome", "p < 0.3 AND metabolic_points >= 3"),
    ("diabetes", "c_peptide", "c_peptide IS NOT NULL AND c_peptide < 0.8 AND p < 0.6"),
    ("diabetes", "autoantibodies", "p < 0.7 AND (gad65 IS TRUE OR ia2 IS TRUE OR zn8 IS TRUE)"),
    ("diabetes", "insulin_resistance", "homa_ir IS NOT NULL AND homa_ir > 2.5 AND p < 0.4"),
    ("diabetes", "family_risk", "family_history_score > 2 AND p + family_history_score * 0.15 < 0.5"),
    ("diabetes", "medications", "p < 0.35 AND len(list_intersect(coalesce(medications, []), ['thiazides', 'steroids'])) > 0"),
    ("diabetes", "sleep_apnea", "p < 0.3 AND ahi >= 15"),
    ("diabetes", "inflammation", "crp IS NOT NULL AND crp >= 3 AND p < 0.25 + crp / 10"),
    ("diabetes", "vitamin_d", "vitamin_d IS NOT NULL AND vitamin_d <> 0 AND vitamin_d < 20 AND p < 0.3"),
    ("diabetes", "liver", "alt IS NOT NULL AND alt >= 40 AND p < 0.25 + alt / 200"),
    ("diabetes", "retinopathy", "p < 0.8 AND coalesce(retinopathy, 'none') <> 'none'"),
    ("diabetes", "neuropathy", "p < 0.6 AND neuropathy_symptoms IS TRUE"),
    ("diabetes", "foot_exam", "p < 0.7 AND (foot_ulcers IS TRUE OR monofilament IS NOT DISTINCT FROM 'abnormal')"),
    ("diabetes", "post_covid", "(covid_severity IS NOT DISTINCT FROM 'severe' AND p < 0.3 + 0.15) OR "
                               "(covid_severity IS NOT DISTINCT FROM 'moderate' AND p < 0.3 + 0.08)"),
    ("diabetes", "prediabetes_years", "prediabetes_years IS NOT NULL AND prediabetes_years > 3 AND p < 0.05 * prediabetes_years"),
    ("diabetes", "ethnicity", "ethnicity_factor IS NOT NULL AND ethnicity_factor > 1.3 AND p * ethnicity_factor < 0.5"),
    ("diabetes_basic", "hba1c", "hba1c IS NOT NULL AND hba1c >= 6.5 AND p < 0.3"),
    ("hypertension_r19", "systolic", "p < 0.4 AND systolic > 130"),
    ("diabetes_r19", "hba1c", "hba1c IS NOT NULL AND hba1c >= 6.5 AND p < 0.3"),
    ("diabetes_r19", "fpg", "p < 0.25 AND fpg >= 126"),
    ("diabetes_r19", "ppg", "p < 0.4 AND ppg IS NOT NULL AND ppg >= 200"),
    ("diabetes_r19", "metabolic", "p < 0.35 AND metabolic_points >= 3"),
    ("diabetes_r19", "sleep_apnea", "p < 0.3 AND ahi >= 15"),
    ("diabetes_r19", "fibrosis", "p < 0.4 AND fibrosis_score >= 2.67"),
    ("diabetes_r19", "medication", "p < 0.4 AND len(list_intersect(coalesce(medications, []), ['steroids', 'antipsychotics'])) > 0"),
    ("diabetes_r19", "hiv_art", "p < 0.35 AND hiv_art_regimen IS NOT NULL AND length(hiv_art_regimen) > 0"),
    ("diabetes_r19", "gestational", "p < 0.5 AND gestational_diabetes IS TRUE"),
    ("diabetes_r19", "pediatric", "p < 0.4 AND age < 18 AND pediatric_risk_score > 2"),
    ("diabetes_r19", "c_peptide", "p < 0.6 AND c_peptide IS NOT NULL AND c_peptide <> 0 AND c_peptide < 0.8"),
    ("diabetes_r19", "inflammatory", "p < 0.3 AND inflammatory_score >= 4"),
    ("diabetes_r19", "retinopathy", "p < 0.8 AND (retinopathy IS NOT DISTINCT FROM 'moderate' OR retinopathy IS NOT DISTINCT FROM 'severe')"),
    ("diabetes_r19", "neuropathy", "p < 0.7 AND neuropathy_confirmed IS TRUE"),
    ("diabetes_r19", "post_covid", "p < 0.35 AND post_covid_hyperglycemia IS TRUE"),
    ("diabetes_r19", "toxins", "p < 0.25 AND edc_exposure IS TRUE"),
    ("diabetes_r19", "genetic", "p < 0.45 AND prs_pct IS NOT NULL AND prs_pct >= 90"),
    ("diabetes_r19", "prediabetes", "p < 0.2 AND prediabetes IS TRUE"),
    ("diabetes_r19", "ethnicity", "ethnicity_factor IS NOT NULL AND ethnicity_factor > 1.5 AND p * ethnicity_factor < 0.5"),
    ("diabetes_r19", "social", "p < 0.4 AND social_vulnerability IS NOT NULL AND social_vulnerability >= 0.7"),
    ("hypertension", "stage_hypertension", "p < 0.4 AND greatest(systolic - 140, diastolic - 90) >= 0"),
    ("hypertension", "white_coat", "abpm_day_systolic IS NOT NULL AND abpm_day_systolic < 130 AND systolic >= 140 AND p > 0.6"),
    ("hypertension", "resistant", "antihypertensive_trials IS NOT NULL AND antihypertensive_trials >= 3 AND systolic >= 140 AND p < 0.7"),
    ("hypertension", "pregnancy", "pregnant IS TRUE AND systolic >= 140 AND (p < 0.6 OR (proteinuria IS TRUE AND p < 0.8))"),
    ("cardiovascular_guideline", "ascvd_mismatch", "p - ascvd_risk > 0.15 OR ascvd_risk - p > 0.15"),
    ("cardiovascular_guideline", "ldl", "p < 0.5 AND ldl >= 190"),
    ("cardiovascular_guideline", "angina", "p < 0.6 AND typical_angina IS TRUE"),
    ("copd_guideline", "gold_obstruction", "p < 0.5 AND fev1_pct < 80 AND fev1 / fvc < 0.7"),
    ("copd_guideline", "exacerbations", "exacerbations IS NOT NULL AND exacerbations >= 2 AND p < CASE WHEN exacerbations >= 3 "
                                        "THEN 0.8 ELSE 0.7 END"),
    ("copd_guideline", "smoking", "p < 0.6 AND pack_years > 20"),
    ("asthma_guideline", "variability_reversibility", "p < 0.5 AND fev1_variability >= 12 AND fev1_reversibility >= 12"),
    ("asthma_guideline", "saba_use", "p < 0.6 AND saba_uses > 2"),
]

# inventory key -> rule sets
SETS = {
    "R1": ["cardiovascular"], "R2": ["copd"], "R3": ["osteoporosis"], "R4": ["asthma"], "R5": ["ckd"], "R6": ["nafld"],
    "R7": ["depression"], "R8": ["osteoarthritis"], "R9": ["sleep_apnea"], "R10": ["cancer"], "R11": ["rheumatoid_arthritis"],
    "R12": ["thyroid"], "R13": ["ibd"], "R14": ["anemia"], "R15": ["migraine"], "R16": ["alzheimers"], "R17": ["diabetes_basic"],
    "R18": ["diabetes"], "R19": ["diabetes_r19", "hypertension_r19"], "R20": ["hypertension"], "R21": ["cardiovascular_guideline"],
    "R22": ["copd_guideline"], "R23": ["asthma_guideline"],
}

# inputs that decide whether a rule can be evaluated: a rule is evaluable
# unless the missing ones leave its outcome open (three-valued logic), so
# only the columns that can be NULL are listed, with the rows they leave open
OPEN = {
    ("diabetes", "hba1c"): "hba1c IS NULL AND p < 0.3",
    ("diabetes_basic", "hba1c"): "hba1c IS NULL AND p < 0.3",
    ("diabetes_r19", "hba1c"): "hba1c IS NULL AND p < 0.3",
    ("alzheimers", "amyloid_decline"): "amyloid_pet IS NULL AND cognitive_decline AND p < 0.5",
    ("diabetes", "ppg_untimed"): "ppg IS NULL AND coalesce(ppg_minutes, 0) = 0",
    ("diabetes", "ppg"): "ppg IS NULL AND coalesce(ppg_minutes, 0) <> 0 AND p < 0.4",
    ("diabetes", "pediatric_bmi"): "bmi_percentile IS NULL AND age < 18 AND p < 0.35",
    ("diabetes", "gestational"): "gestational_diabetes IS NULL AND p < 0.5",
    ("diabetes", "c_peptide"): "c_peptide IS NULL AND p < 0.6",
    ("diabetes", "insulin_resistance"): "homa_ir IS NULL AND p < 0.4",
    ("diabetes", "medications"): "medications IS NULL AND p < 0.35",
    ("diabetes", "inflammation"): "crp IS NULL",
    ("diabetes", "vitamin_d"): "vitamin_d IS NULL AND p < 0.3",
    ("diabetes", "liver"): "alt IS NULL",
    ("diabetes", "retinopathy"): "retinopathy IS NULL AND p < 0.8",
    ("diabetes", "neuropathy"): "neuropathy_symptoms IS NULL AND p < 0.6",
    ("diabetes", "post_covid"): "covid_severity IS NULL AND p < 0.38",
    ("diabetes", "prediabetes_years"): "prediabetes_years IS NULL",
    ("diabetes", "ethnicity"): "ethnicity_factor IS NULL",
    ("diabetes_r19", "ppg"): "ppg IS NULL AND p < 0.4",
    ("diabetes_r19", "medication"): "medications IS NULL AND p < 0.4",
    ("diabetes_r19", "gestational"): "gestational_diabetes IS NULL AND p < 0.5",
    ("diabetes_r19", "c_peptide"): "c_peptide IS NULL AND p < 0.6",
    ("diabetes_r19", "retinopathy"): "retinopathy IS NULL AND p < 0.8",
    ("diabetes_r19", "genetic"): "prs_pct IS NULL AND p < 0.45",
    ("diabetes_r19", "ethnicity"): "ethnicity_factor IS NULL",
    ("diabetes_r19", "social"): "social_vulnerability IS NULL AND p < 0.4",
    ("hypertension", "white_coat"): "abpm_day_systolic IS NULL AND systolic >= 140 AND p > 0.6",
    ("hypertension", "resistant"): "antihypertensive_trials IS NULL AND systolic >= 140 AND p < 0.7",
    ("copd_guideline", "exacerbations"): "exacerbations IS NULL AND p < 0.8",
}

# (profile, marker, condition)
BANDS: list[tuple[str, str, str]] = [
    ("diabetes", "hba1c", "hba1c IS NOT NULL AND NOT hba1c < 6.5"), ("diabetes", "fpg", "NOT fpg < 126"), ("diabetes", "bmi", "NOT bmi < 30"),
    ("metabolic_syndrome", "waist_cm", "(sex = 'M' AND waist_cm > 102) OR (sex = 'F' AND waist_cm > 88)"),
    ("metabolic_syndrome", "triglycerides", "NOT triglycerides < 150"),
    ("metabolic_syndrome", "hdl", "(sex = 'M' AND hdl < 40) OR (sex = 'F' AND hdl < 50)"),
    ("hypertension_stage1", "systolic", "systolic BETWEEN 130 AND 139"), ("hypertension_stage1", "diastolic", "diastolic BETWEEN 80 AND 89"),
    ("hypertension_stage2", "systolic", "systolic > 139"), ("hypertension_stage2", "diastolic", "diastolic > 89"),
    ("coronary_low", "calcium_score", "calcium_score BETWEEN 0 AND 100"),
    ("coronary_moderate", "calcium_score", "calcium_score > 100 AND NOT calcium_score > 400"),
    ("coronary_high", "calcium_score", "calcium_score > 400"),
    ("stenosis_mild", "stenosis_pct", "stenosis_pct IS NOT NULL AND stenosis_pct < 50"),
    ("stenosis_moderate", "stenosis_pct", "stenosis_pct BETWEEN 50 AND 70"),
    ("stenosis_severe", "stenosis_pct", "stenosis_pct IS NOT NULL AND stenosis_pct > 70"),
    ("copd_gold_1", "fev1_pct", "NOT fev1_pct < 80"), ("copd_gold_2", "fev1_pct", "NOT fev1_pct < 50 AND fev1_pct < 80"),
    ("copd_gold_3", "fev1_pct", "NOT fev1_pct < 30 AND fev1_pct < 50"), ("copd_gold_4", "fev1_pct", "fev1_pct < 30"),
    ("asthma_controlled", "saba_uses", "NOT saba_uses > 2"), ("asthma_partly_controlled", "saba_uses", "saba_uses > 2"),
    ("alzheimers", "csf_tau", "csf_tau > 300"),
    ("arthritis_remission", "das28", "das28 < 2.6"), ("arthritis_low", "das28", "das28 BETWEEN 2.6 AND 3.2"),
    ("arthritis_moderate", "das28", "das28 > 3.2 AND NOT das28 > 5.1"), ("arthritis_high", "das28", "das28 > 5.1"),
    ("arthritis_remission", "cdai", "NOT cdai > 2.8"),
    ("kidney_g1", "egfr", "NOT egfr < 90"), ("kidney_g5", "egfr", "egfr < 15"),
    ("bone_normal", "t_score", "t_score IS NOT NULL AND t_score > -1"),
    ("bone_osteopenia", "t_score", "t_score IS NOT NULL AND NOT t_score > -1 AND t_score > -2.5"),
    ("bone_osteoporosis", "t_score", "t_score IS NOT NULL AND NOT t_score > -2.5"),
    ("hiv_target", "viral_load", "viral_load IS NOT NULL AND viral_load < 50"), ("hiv_target", "cd4", "cd4 > 500"),
]


def hits_sql(only: list[str] | None = None) -> str:
    """Flagged rows; in the cardiovascular set the first failure wins."""
    parts, earlier = [], []
    for name, code, cond in EXPECTED:
        if only is not None and name not in only:
            continue
        cond = f"({cond}) IS TRUE"
        if name == "cardiovascular":
            earlier.append(cond)
            cond = " AND ".join([cond, *[f"NOT ({c})" for c in earlier[:-1]]])
        parts.append(f"SELECT patient_id, '{name}' AS disease, '{code}' AS code FROM clinical WHERE {cond}")
    return " UNION ALL ".join(parts)


def evaluability_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS disease, '{code}' AS code, count(*) FILTER (WHERE NOT coalesce({OPEN.get((name, code), 'false')}, false)) "
        f"AS n_evaluable, count(*) FILTER (WHERE ({cond}) IS TRUE) AS n_fired FROM clinical" for name, code, cond in EXPECTED)


def bands_sql() -> str:
    return " UNION ALL ".join(f"SELECT patient_id, '{a}' AS profile, '{m}' AS marker FROM clinical WHERE ({c}) IS TRUE" for a, m, c in BANDS)
