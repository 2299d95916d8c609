"""Rules, scores, genomics, privacy helpers and audits on hand-made rows."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from medlake.functions import privacy as px
from medlake.functions import scores as sc
from medlake.operators import audit, genomics, rules
from medlake.sources.reference_data import prs_panels, snp_table


def test_prs_a18(spark):
    g = spark.createDataFrame([("P1", "rs7903146", "TT"), ("P1", "rs7412", "CT"), ("P1", "rs12248560", "AA"),
                               ("P2", "rs4506565", None)], "patient_id string, rsid string, genotype string")
    pats = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "patient_id string")
    prs = {(r["patient_id"], r["condition"]): r["prs"] for r in
           genomics.polygenic_scores(g, prs_panels(spark), snp_table(spark), pats).collect()}
    assert prs[("P1", "diabetes")] == pytest.approx(1.35 ** 2 - 1)
    assert prs[("P1", "alzheimers")] == pytest.approx(3.10 - 1)
    assert prs[("P2", "diabetes")] == 0.0 and prs[("P3", "alzheimers")] == 0.0


def test_rules_first_failure_vs_collect_all(spark):
    df = spark.createDataFrame([("A", 200.0, 150, False, 0.1, 0.9)],
                               "patient_id string, ldl double, systolic int, on_antihypertensives boolean, p double, "
                               "ascvd_risk double")
    rs = [r for r in rules.RULES if r[0] == "cardiovascular"]
    first = rules.apply_rules(df, rules=rs).collect()
    assert [r["code"] for r in first] == ["ldl_high_low_p"]
    allr = rules.apply_rules(df, rules=rs, first_failure=set()).collect()
    assert [r["code"] for r in allr] == ["ldl_high_low_p", "sbp_untreated_low_p", "ascvd_mismatch"]


def test_rules_null_not_flagged(spark):
    df = spark.createDataFrame([("A", None, 0.1)], "patient_id string, calprotectin double, p double")
    rs = [r for r in rules.RULES if r[0] == "ibd"]
    assert rules.apply_rules(df, rules=rs).count() == 0


def test_staging(spark):
    df = spark.createDataFrame([(140, 70, 95.0, 10.0), (131, 70, 59.0, 300.0), (120, 79, 14.0, 29.9)],
                               "systolic int, diastolic int, egfr double, acr double")
    got = [tuple(r) for r in df.select(rules.bp_class(), rules.gfr_stage(), rules.acr_stage(),
                                       rules.ckd_risk(rules.gfr_stage(), rules.acr_stage())).collect()]
    assert got == [("Hypertension", "G1", "A1", 0.1), ("Elevated", "G3a", "A3", 0.5), ("Normal", "G5", "A1", 0.5)]


def test_scores_fallback_and_chads(spark):
    df = spark.createDataFrame([(80, "F", True, True, True, True, True, None)],
                               "age int, sex string, chf boolean, hypertension boolean, diabetes boolean, "
                               "stroke_history boolean, vascular_disease boolean, hdl double")
    r = df.select(sc.chads_vasc().alias("c"), sc.framingham_heart().alias("f")).first()
    assert r["c"] == 1 + 1 + 2 + 1 + 2 + 1 + 0 + 1
    assert r["f"] == 0.5  # required input missing -> fallback


def test_privacy_helpers(spark):
    df = spark.createDataFrame([("abcdefgh",), ("abc",), ("P001",)], "s string")
    masked = [r[0] for r in df.select(px.mask_tail("s", 4)).collect()]
    assert masked == ["****efgh", "abc", "P001"]
    sig = df.select(px.hmac_sha256("s", "k3y")).first()[0]
    assert sig == hmac.new(b"k3y", b"abcdefgh", hashlib.sha256).hexdigest()
    assert df.select(px.pseudonymize("s")).first()[0] == hashlib.sha256(b"abcdefgh").hexdigest()
    key = "00" * 32
    rt = df.select(px.decrypt(px.encrypt("s", key), key)).collect()
    assert [r[0] for r in rt] == ["abcdefgh", "abc", "P001"]
    clean = spark.createDataFrame([("a;b'c\"d<e>f\\g",)], "s string").select(px.sanitize("s")).first()[0]
    assert clean == "abcdefg"


def test_consent_prefix_semantics(spark):
    vault = spark.createDataFrame([("t1", "P1", 1), ("t2", "P10", 2), ("t3", "P2", 3)], "token string, value string, key int")
    rev = spark.createDataFrame([("P1",)], "patient_id string")
    assert sorted(r["token"] for r in audit.revoke_consent(vault, rev).collect()) == ["t3"]
    assert sorted(r["token"] for r in audit.revoke_consent(vault, rev, exact=True).collect()) == ["t2", "t3"]


def test_tokenize_roundtrip(spark):
    df = spark.createDataFrame([(1, "alice"), (2, "alice")], "id int, name string")
    tok, vault = audit.tokenize(df, "name", "id", "test-vault")
    toks = [r["name"] for r in tok.collect()]
    assert len(set(toks)) == 2  # equal values get different tokens
    back = sorted(tuple(r) for r in audit.detokenize(tok, "name", vault).select("id", "name").collect())
    assert back == [(1, "alice"), (2, "alice")]


def test_out_of_hours_inclusive(spark):
    df = spark.createDataFrame([("2024-01-01 08:00:00",), ("2024-01-01 18:00:00",), ("2024-01-01 18:00:01",)],
                               "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in df.select(audit.out_of_hours(F.col("t"))).collect()] == [False, False, True]


def test_guideline_sets_are_complete():
    """Sizes of the long sets; the third diabetes rule has two outcomes."""
    from collections import Counter
    n = Counter(r[0] for r in rules.RULES)
    assert (n["diabetes"], n["diabetes_r19"], n["hypertension"], n["cardiovascular_guideline"], n["copd_guideline"]) == (23, 20, 4, 3, 3)
    assert len({(r[0], r[1]) for r in rules.RULES}) == len(rules.RULES)


def test_hand_computed_guideline_cases(spark):
    row = ("A", 0.31, 210.0, None, 16, 97.0, "steroids,statins", 4.0, "severe", 2, True, 150, None)
    other = ("B", 0.31, 210.0, 60, 40, None, None, None, None, None, None, 150, True)
    df = spark.createDataFrame([row, other], "patient_id string, p double, ppg double, ppg_minutes int, age int, bmi_percentile double, "
                               "meds string, crp double, covid_severity string, exacerbations int, pregnant boolean, systolic int, "
                               "proteinuria boolean").withColumn("medications", F.split("meds", ","))
    codes = {"ppg_untimed", "ppg", "pediatric_bmi", "medications", "inflammation", "post_covid", "exacerbations", "pregnancy"}
    subset = [r for r in rules.RULES if r[1] in codes and r[0] in ("diabetes", "hypertension", "copd_guideline")]
    got = {(r["patient_id"], r["code"]) for r in rules.apply_rules(df, rules=subset).collect()}
    assert got == {("A", c) for c in ("ppg_untimed", "pediatric_bmi", "medications", "inflammation", "post_covid", "exacerbations",
                                      "pregnancy")} | {("B", "ppg")}
    seen = {r["code"]: (r["n_evaluable"], r["n_fired"]) for r in rules.rule_evaluability(df, subset).collect()}
    assert seen["inflammation"] == (1, 1) and seen["ppg"] == (2, 1) and seen["pediatric_bmi"] == (2, 1)


def test_staging_of_missing_inputs(spark):
    df = spark.createDataFrame([(None, None, None, None), (150, None, 10.0, 400.0), (120, 70, 95.0, 10.0), (120, None, 95.0, 10.0)],
                               "systolic int, diastolic int, egfr double, acr double")
    got = [tuple(r) for r in df.select(rules.bp_class(), rules.gfr_stage(), rules.acr_stage()).collect()]
    assert got == [(None, None, None), ("Hypertension", "G5", "A3"), ("Normal", "G1", "A1"), (None, "G1", "A1")]


def test_hmac_of_a_long_key(spark):
    key = "k" * 100
    got = spark.createDataFrame([("value",)], "v string").select(px.hmac_sha256("v", key)).first()[0]
    assert got == hmac.new(key.encode(), b"value", hashlib.sha256).hexdigest()
