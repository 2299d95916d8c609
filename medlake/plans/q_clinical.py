"""Registered queries for the rule engine (R), risk scores (K) and
genomics (L) over the derived clinical and genotype tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.functions import scores as sc
from medlake.operators import genomics as gx
from medlake.operators import rules
from medlake.plans.catalog import register
from medlake.sources.derived import derived
from medlake.sources.reference_data import prs_panels, snp_table


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- R
@register("R0_rule_hits")
def r0(spark, sf):
    return rules.apply_rules(derived(spark, sf, "clinical"), with_message=False)


@register("R0_rule_evaluability")
def r0e(spark, sf):
    return rules.rule_evaluability(derived(spark, sf, "clinical"))


@register("R25_rule_summary")
def r25(spark, sf):
    c = derived(spark, sf, "clinical")
    s = rules.rule_summary(rules.apply_rules(c, with_message=False), c)
    return s.withColumn("rate", r6("rate"))


@register("R25_rule_samples")
def r25b(spark, sf):
    c = derived(spark, sf, "clinical")
    return rules.sample_per_code(rules.apply_rules(c, with_message=False), k=3)


@register("R24_bp_ckd_staging")
def r24(spark, sf):
    c = derived(spark, sf, "clinical")
    g, a = rules.gfr_stage(), rules.acr_stage()
    return c.select("patient_id", rules.bp_class().alias("bp_class"), g.alias("gfr_stage"), a.alias("acr_stage"),
                    rules.ckd_risk(g, a).alias("ckd_risk"))


@register("R26_profile_threshold_counts")
def r26(spark, sf):
    h = rules.profile_hits(derived(spark, sf, "clinical"))
    return h.groupBy("profile", "marker").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- K
def _score_query(name, fn):
    def q(spark, sf):
        c = derived(spark, sf, "clinical")
        return c.select("patient_id", r6(fn()).alias("score"))
    q.__name__ = name
    register(name)(q)


for _name, _fn in sc.ALL_SCORES.items():
    _score_query(_name, _fn)


@register("K5_ada_risk")
def k5(spark, sf):
    c = derived(spark, sf, "clinical")
    pts = sc.ada_points(family=(F.col("family_history_score") >= 3))
    return c.select("patient_id", pts.alias("points"), r6(sc.ada_risk(pts)).alias("score"))


# ---------------------------------------------------------------- L
@register("L1_snp_factors")
def l1(spark, sf):
    g = derived(spark, sf, "genotypes")
    s = F.broadcast(snp_table(spark))
    j = g.join(s, "rsid", "inner")
    return j.select("patient_id", "rsid", r6(gx.snp_factor(F.col("genotype"), F.col("allele"), F.col("risk")))
                    .alias("factor"))


def _prs(spark, sf, conditions=None):
    g = derived(spark, sf, "genotypes")
    pats = derived(spark, sf, "medical").select("patient_id")
    return gx.polygenic_scores(g, prs_panels(spark), snp_table(spark), pats, conditions=conditions)


@register("L2_prs_diabetes")
def l2(spark, sf):
    return _prs(spark, sf, ["diabetes"]).withColumn("prs", r6("prs"))


@register("L3_prs_all_conditions")
def l3(spark, sf):
    return _prs(spark, sf).withColumn("prs", r6("prs"))


@register("L5_prs_percentile")
def l5(spark, sf):
    p = gx.prs_percentile(_prs(spark, sf).withColumn("prs", F.round("prs", 9)))
    return p.select("patient_id", "condition", r6("prs").alias("prs"), r6("percentile").alias("percentile"))


@register("L6_allele_frequency")
def l6(spark, sf):
    f = gx.allele_frequencies(derived(spark, sf, "genotypes"), snp_table(spark))
    return f.select("rsid", "population_freq", r6("observed_freq").alias("observed_freq"), "n_called")


# one query per rule set of the inventory (R1-R23): the engine restricted to that set
RULE_SETS = {
    "R1": ["cardiovascular"], "R2": ["copd"], "R3": ["osteoporosis"], "R4": ["asthma"], "R5": ["ckd"],
    "R6": ["nafld"], "R7": ["depression"], "R8": ["osteoarthritis"], "R9": ["sleep_apnea"], "R10": ["cancer"],
    "R11": ["rheumatoid_arthritis"], "R12": ["thyroid"], "R13": ["ibd"], "R14": ["anemia"], "R15": ["migraine"],
    "R16": ["alzheimers"], "R17": ["diabetes_basic"], "R18": ["diabetes"], "R19": ["diabetes_r19", "hypertension_r19"],
    "R20": ["hypertension"], "R21": ["cardiovascular_guideline"], "R22": ["copd_guideline"],
    "R23": ["asthma_guideline"],
}


def _rule_set_query(key, diseases):
    subset = [r for r in rules.RULES if r[0] in diseases]

    def q(spark, sf):
        return rules.apply_rules(derived(spark, sf, "clinical"), rules=subset, with_message=False)
    q.__name__ = f"{key}_rule_hits"
    register(f"{key}_{diseases[0]}_rule_hits")(q)


for _k, _d in RULE_SETS.items():
    _rule_set_query(_k, _d)


@register("L3_prs_wide")
def l3w(spark, sf):
    w = gx.prs_wide(_prs(spark, sf), conditions=["alzheimers", "diabetes"])
    return w.select("patient_id", r6("alzheimers").alias("alzheimers"), r6("diabetes").alias("diabetes"))
