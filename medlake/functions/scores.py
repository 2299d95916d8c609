"""Clinical risk scores (K1-K15) as column expressions over a patient table.

Inputs are column names (keyword arguments) so any table can be scored.
Inputs that the score *requires* fall back to ``FALLBACK`` (0.5, unscaled)
when NULL; inputs that default to 0 are ``coalesce``-d to 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK = 0.5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _b(x) -> Column:
    """Boolean/int flag as int, NULL -> 0."""
    c = _c(x)
    return F.coalesce(c.cast("int"), F.lit(0))


def _req(expr: Column) -> Column:
    return F.coalesce(expr, F.lit(FALLBACK))


def ascvd(base="ascvd_base") -> Column:
    """K1: 1 - 0.9533 ** exp(base - 2.4692)."""
    return _req(F.lit(1.0) - F.pow(F.lit(0.9533), F.exp(_c(base) - F.lit(2.4692))))


def framingham_heart(age="age", hdl="hdl") -> Column:
    """K2: 100 / (1 + exp(-(0.1125 age - 0.2569 hdl)))."""
    s = F.lit(0.1125) * _c(age) - F.lit(0.2569) * _c(hdl)
    return _req(F.lit(100.0) / (F.lit(1.0) + F.exp(-s)))


def chads_vasc(chf="chf", hypertension="hypertension", age="age", diabetes="diabetes", stroke="stroke_history",
               vascular="vascular_disease", female=None, sex="sex") -> Column:
    """K3: CHA2DS2-VASc; missing flags count 0."""
    a = F.coalesce(_c(age), F.lit(0))
    fem = _b(female) if female else F.coalesce((_c(sex) == F.lit("F")).cast("int"), F.lit(0))
    return (_b(chf) + _b(hypertension) + (a >= 75).cast("int") * 2 + _b(diabetes) + _b(stroke) * 2
            + _b(vascular) + ((a >= 65) & (a < 75)).cast("int") + fem)


def qdiabetes(terms="qdiabetes_terms") -> Column:
    """K4: 100 * (1 - 0.987 ** exp(terms))."""
    return _req(F.lit(100.0) * (F.lit(1.0) - F.pow(F.lit(0.987), F.exp(_c(terms)))))


# fixed values: ADA risk test, percent by number of points
ADA_PERCENT = {0: 3.0, 1: 6.0, 2: 12.0, 3: 20.0, 4: 25.0, 5: 33.0}


def ada_points(age="age", bmi="bmi", family="family_diabetes", hypertension="hypertension",
               inactive="physically_inactive") -> Column:
    return ((F.coalesce(_c(age), F.lit(0)) >= 45).cast("int") + (F.coalesce(_c(bmi), F.lit(0)) >= 25).cast("int")
            + _b(family) + _b(hypertension) + _b(inactive))


def ada_risk(points: Column) -> Column:
    """K5: percent by points; unknown count -> 50 (fallback x 100)."""
    m = F.create_map(*[x for k, v in ADA_PERCENT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[points], F.lit(FALLBACK * 100))


def gail(age="age", factor="gail_factor") -> Column:
    """K6: 100 * (1 - exp(-0.0001056 * age ** 4.334 * factor))."""
    return _req(F.lit(100.0) * (F.lit(1.0) - F.exp(F.lit(-0.0001056) * F.pow(_c(age), F.lit(4.334)) * _c(factor))))


def pcpt(psa="psa", age="age", size="prostate_volume") -> Column:
    """K7: 0.249 ln(psa) + 0.094 age - 0.068 size; 0.5 where an input is
    missing, NULL where psa <= 0 has no logarithm."""
    lnp = F.when(_c(psa) > 0, F.log(_c(psa)))
    missing = _c(psa).isNull() | _c(age).isNull() | _c(size).isNull()
    return F.when(missing, F.lit(0.5)).otherwise(F.lit(0.249) * lnp + F.lit(0.094) * _c(age) - F.lit(0.068) * _c(size))


def bode(fev1_points="fev1_points", dyspnea="dyspnea_points", walk="walk_points", bmi="bmi") -> Column:
    """K8: FEV1 points + dyspnea + walk + (bmi < 21)."""
    return _req((_c(fev1_points) + _c(dyspnea) + _c(walk) + (_c(bmi) < 21).cast("int")).cast("double"))


def asthma_exacerbation(variability="fev1_variability", saba="saba_uses") -> Column:
    """K9: 2.7 variability + 1.3 SABA uses."""
    return _req(F.lit(2.7) * _c(variability) + F.lit(1.3) * _c(saba))


def ckd_progression(egfr="egfr", acr="acr", diabetes="diabetes") -> Column:
    """0.1 eGFR + 0.3 ACR + 0.2 diabetes."""
    return _req(F.lit(0.1) * _c(egfr) + F.lit(0.3) * _c(acr) + F.lit(0.2) * _c(diabetes).cast("int"))


def aki(egfr_drop="egfr_drop_pct", sepsis="sepsis", nephrotoxins="nephrotoxins") -> Column:
    """2 (drop > 25) + 1.5 sepsis + 1 nephrotoxins."""
    s = (F.when(_c(egfr_drop) > 25, F.lit(2.0)).otherwise(F.lit(0.0))
         + F.when(_c(sepsis), F.lit(1.5)).otherwise(F.lit(0.0))
         + F.when(_c(nephrotoxins), F.lit(1.0)).otherwise(F.lit(0.0)))
    return _req(F.when(_c(egfr_drop).isNull() | _c(sepsis).isNull() | _c(nephrotoxins).isNull(), None).otherwise(s))


def framingham_stroke(age="age", sbp="systolic", hdl="hdl") -> Column:
    """0.0634 age + 0.0056 sbp - 0.0423 hdl."""
    return _req(F.lit(0.0634) * _c(age) + F.lit(0.0056) * _c(sbp) - F.lit(0.0423) * _c(hdl))


def caide(age="age", education="education_years", hypertension="hypertension", bmi="bmi",
          inactive="physically_inactive") -> Column:
    """(age >= 45) + (education < 10) + hypertension + obesity (bmi >= 30) + inactivity."""
    s = ((_c(age) >= 45).cast("int") + (_c(education) < 10).cast("int") + _c(hypertension).cast("int")
         + (_c(bmi) >= 30).cast("int") + _c(inactive).cast("int"))
    return _req(s.cast("double"))


def metabolic_syndrome(waist="waist_cm", trig="triglycerides", hdl="hdl", sbp="systolic", dbp="diastolic",
                       fpg="fpg", sex="sex") -> Column:
    """NCEP-style count: waist > 102 (M) / 88 (F), trig >= 150,
    hdl < 40 (M) / 50 (F), BP >= 130/85 [ours], glucose >= 100 [ours]."""
    male = _c(sex) == F.lit("M")
    s = ((_c(waist) > F.when(male, 102).otherwise(88)).cast("int") + (_c(trig) >= 150).cast("int")
         + (_c(hdl) < F.when(male, 40).otherwise(50)).cast("int")
         + ((_c(sbp) >= 130) | (_c(dbp) >= 85)).cast("int") + (_c(fpg) >= 100).cast("int"))
    return _req(s.cast("double"))


def composite(metabolic="metabolic_points", inflammatory="inflammatory_score", family="family_history_score",
              scale: float = 10.0) -> Column:
    """0.4 metabolic + 0.3 inflammatory + 0.3 family, scaled and clipped to [0, 1] [ours]."""
    raw = (F.lit(0.4) * _c(metabolic) + F.lit(0.3) * _c(inflammatory) + F.lit(0.3) * _c(family)) / F.lit(scale)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


ALL_SCORES = {
    "K1_ascvd": ascvd,
    "K2_framingham_heart": framingham_heart,
    "K3_chads_vasc": chads_vasc,
    "K4_qdiabetes": qdiabetes,
    "K6_gail": gail,
    "K7_pcpt": pcpt,
    "K8_bode": bode,
    "K9_asthma_exacerbation": asthma_exacerbation,
    "K10_ckd_progression": ckd_progression,
    "K11_aki": aki,
    "K12_framingham_stroke": framingham_stroke,
    "K13_caide": caide,
    "K14_metabolic_syndrome": metabolic_syndrome,
    "K15_composite": composite,
}
