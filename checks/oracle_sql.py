"""DuckDB oracle SQL, written independently of the Spark operators.

Only the *input* derivations (patient-shaped tables computed from the
landed tables) are shared with Spark, so both engines start from the same
rows; everything each query computes on top is re-stated here in plain SQL.
"""

from __future__ import annotations

from medlake.sources.derived import GENOTYPE_SNPS, SPECS


def cte(*names: str) -> str:
    """``WITH`` clause defining the derived tables ``names`` (in order)."""
    parts = []
    for n in names:
        if n == "genotypes":
            snps = ", ".join(f"({i}, '{r}', '{a}')" for i, (r, a) in enumerate(GENOTYPE_SNPS))
            parts.append(
                "genotypes AS (SELECT printf('P%03d', c_custkey) AS patient_id, s.rsid, "
                "CASE (c_custkey + s.idx) % 4 WHEN 0 THEN s.allele || s.allele WHEN 1 THEN s.allele || 'N' "
                "WHEN 2 THEN 'NN' END AS genotype "
                f"FROM customer CROSS JOIN (VALUES {snps}) AS s(idx, rsid, allele))")
            continue
        if n == "meds":
            parts.append(
                "meds AS (SELECT printf('P%03d', o_custkey) AS patient_id, printf('D%02d', l_partkey % 50) AS drug, "
                "l_shipdate AS ts, l_quantity AS qty, l_orderkey, l_linenumber "
                "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
            continue
        src, where, cols = SPECS[n]
        sel = ", ".join(f"{e} AS {a}" for e, a in cols)
        w = f" WHERE {where}" if where else ""
        parts.append(f"{n} AS (SELECT {sel} FROM {src}{w})")
    return "WITH " + ",\n".join(parts) + "\n"


def _with(names: tuple[str, ...], extra: str, final: str) -> str:
    """CTEs for ``names`` then further CTE text ``extra`` (may be empty) and the final SELECT."""
    head = cte(*names)
    if extra:
        head = head.rstrip("\n") + ",\n" + extra + "\n"
    return head + final


RISK_FLAGSHIP = _with(("medical", "lifestyle", "zones"), """
m AS (SELECT *, cast(2024 - birth_year AS int) AS age, weight_kg / (height_m * height_m) AS bmi FROM medical),
v AS (SELECT * FROM m WHERE patient_id IS NOT NULL AND regexp_matches(patient_id, '^P[0-9]{3}$')
      AND age BETWEEN 18 AND 120 AND bmi BETWEEN 15.0 AND 50.0 AND disease_risk IN (0, 1)),
j AS (SELECT v.*, l.smoking_status, l.exercise_frequency, l.alcohol_consumption, l.diet_quality
      FROM v JOIN lifestyle l ON v.patient_id = l.patient_id),
f AS (SELECT *, 0.5 * fasting_glucose + 0.3 * hdl_cholesterol - 0.2 * triglycerides AS metabolic_score,
      (CASE smoking_status WHEN 'never' THEN 0 WHEN 'former' THEN 1 WHEN 'current' THEN 3 END)
      + greatest(0, 4 - exercise_frequency)
      + (CASE WHEN alcohol_consumption IS NULL THEN NULL ELSE least(alcohol_consumption, 10) END) AS lifestyle_risk
      FROM j),
fills AS (SELECT median(fasting_glucose) AS g, median(triglycerides) AS t, median(alcohol_consumption) AS a,
          median(metabolic_score) AS ms, median(lifestyle_risk) AS lr,
          (SELECT smoking_status FROM f WHERE smoking_status IS NOT NULL GROUP BY 1
           ORDER BY count(*) DESC, 1 LIMIT 1) AS sm FROM f),
i AS (SELECT f.* REPLACE (coalesce(fasting_glucose, g) AS fasting_glucose, coalesce(triglycerides, t) AS triglycerides,
      coalesce(alcohol_consumption, a) AS alcohol_consumption, coalesce(metabolic_score, ms) AS metabolic_score,
      coalesce(lifestyle_risk, lr) AS lifestyle_risk, coalesce(smoking_status, sm) AS smoking_status)
      FROM f, fills),
z AS (SELECT i.*, zn.zip_code AS zone_zip, zn.pm2_5, zn.no2_level,
      0.7 * zn.pm2_5 + 0.3 * zn.no2_level AS pollution_index
      FROM i LEFT JOIN zones zn ON i.longitude > zn.min_x AND i.longitude < zn.max_x
      AND i.latitude > zn.min_y AND i.latitude < zn.max_y),
s AS (SELECT *, 1.0 / (1.0 + exp(-(0.03 * (coalesce(age, 50) - 50) + 0.08 * (coalesce(bmi, 25) - 25)
      + 0.02 * (coalesce(metabolic_score, 40) - 40) + 0.15 * (coalesce(lifestyle_risk, 5) - 5)
      + 0.01 * (coalesce(pollution_index, 0) - 0)))) AS risk_score FROM z),
c AS (SELECT *, CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END
      AS risk_category FROM s)""", """SELECT risk_category, count(*) AS n_patients, round(avg(risk_score), 6) AS avg_score,
count(zone_zip) AS n_in_zone FROM c GROUP BY risk_category""")


ORACLE: dict[str, str] = {
    "X0_risk_category_counts": RISK_FLAGSHIP,
}


def _bi(expr: str) -> str:
    return f"cast({expr} AS bigint)"


_M_AGE_BMI = ("m AS (SELECT *, cast(2024 - birth_year AS int) AS age, "
              "weight_kg / (height_m * height_m) AS bmi FROM medical)")
_RULES = [
    ("patient_id", "matches ^P\\d{3}$", "patient_id IS NOT NULL AND regexp_matches(patient_id, '^P[0-9]{3}$')"),
    ("age", "int in [18, 120]", "age IS NOT NULL AND age BETWEEN 18 AND 120"),
    ("bmi", "float in [15.0, 50.0]", "bmi IS NOT NULL AND bmi BETWEEN 15.0 AND 50.0"),
    ("disease_risk", "isin {0, 1}", "disease_risk IS NOT NULL AND disease_risk IN (0, 1)"),
]

ORACLE["V1_flag_medical_rows"] = _with(("medical",), _M_AGE_BMI + ",\nf AS (SELECT patient_id, list_filter([" + ", ".join(
    f"CASE WHEN NOT coalesce({p}, false) THEN '{c}: {n}' END" for c, n, p in _RULES) + "], lambda x: x IS NOT NULL) AS fl FROM m)",
    "SELECT patient_id, len(fl) = 0 AS is_valid, cast(len(fl) AS int) AS n_failures, "
    "array_to_string(fl, '; ') AS failures FROM f")

ORACLE["V2_rule_failure_report"] = _with(("medical",), _M_AGE_BMI, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{n}' AS \"check\", {_bi(f'count_if(NOT coalesce({p}, false))')} AS n_failed, "
    f"count(*) AS n_rows FROM m" for c, n, p in _RULES))

ORACLE["V4_duplicate_keys"] = ("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem "
                               "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")

_V5_COLS = ["fasting_glucose", "triglycerides", "smoking_status", "alcohol_consumption", "diet_quality",
            "hdl_cholesterol"]
ORACLE["V5_missing_value_shares"] = _with(("medical", "lifestyle"),
    "j AS (SELECT m.*, l.smoking_status, l.exercise_frequency, l.alcohol_consumption, l.diet_quality "
    "FROM medical m LEFT JOIN lifestyle l ON m.patient_id = l.patient_id),\n"
    "u AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_bi(f'count_if({c} IS NULL)')} AS n_missing, count(*) AS n_rows FROM j"
        for c in _V5_COLS) + ")",
    "SELECT \"column\", n_missing, n_rows, round(n_missing / n_rows, 6) AS missing_share, "
    "n_missing / n_rows > 0.05 AS flagged FROM u")

_V6 = [("blood_pressure", "int", "INTEGER"), ("patient_id", "int", "INTEGER"), ("zip_code", "string", "VARCHAR"),
       ("birth_year", "double", "DOUBLE")]
ORACLE["V6_type_check"] = _with(("medical",), "", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS expected, "
    f"{_bi(f'count_if(cast({c} AS VARCHAR) IS NOT NULL AND try_cast(cast({c} AS VARCHAR) AS {d}) IS NULL)')} AS n_bad, "
    f"count(*) AS n_rows FROM medical" for c, t, d in _V6))

_V7 = [("weight_kg", 50.0, 100.0), ("height_m", 1.5, 1.9), ("fasting_glucose", 70.0, 170.0)]
ORACLE["V7_range_check"] = _with(("medical",), "", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", cast({lo} AS double) AS lo, cast({hi} AS double) AS hi, "
    f"{_bi(f'count_if({c} IS NOT NULL AND NOT ({c} BETWEEN {lo} AND {hi}))')} AS n_out FROM medical"
    for c, lo, hi in _V7))

ORACLE["V8_feature_store_check"] = _with(("medical",), """
src AS (SELECT printf('P%03d', c_custkey) AS patient_id,
  cast(50 + (c_custkey * 13) % 60 + CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END AS double) AS weight_kg,
  cast(30 + (c_custkey * 5) % 50 AS double) AS hdl_cholesterol,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE cast(70 + (c_custkey * 17) % 110 AS double) END AS fasting_glucose
  FROM customer),
a AS (SELECT max(cast(m.exam_date AS timestamp)) AS last_ts,
  sum(cast(m.weight_kg IS NOT NULL AS int) + cast(m.hdl_cholesterol IS NOT NULL AS int)
      + cast(m.fasting_glucose IS NOT NULL AS int)) / (count(*) * 3) AS completeness,
  avg(CASE WHEN s.patient_id IS NOT NULL THEN cast((m.weight_kg IS NOT DISTINCT FROM s.weight_kg)
      AND (m.hdl_cholesterol IS NOT DISTINCT FROM s.hdl_cholesterol)
      AND (m.fasting_glucose IS NOT DISTINCT FROM s.fasting_glucose) AS double) END) AS consistency
  FROM medical m LEFT JOIN src s ON m.patient_id = s.patient_id)""",
    "SELECT strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, "
    "cast(floor(epoch(timestamp '2024-12-31 12:00:00')) - floor(epoch(last_ts)) AS bigint) AS staleness_seconds, "
    "floor(epoch(timestamp '2024-12-31 12:00:00')) - floor(epoch(last_ts)) <= 3600 AS fresh, "
    "round(completeness, 6) AS completeness, completeness >= 0.99 AS complete, "
    "round(consistency, 6) AS consistency, consistency >= 0.95 AS consistent FROM a")

_PIPE = "pl AS (SELECT event_id, cast(user_id % 4 AS int) AS pipeline, ts, event_type = 'error' AS is_error FROM events)"
ORACLE["V9_heartbeat_gaps"] = ("WITH " + _PIPE + ",\n"
    "g AS (SELECT pipeline, ts, lag(ts) OVER (PARTITION BY pipeline ORDER BY ts, event_id) AS prev_ts FROM pl)\n"
    "SELECT pipeline, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, "
    "cast(floor(epoch(ts)) - floor(epoch(prev_ts)) AS bigint) AS gap_seconds FROM g "
    "WHERE floor(epoch(ts)) - floor(epoch(prev_ts)) > 1800")

ORACLE["V9_error_rate_windows"] = ("WITH " + _PIPE + "\n"
    "SELECT pipeline, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, "
    + _bi("count_if(is_error)") + " AS n_error, round(count_if(is_error) / count(*), 6) AS error_rate, "
    "count_if(is_error) / count(*) > 0.3 AS alert FROM pl GROUP BY pipeline, date_trunc('day', ts)")

_CODEMAP = ("cm AS (SELECT printf('D%02d', p_partkey % 50) AS code, min(p_brand) AS standard_code FROM part "
            "WHERE p_partkey % 50 < 40 GROUP BY 1)")
ORACLE["V10_unmapped_codes"] = _with(("meds",), _CODEMAP,
    "SELECT DISTINCT drug AS code FROM meds WHERE drug NOT IN (SELECT code FROM cm)")
ORACLE["V10_mapped_code_counts"] = _with(("meds",), _CODEMAP,
    "SELECT cm.standard_code, count(*) AS n FROM meds LEFT JOIN cm ON meds.drug = cm.code GROUP BY 1")

# ---------------------------------------------------------------- P
ORACLE["P1_P2_age_bmi"] = _with(("medical",), _M_AGE_BMI, "SELECT patient_id, age, round(bmi, 6) AS bmi FROM m")
ORACLE["P3_metabolic_score"] = _with(("medical",), "",
    "SELECT patient_id, round(0.5 * fasting_glucose + 0.3 * hdl_cholesterol - 0.2 * triglycerides, 6) "
    "AS metabolic_score FROM medical")
_LIFE_RISK = ("(CASE smoking_status WHEN 'never' THEN 0 WHEN 'former' THEN 1 WHEN 'current' THEN 3 END) "
              "+ greatest(0, 4 - exercise_frequency) "
              "+ (CASE WHEN alcohol_consumption IS NULL THEN NULL ELSE least(alcohol_consumption, 10) END)")
ORACLE["P4_lifestyle_risk"] = _with(("lifestyle",), "",
    f"SELECT patient_id, round({_LIFE_RISK}, 6) AS lifestyle_risk FROM lifestyle")
_WITHIN = ("m.longitude > z.min_x AND m.longitude < z.max_x AND m.latitude > z.min_y AND m.latitude < z.max_y")
ORACLE["P5_pollution_index_spatial"] = _with(("medical", "zones"), "",
    "SELECT m.patient_id, z.zip_code AS zone, round(0.7 * z.pm2_5 + 0.3 * z.no2_level, 6) AS pollution_index, "
    "round((0.7 * z.pm2_5 + 0.3 * z.no2_level) * m.years_in_location, 6) AS cumulative_exposure "
    f"FROM medical m LEFT JOIN zones z ON {_WITHIN}")
ORACLE["P6_J3_pollution_exposure"] = _with(("medical", "zones"), "",
    "SELECT m.patient_id, round(ln(1 + z.pm2_5), 6) AS pollution_exposure FROM medical m JOIN zones z "
    "ON m.zip_code = z.zip_code")
ORACLE["P7_activity_score"] = _with(("lifestyle",),
    "f AS (SELECT exercise_frequency, count(*) / sum(count(*)) OVER () AS s FROM lifestyle "
    "WHERE exercise_frequency IS NOT NULL GROUP BY 1)",
    "SELECT l.patient_id, round(f.s, 6) AS activity_score FROM lifestyle l LEFT JOIN f "
    "ON l.exercise_frequency = f.exercise_frequency")
ORACLE["P9_risk_category_counts"] = _with(("predictions",), "",
    "SELECT model, CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END AS risk_category, "
    "count(*) AS n FROM predictions GROUP BY 1, 2")
ORACLE["P10_kbins_quantile"] = ("WITH e AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS q "
    "FROM lineitem)\nSELECT cast(l_extendedprice >= q[1] AS int) + cast(l_extendedprice >= q[2] AS int) "
    "+ cast(l_extendedprice >= q[3] AS int) + cast(l_extendedprice >= q[4] AS int) AS bin, count(*) AS n "
    "FROM lineitem, e GROUP BY 1")
ORACLE["P11_digitize_age"] = _with(("medical",), _M_AGE_BMI,
    "SELECT cast(age >= 30 AS int) + cast(age >= 45 AS int) + cast(age >= 60 AS int) + cast(age >= 75 AS int) "
    "AS age_bin, count(*) AS n FROM m GROUP BY 1")
ORACLE["P12_generalize_bmi"] = _with(("medical",), _M_AGE_BMI,
    "SELECT CASE WHEN bmi BETWEEN 0.0 AND 18.5 THEN 'under' WHEN bmi BETWEEN 18.5 AND 25.0 THEN 'normal' "
    "WHEN bmi BETWEEN 25.0 AND 30.0 THEN 'over' WHEN bmi BETWEEN 30.0 AND 45.0 THEN 'obese' ELSE 'other' END "
    "AS bmi_group, count(*) AS n FROM m GROUP BY 1")
ORACLE["P13_blood_pressure_parse"] = _with(("medical",), "",
    "SELECT patient_id, try_cast(split_part(blood_pressure, '/', 1) AS INTEGER) AS systolic, "
    "try_cast(split_part(blood_pressure, '/', 2) AS INTEGER) AS diastolic FROM medical")

# ---------------------------------------------------------------- J
ORACLE["J1_medical_lifestyle_join"] = _with(("medical", "lifestyle"), "",
    "SELECT m.patient_id, m.sex, m.zip_code, l.smoking_status, l.exercise_frequency, l.alcohol_consumption, "
    "l.diet_quality FROM medical m JOIN lifestyle l ON m.patient_id = l.patient_id")
ORACLE["J2_zip_zone_join"] = _with(("medical", "zones"), "",
    "SELECT m.zip_code, m.patient_id, z.pm2_5, z.no2_level FROM medical m JOIN zones z ON m.zip_code = z.zip_code")
ORACLE["J4_one_to_one_join_counts"] = _with(("medical", "lifestyle"), "",
    "SELECT l.diet_quality, m.sex, count(*) AS n, round(avg(m.weight_kg), 6) AS avg_weight FROM medical m "
    "JOIN lifestyle l ON m.patient_id = l.patient_id GROUP BY 1, 2")
ORACLE["J5_spatial_within_join"] = _with(("medical", "zones"), "",
    f"SELECT m.patient_id, z.zip_code AS zone FROM medical m LEFT JOIN zones z ON {_WITHIN}")
ORACLE["J7_fuse_modalities"] = _with(("medical", "lifestyle", "genotypes"), """
c AS (SELECT patient_id, weight_kg FROM medical WHERE disease_risk = 1),
l AS (SELECT patient_id, diet_quality FROM lifestyle WHERE exercise_frequency >= 4),
g AS (SELECT patient_id, count(*) AS n_called FROM genotypes WHERE genotype IS NOT NULL AND genotype <> 'NN'
      GROUP BY 1),
ids AS (SELECT patient_id FROM c UNION SELECT patient_id FROM l UNION SELECT patient_id FROM g)""",
    "SELECT ids.patient_id, c.weight_kg, l.diet_quality, g.n_called, c.patient_id IS NOT NULL AS has_clinical, "
    "l.patient_id IS NOT NULL AS has_lifestyle, g.patient_id IS NOT NULL AS has_genomic FROM ids "
    "LEFT JOIN c ON ids.patient_id = c.patient_id LEFT JOIN l ON ids.patient_id = l.patient_id "
    "LEFT JOIN g ON ids.patient_id = g.patient_id")
ORACLE["J8_risk_profile"] = _with(("medical", "lifestyle", "zones"), "",
    "SELECT m.patient_id, round(0.5 * m.fasting_glucose + 0.3 * m.hdl_cholesterol - 0.2 * m.triglycerides, 6) "
    f"AS metabolic_score, round(z.pm2_5, 6) AS pm2_5, round({_LIFE_RISK.replace('smoking_status', 'l.smoking_status').replace('exercise_frequency', 'l.exercise_frequency').replace('alcohol_consumption', 'l.alcohol_consumption')}, 6) AS lifestyle_risk "
    "FROM medical m LEFT JOIN zones z ON m.zip_code = z.zip_code LEFT JOIN lifestyle l ON m.patient_id = l.patient_id")

# ---------------------------------------------------------------- I
ORACLE["I1_I2_impute_median_mode"] = _with(("medical", "lifestyle"), """
j AS (SELECT m.patient_id, m.fasting_glucose, m.triglycerides, l.smoking_status, l.alcohol_consumption
      FROM medical m JOIN lifestyle l ON m.patient_id = l.patient_id),
f AS (SELECT median(fasting_glucose) AS g, median(triglycerides) AS t, median(alcohol_consumption) AS a,
      (SELECT smoking_status FROM j WHERE smoking_status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
      AS s FROM j)""",
    "SELECT patient_id, coalesce(fasting_glucose, g) AS fasting_glucose, coalesce(triglycerides, t) AS triglycerides, "
    "coalesce(smoking_status, s) AS smoking_status, coalesce(alcohol_consumption, a) AS alcohol_consumption FROM j, f")
ORACLE["I3_one_hot_encode"] = _with(("lifestyle",), "",
    "SELECT patient_id, " + ", ".join(
        f"coalesce(cast({c} = '{v}' AS int), 0) AS {c}_{v}"
        for c, vs in [("smoking_status", ["current", "former", "never"]), ("diet_quality", ["fair", "good", "poor"])]
        for v in vs) + " FROM lifestyle")
ORACLE["I4_standard_scale"] = _with(("medical",),
    "s AS (SELECT avg(weight_kg) AS mw, stddev_pop(weight_kg) AS sw, avg(height_m) AS mh, stddev_pop(height_m) AS sh, "
    "avg(hdl_cholesterol) AS mc, stddev_pop(hdl_cholesterol) AS sc FROM medical)",
    "SELECT patient_id, round((weight_kg - mw) / sw, 6) AS weight_kg, round((height_m - mh) / sh, 6) AS height_m, "
    "round((hdl_cholesterol - mc) / sc, 6) AS hdl_cholesterol FROM medical, s")
ORACLE["I7_train_test_split_sizes"] = ("WITH c AS (SELECT count(*) AS n FROM customer)\n"
    "SELECT true AS is_test, cast(ceil(n * 0.2) AS bigint) AS n FROM c UNION ALL "
    "SELECT false AS is_test, cast(n - ceil(n * 0.2) AS bigint) AS n FROM c")
ORACLE["I8_stratified_fold_sizes"] = _with(("medical",),
    "c AS (SELECT disease_risk, count(*) AS n FROM medical GROUP BY 1)",
    "SELECT disease_risk, cast(f.range AS int) AS fold, cast(n // 5 + CASE WHEN f.range < n % 5 THEN 1 ELSE 0 END "
    "AS bigint) AS n FROM c, range(5) AS f")

# ---------------------------------------------------------------- N
_N1 = ["weight_kg", "height_m", "fasting_glucose", "hdl_cholesterol", "triglycerides"]
ORACLE["N1_describe_medical"] = _with(("medical",), "", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM medical" for c in _N1))
ORACLE["N2_value_counts"] = _with(("medical",), "c AS (SELECT disease_risk, count(*) AS n FROM medical GROUP BY 1)",
    "SELECT disease_risk, n, printf('%.1f%%', round(n * 100.0 / sum(n) OVER (), 1)) AS share FROM c")

# ---------------------------------------------------------------- A (columns)
ORACLE["A1_pseudonymize_ids"] = _with(("medical",), "", "SELECT patient_id, sha256(patient_id) AS pid_hash FROM medical")
ORACLE["A2_generalize_columns"] = _with(("medical",), _M_AGE_BMI,
    "SELECT patient_id, cast(age >= 30 AS int) + cast(age >= 50 AS int) + cast(age >= 70 AS int) AS age_band, "
    "CASE WHEN weight_kg BETWEEN 0.0 AND 69.0 THEN 'light' WHEN weight_kg BETWEEN 70.0 AND 89.0 THEN 'medium' "
    "WHEN weight_kg BETWEEN 90.0 AND 200.0 THEN 'heavy' ELSE 'other' END AS weight_band FROM m")
ORACLE["A4_mask_document_text"] = ("WITH d AS (SELECT doc_id, CASE WHEN length(text) <= 4 THEN text "
    "ELSE repeat('*', length(text) - 4) || right(text, 4) END AS masked FROM documents)\n"
    "SELECT doc_id, cast(length(masked) AS int) AS n_chars, right(masked, 4) AS tail, sha256(masked) AS masked_sha FROM d")
ORACLE["A5_deidentify"] = "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLE["A8_encrypt_roundtrip"] = ("SELECT c_custkey, cast(octet_length(encode(c_name)) + 28 AS int) AS enc_bytes, "
                                  "true AS roundtrip_ok FROM customer")


def _hmac_sql(col: str, key: str) -> str:
    kb = key.encode().ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in kb).hex()
    opad = bytes(b ^ 0x5C for b in kb).hex()
    return f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({col}))))"


ORACLE["A9_hmac_signature"] = f"SELECT c_custkey, {_hmac_sql('c_name', 'secret-key')} AS signature FROM customer"
ORACLE["A10_dlp_keyword_hits"] = ("WITH k AS (SELECT unnest(['token', 'license', 'mail', 'password', 'ssn']) "
    "AS keyword)\nSELECT keyword, count(*) AS n FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY 1")
ORACLE["A11_sanitize_input"] = ("WITH s AS (SELECT page_id, regexp_replace(html, '[;\\\\''\"<>]', '', 'g') AS clean "
    "FROM pages)\nSELECT page_id, cast(length(clean) AS int) AS n_chars, sha256(clean) AS clean_sha FROM s")
ORACLE["A22_suspicious_code_scan"] = ("SELECT doc_id FROM documents WHERE contains(text, 'eval(') OR "
                                      "contains(text, 'exec(') OR contains(text, 'os.system(') OR "
                                      "contains(text, 'token = \"')")

# ---------------------------------------------------------------- R
from checks.rule_oracle import SETS, bands_sql, evaluability_sql, hits_sql  # noqa: E402
from medlake.sources.reference_data import PRS_PANELS, SNP_TABLE  # noqa: E402


ORACLE["R0_rule_hits"] = _with(("clinical",), "", hits_sql())
ORACLE["R0_rule_evaluability"] = _with(("clinical",), "", evaluability_sql())
ORACLE["R25_rule_summary"] = _with(("clinical",), "h AS (" + hits_sql() + ")",
    "SELECT disease, code, count(*) AS n_flagged, round(count(*) / (SELECT count(*) FROM clinical), 6) AS rate "
    "FROM h GROUP BY 1, 2")
ORACLE["R24_bp_ckd_staging"] = _with(("clinical",), """
s AS (SELECT patient_id,
  CASE WHEN systolic >= 140 OR diastolic >= 90 THEN 'Hypertension' WHEN systolic >= 130 OR diastolic >= 80
       THEN 'Elevated' ELSE 'Normal' END AS bp_class,
  CASE WHEN egfr >= 90 THEN 'G1' WHEN egfr >= 60 THEN 'G2' WHEN egfr >= 45 THEN 'G3a' WHEN egfr >= 30 THEN 'G3b'
       WHEN egfr >= 15 THEN 'G4' ELSE 'G5' END AS gfr_stage,
  CASE WHEN acr < 30 THEN 'A1' WHEN acr < 300 THEN 'A2' ELSE 'A3' END AS acr_stage FROM clinical)""",
    "SELECT *, cast(CASE WHEN gfr_stage = 'G1' AND acr_stage = 'A1' THEN 0.1 WHEN gfr_stage = 'G1' AND acr_stage = 'A2' "
    "THEN 0.2 WHEN gfr_stage = 'G1' AND acr_stage = 'A3' THEN 0.3 ELSE 0.5 END AS double) AS ckd_risk FROM s")
ORACLE["R26_profile_threshold_counts"] = _with(("clinical",), "h AS (" + bands_sql() + ")",
    "SELECT profile, marker, count(*) AS n FROM h GROUP BY 1, 2")

# ---------------------------------------------------------------- K
_K = {
    "K1_ascvd": "coalesce(1 - pow(0.9533, exp(ascvd_base - 2.4692)), 0.5)",
    "K2_framingham_heart": "coalesce(100.0 / (1 + exp(-(0.1125 * age - 0.2569 * hdl))), 0.5)",
    "K3_chads_vasc": "cast(chf AS int) + cast(hypertension AS int) + cast(age >= 75 AS int) * 2 + cast(diabetes AS int)"
                     " + cast(stroke_history AS int) * 2 + cast(vascular_disease AS int)"
                     " + cast(age >= 65 AND age < 75 AS int) + cast(sex = 'F' AS int)",
    "K4_qdiabetes": "coalesce(100 * (1 - pow(0.987, exp(qdiabetes_terms))), 0.5)",
    "K6_gail": "coalesce(100 * (1 - exp(-0.0001056 * pow(age, 4.334) * gail_factor)), 0.5)",
    "K7_pcpt": "0.249 * (CASE WHEN psa > 0 THEN ln(psa) END) + 0.094 * age - 0.068 * prostate_volume",
    "K8_bode": "cast(fev1_points + dyspnea_points + walk_points + cast(bmi < 21 AS int) AS double)",
    "K9_asthma_exacerbation": "2.7 * fev1_variability + 1.3 * saba_uses",
    "K10_ckd_progression": "0.1 * egfr + 0.3 * acr + 0.2 * cast(diabetes AS int)",
    "K11_aki": "(CASE WHEN egfr_drop_pct > 25 THEN 2.0 ELSE 0.0 END) + (CASE WHEN sepsis THEN 1.5 ELSE 0.0 END)"
               " + (CASE WHEN nephrotoxins THEN 1.0 ELSE 0.0 END)",
    "K12_framingham_stroke": "0.0634 * age + 0.0056 * systolic - 0.0423 * hdl",
    "K13_caide": "cast(cast(age >= 45 AS int) + cast(education_years < 10 AS int) + cast(hypertension AS int)"
                 " + cast(bmi >= 30 AS int) + cast(physically_inactive AS int) AS double)",
    "K14_metabolic_syndrome": "cast(cast(waist_cm > CASE WHEN sex = 'M' THEN 102 ELSE 88 END AS int)"
                              " + cast(triglycerides >= 150 AS int) + cast(hdl < CASE WHEN sex = 'M' THEN 40 ELSE 50 END AS int)"
                              " + cast(systolic >= 130 OR diastolic >= 85 AS int) + cast(fpg >= 100 AS int) AS double)",
    "K15_composite": "least(greatest((0.4 * metabolic_points + 0.3 * inflammatory_score + 0.3 * family_history_score)"
                     " / 10.0, 0.0), 1.0)",
}
for _k, _e in _K.items():
    _t = "int" if _k == "K3_chads_vasc" else "double"
    ORACLE[_k] = _with(("clinical",), "", f"SELECT patient_id, round(cast({_e} AS {_t}), 6) AS score FROM clinical")
_ADA_PTS = ("cast(age >= 45 AS int) + cast(bmi >= 25 AS int) + cast(family_history_score >= 3 AS int) "
            "+ cast(hypertension AS int) + cast(physically_inactive AS int)")
ORACLE["K5_ada_risk"] = _with(("clinical",), f"a AS (SELECT patient_id, {_ADA_PTS} AS points FROM clinical)",
    "SELECT patient_id, points, round(cast(CASE points WHEN 0 THEN 3.0 WHEN 1 THEN 6.0 WHEN 2 THEN 12.0 WHEN 3 THEN 20.0 "
    "WHEN 4 THEN 25.0 WHEN 5 THEN 33.0 ELSE 50.0 END AS double), 6) AS score FROM a")

# ---------------------------------------------------------------- L
_SNP_VALUES = ", ".join(f"('{r}', '{g}', {k}, '{a}', '{c}', {f})" for r, g, k, a, c, f in SNP_TABLE)
_SNP = (f"snp AS (SELECT rsid, gene, cast(risk AS double) AS risk, allele, condition, "
        f"cast(population_freq AS double) AS population_freq FROM (VALUES {_SNP_VALUES}) "
        "AS t(rsid, gene, risk, allele, condition, population_freq))")
_PANEL = "panels AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in PRS_PANELS) + \
         ") AS t(condition, rsid))"
_CNT = ("(length(coalesce(genotype, 'NN')) - length(replace(coalesce(genotype, 'NN'), allele, '')))")
_FACTOR = f"coalesce(CASE WHEN {_CNT} = 2 THEN risk * risk WHEN {_CNT} = 1 THEN risk ELSE 1.0 END, 1.0)"
ORACLE["L1_snp_factors"] = _with(("genotypes",), _SNP,
    f"SELECT g.patient_id, g.rsid, round({_FACTOR}, 6) AS factor FROM genotypes g JOIN snp s ON g.rsid = s.rsid")


def _prs_sql(cond_filter: str) -> str:
    return (f"{_SNP},\n{_PANEL},\n"
            f"ref AS (SELECT p.condition, p.rsid, s.risk, s.allele FROM panels p LEFT JOIN snp s ON p.rsid = s.rsid "
            f"WHERE {cond_filter}),\n"
            f"fa AS (SELECT g.patient_id, r.condition, {_FACTOR} AS f FROM genotypes g JOIN ref r ON g.rsid = r.rsid),\n"
            "pr AS (SELECT patient_id, condition, product(f) - 1 AS prs FROM fa GROUP BY patient_id, condition),\n"
            "base AS (SELECT m.patient_id, c.condition FROM medical m, (SELECT DISTINCT condition FROM ref) c),\n"
            "allp AS (SELECT base.patient_id, base.condition, coalesce(pr.prs, 0.0) AS prs FROM base LEFT JOIN pr "
            "ON base.patient_id = pr.patient_id AND base.condition = pr.condition)")


ORACLE["L2_prs_diabetes"] = _with(("genotypes", "medical"), _prs_sql("p.condition = 'diabetes'"),
                                  "SELECT patient_id, condition, round(prs, 6) AS prs FROM allp")
ORACLE["L3_prs_all_conditions"] = _with(("genotypes", "medical"), _prs_sql("true"),
                                        "SELECT patient_id, condition, round(prs, 6) AS prs FROM allp")
ORACLE["L5_prs_percentile"] = _with(("genotypes", "medical"), _prs_sql("true"),
    "SELECT patient_id, condition, round(prs, 6) AS prs, "
    "round(percent_rank() OVER (PARTITION BY condition ORDER BY round(prs, 9)) * 100, 6) AS percentile FROM allp")
ORACLE["L6_allele_frequency"] = _with(("genotypes",), _SNP,
    f"SELECT g.rsid, s.population_freq, round(sum({_CNT}) / (2.0 * count(*)), 6) AS observed_freq, "
    "count(*) AS n_called FROM genotypes g JOIN snp s ON g.rsid = s.rsid WHERE g.genotype IS NOT NULL "
    "GROUP BY g.rsid, s.population_freq")

# ---------------------------------------------------------------- E
def _d0(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE ({num}) / ({den}) END)"


_CM = ("cm AS (SELECT model, " + _bi("count_if(p >= 0.5 AND y = 1)") + " AS tp, " + _bi("count_if(p >= 0.5 AND y <> 1)")
       + " AS fp, " + _bi("count_if(p < 0.5 AND y = 1)") + " AS fn, " + _bi("count_if(p < 0.5 AND y <> 1)")
       + " AS tn FROM predictions GROUP BY model)")
_CLS = ("cls AS (SELECT model, tp, fp, fn, tn, " + _d0("tp + tn", "tp + fp + fn + tn") + " AS accuracy, "
        + _d0("tp", "tp + fp") + " AS precision, " + _d0("tp", "tp + fn") + " AS recall, "
        + _d0("2 * tp", "2 * tp + fp + fn") + " AS f1 FROM cm)")
ORACLE["E1_classification_metrics"] = _with(("predictions",), _CM + ",\n" + _CLS,
    "SELECT model, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, "
    "round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cls")
_SC = ("sc AS (SELECT model, p, " + _bi("count_if(y = 1)") + " AS pos, " + _bi("count_if(y <> 1)")
       + " AS neg FROM predictions GROUP BY model, p)")
_AUC = ("auc_r AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p ROWS UNBOUNDED PRECEDING) AS cum_neg, "
        "sum(pos) OVER (PARTITION BY model) AS tp_all, sum(neg) OVER (PARTITION BY model) AS tn_all FROM sc),\n"
        "auc AS (SELECT model, sum(pos * ((cum_neg - neg) + neg / 2.0)) / (max(tp_all) * max(tn_all)) AS auc, "
        "cast(max(tp_all) AS bigint) AS n_pos, cast(max(tn_all) AS bigint) AS n_neg FROM auc_r GROUP BY model)")
ORACLE["E2_roc_auc"] = _with(("predictions",), _SC + ",\n" + _AUC,
                             "SELECT model, round(auc, 6) AS auc, n_pos, n_neg FROM auc")
_PR = ("pr AS (SELECT model, p AS threshold, pos, neg, "
       "sum(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, "
       "sum(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp, "
       "sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg FROM sc)")
ORACLE["E3_precision_recall_curve"] = _with(("predictions",), _SC + ",\n" + _PR + ",\n"
    "tf AS (SELECT model, max(CASE WHEN tp = n_pos THEN threshold END) AS t_full FROM pr GROUP BY model)",
    f"SELECT pr.model, threshold, round({_d0('tp', 'tp + fp')}, 6) AS precision, round({_d0('tp', 'n_pos')}, 6) AS recall "
    "FROM pr JOIN tf ON pr.model = tf.model WHERE threshold >= t_full UNION ALL "
    "SELECT model, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM tf")
ORACLE["E4_confusion_matrix"] = _with(("predictions",), _CM,
    "SELECT model, 1 AS actual, 1 AS predicted, tp AS n FROM cm UNION ALL SELECT model, 0, 1, fp FROM cm "
    "UNION ALL SELECT model, 1, 0, fn FROM cm UNION ALL SELECT model, 0, 0, tn FROM cm")
_AP = f"ap AS (SELECT model, sum(pos * {_d0('tp', 'tp + fp')}) / max(n_pos) AS ap FROM pr GROUP BY model)"
ORACLE["E5_average_precision"] = _with(("predictions",), _SC + ",\n" + _PR + ",\n" + _AP,
                                       "SELECT model, round(ap, 6) AS ap FROM ap")
_BR = "br AS (SELECT model, avg(pow(p - y, 2)) AS brier FROM predictions GROUP BY model)"
ORACLE["E6_brier_score"] = _with(("predictions",), _BR, "SELECT model, round(brier, 6) AS brier FROM br")
ORACLE["E7_threshold_sweep"] = _with(("predictions",),
    "sw AS (SELECT model, t.range / 10.0 AS threshold, count_if(p >= t.range / 10.0 AND y = 1) AS tp, "
    "count_if(p >= t.range / 10.0 AND y <> 1) AS fp, count_if(p < t.range / 10.0 AND y = 1) AS fn "
    "FROM predictions, range(0, 11) t GROUP BY model, t.range)",
    f"SELECT model, round(threshold, 6) AS threshold, round({_d0('tp', 'tp + fp')}, 6) AS precision, "
    f"round({_d0('tp', 'tp + fn')}, 6) AS recall, round({_d0('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM sw")
_YJ = ("yj AS (SELECT model, threshold, " + _d0("tp", "n_pos") + " - " + _d0("fp", "n_neg") + " AS youden_j, "
       "row_number() OVER (PARTITION BY model ORDER BY tp * n_neg - fp * n_pos DESC, threshold DESC) AS rn FROM pr)")
ORACLE["E8_youden_threshold"] = _with(("predictions",), _SC + ",\n" + _PR + ",\n" + _YJ,
    "SELECT model, threshold, round(youden_j, 6) AS youden_j FROM yj WHERE rn = 1")
_ECE = ("eb AS (SELECT model, least(floor(p * 10), 9) AS b, count(*) AS n, avg(y) AS ay, avg(p) AS ap_ FROM predictions "
        "GROUP BY 1, 2),\nece AS (SELECT model, sum(n / tot * abs(ay - ap_)) AS ece FROM "
        "(SELECT *, sum(n) OVER (PARTITION BY model) AS tot FROM eb) GROUP BY model)")
ORACLE["E9_calibration_error"] = _with(("predictions",), _ECE, "SELECT model, round(ece, 6) AS ece FROM ece")
_REPORT = ",\n".join([_CM, _CLS, _SC, _AUC, _PR, _AP, _BR, _ECE, _YJ]) + (
    ",\nrep AS (SELECT auc.model, auc.auc, ap.ap, br.brier, ece.ece, yj.threshold AS best_threshold, cls.accuracy, "
    "cls.precision, cls.recall, cls.f1 FROM auc JOIN ap ON auc.model = ap.model JOIN br ON auc.model = br.model "
    "JOIN ece ON auc.model = ece.model JOIN yj ON auc.model = yj.model AND yj.rn = 1 "
    "JOIN cls ON auc.model = cls.model)")
ORACLE["E10_evaluation_report"] = _with(("predictions",), _REPORT, "SELECT model, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("auc", "ap", "brier", "ece", "best_threshold", "accuracy", "precision",
                                       "recall", "f1")) + " FROM rep")
ORACLE["E11_leaderboard"] = _with(("predictions",), _REPORT,
    "SELECT model, round(f1, 6) AS f1, round(auc, 6) AS auc, cast(rank() OVER (ORDER BY round(f1, 6) DESC) AS int) "
    "AS rank FROM rep")
ORACLE["E12_metrics_text"] = _with(("predictions",), _CM + ",\n" + _CLS,
    "SELECT model, " + ", ".join(f"printf('%.3f', {c}) AS {c}" for c in ("accuracy", "precision", "recall", "f1"))
    + " FROM cls")

# ---------------------------------------------------------------- Q drift
_NUMF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CATF = ["l_returnflag", "l_linestatus"]
_RC = "rc AS (SELECT *, l_shipdate < date '1998-01-01' AS is_ref FROM lineitem WHERE l_shipdate IS NOT NULL)"


def _long_sql(cols, cast):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, cast({c} AS {cast}) AS value, is_ref FROM rc "
                              f"WHERE {c} IS NOT NULL" for c in cols)


_KS = (_RC + ",\nlg AS (" + _long_sql(_NUMF, "double") + "),\n"
       "kc AS (SELECT feature, value, count_if(is_ref) AS n_ref, count_if(NOT is_ref) AS n_cur FROM lg GROUP BY 1, 2),\n"
       "kr AS (SELECT *, sum(n_ref) OVER w AS c_ref, sum(n_cur) OVER w AS c_cur, "
       "sum(n_ref) OVER (PARTITION BY feature) AS t_ref, sum(n_cur) OVER (PARTITION BY feature) AS t_cur FROM kc "
       "WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),\n"
       "ks AS (SELECT feature, max(abs(c_ref / t_ref - c_cur / t_cur)) AS d, max(t_ref) AS n1, max(t_cur) AS n2 "
       "FROM kr GROUP BY feature),\n"
       "kl AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS lam FROM ks),\n"
       "kp AS (SELECT *, CASE WHEN lam < 1e-3 THEN 1.0 ELSE least(greatest((SELECT sum(2.0 * pow(-1, k - 1) "
       "* exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k)), 0.0), 1.0) END AS p_value FROM kl)")
ORACLE["Q1_ks_drift"] = "WITH " + _KS + "\nSELECT feature, round(d, 6) AS statistic, round(p_value, 6) AS p_value, " \
    "p_value < 0.05 / 4 AS drift, cast(n1 AS bigint) AS n_ref, cast(n2 AS bigint) AS n_cur FROM kp"
ORACLE["Q1_chi2_statistics"] = ("WITH " + _RC + ",\nlg AS (" + _long_sql(_CATF, "varchar") + "),\n"
    "cc AS (SELECT feature, value, count_if(is_ref) AS o_ref, count_if(NOT is_ref) AS o_cur FROM lg GROUP BY 1, 2),\n"
    "ct AS (SELECT *, sum(o_ref) OVER (PARTITION BY feature) AS n_ref, sum(o_cur) OVER (PARTITION BY feature) AS n_cur "
    "FROM cc),\nce AS (SELECT *, (o_ref + o_cur) * n_ref / (n_ref + n_cur) AS e_ref, "
    "(o_ref + o_cur) * n_cur / (n_ref + n_cur) AS e_cur FROM ct)\n"
    "SELECT feature, round(sum(pow(o_ref - e_ref, 2) / e_ref + pow(o_cur - e_cur, 2) / e_cur), 6) AS statistic, "
    "cast(count(*) - 1 AS bigint) AS dof FROM ce GROUP BY feature")
_Q3C = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]
ORACLE["Q3_dataset_summary"] = (
    f"SELECT count(*) AS n_rows, {len(_Q3C)} AS n_columns, cast(sum(" + " + ".join(f"cast({c} IS NULL AS bigint)" for c in _Q3C)
    + ") AS bigint) AS n_missing_cells, cast(count(*) - (SELECT count(*) FROM (SELECT DISTINCT " + ", ".join(_Q3C)
    + " FROM lineitem)) AS bigint) AS n_duplicated_rows, "
    + " + ".join(f"cast(coalesce(min({c}) = max({c}), true) AS int)" for c in _Q3C)
    + " AS n_constant_columns FROM lineitem")
_TR = ("tr AS (SELECT model, avg(p) AS mean_score, max(p) AS max_score, regr_slope(p, idx) AS slope FROM "
       "(SELECT model, p, cast(row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS double) AS idx "
       "FROM predictions) GROUP BY model)")
ORACLE["Q4_drift_trend"] = _with(("predictions",), _TR,
    "SELECT model, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, "
    "round(slope * 1e6, 6) AS slope_e6, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM tr")
ORACLE["Q5_performance_report"] = _with(("predictions",), ",\n".join([_SC, _AUC, _BR, _ECE, _TR]) +
    ",\nspan AS (SELECT model, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, "
    "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM predictions GROUP BY model)",
    "SELECT span.model, first_ts, last_ts, round(auc, 6) AS auc, round(brier, 6) AS brier, round(ece, 6) AS ece, "
    "CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM span JOIN auc USING (model) "
    "JOIN br USING (model) JOIN ece USING (model) JOIN tr USING (model)")
ORACLE["Q6_psi"] = ("WITH " + _RC + ",\n"
    "e AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM rc "
    "WHERE is_ref),\nb AS (SELECT is_ref, " + " + ".join(f"cast(l_extendedprice >= q[{i}] AS int)" for i in range(1, 10))
    + " AS bin FROM rc, e WHERE l_extendedprice IS NOT NULL),\n"
    "c AS (SELECT bin, count_if(is_ref) AS n_ref, count_if(NOT is_ref) AS n_cur FROM b GROUP BY bin),\n"
    "pq AS (SELECT greatest(n_ref / sum(n_ref) OVER (), 1e-4) AS p, greatest(n_cur / sum(n_cur) OVER (), 1e-4) AS q "
    "FROM c)\nSELECT round(sum((q - p) * ln(q / p)), 6) AS psi, 'l_extendedprice' AS feature FROM pq")

# ---------------------------------------------------------------- Q monitors
ORACLE["Q9_rolling_accuracy_alerts"] = _with(("predictions",),
    "ok AS (SELECT model, event_id, ts, cast((p >= 0.5) = (y = 1) AS int) AS ok FROM predictions),\n"
    "rl AS (SELECT model, event_id, row_number() OVER w AS row_index, "
    "sum(ok) OVER (PARTITION BY model ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS s, "
    "avg(ok) OVER (PARTITION BY model) AS base FROM ok WINDOW w AS (PARTITION BY model ORDER BY ts, event_id))",
    "SELECT model, event_id, cast(row_index AS bigint) AS row_index, "
    "round(s / least(row_index, 1000), 6) AS rolling_accuracy, s / least(row_index, 1000) <= base - 0.15 AS alert FROM rl")
ORACLE["Q9_rolling_precision_recall"] = _with(("predictions",),
    "b AS (SELECT model, event_id, ts, cast(p >= 0.5 AS int) AS yes, y AS tru, cast(p >= 0.5 AND y = 1 AS int) AS hit FROM predictions),\n"
    "rl AS (SELECT model, event_id, row_number() OVER w AS row_index, sum(hit) OVER l AS h, sum(yes) OVER l AS ye, sum(tru) OVER l AS tr, "
    "sum(hit) OVER a / nullif(sum(yes) OVER a, 0) AS bp, sum(hit) OVER a / nullif(sum(tru) OVER a, 0) AS br FROM b "
    "WINDOW w AS (PARTITION BY model ORDER BY ts, event_id), a AS (PARTITION BY model), "
    "l AS (PARTITION BY model ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))",
    "SELECT model, event_id, cast(row_index AS bigint) AS row_index, round(h / nullif(ye, 0), 6) AS rolling_precision, "
    "coalesce(h / nullif(ye, 0) <= bp - 0.15, false) AS precision_alert, round(h / nullif(tr, 0), 6) AS rolling_recall, "
    "coalesce(h / nullif(tr, 0) <= br - 0.15, false) AS recall_alert FROM rl")
ORACLE["Q10_latency_percentiles"] = (
    "SELECT event_type, strftime(cast(ts AS date), '%Y-%m-%d') AS day, round(quantile_cont(value, 0.95), 6) AS p95, "
    "round(quantile_cont(value, 0.99), 6) AS p99, quantile_cont(value, 0.95) > 300 OR quantile_cont(value, 0.99) > 400 "
    "AS breach FROM events GROUP BY event_type, cast(ts AS date)")
ORACLE["Q11_prediction_distribution"] = _with(("predictions",),
    "mu AS (SELECT model, avg(p) AS m FROM predictions GROUP BY model),\n"
    "mo AS (SELECT pr.model, avg(pow(p - m, 2)) AS m2, avg(pow(p - m, 3)) AS m3, avg(pow(p - m, 4)) AS m4 "
    "FROM predictions pr JOIN mu ON pr.model = mu.model GROUP BY pr.model),\n"
    "sk AS (SELECT model, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS excess_kurtosis FROM mo)",
    "SELECT model, round(skewness, 6) AS skewness, round(excess_kurtosis, 6) AS excess_kurtosis, "
    "abs(skewness) <= 0.1 AND abs(excess_kurtosis) <= 0.1 AS normal FROM sk")
ORACLE["Q12_resource_levels"] = (
    "SELECT event_type, CASE WHEN value / 400.0 >= 0.95 THEN 'critical' WHEN value / 400.0 >= 0.90 THEN 'alert' "
    "WHEN value / 400.0 >= 0.85 THEN 'warning' ELSE 'ok' END AS level, count(*) AS n FROM events GROUP BY 1, 2")
ORACLE["Q13_api_performance"] = (
    "WITH a AS (SELECT event_type, date_trunc('hour', ts) AS ws, count(*) AS requests, "
    "avg(cast(value < 300 AS double)) AS availability, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1, 2)\n"
    "SELECT event_type, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, requests, "
    "round(requests / 3600.0, 6) AS throughput, round(availability, 6) AS availability, "
    "round(1 - availability, 6) AS error_rate, round(p95, 6) AS p95_latency, "
    "p95 > 300.0 OR availability < 0.999 AS sla_breach FROM a")
ORACLE["Q14_log_keyword_counts"] = (
    "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),\n"
    "k AS (SELECT unnest(['token', 'license', 'mail', 'error']) AS keyword)\n"
    "SELECT keyword, count(*) AS n_lines FROM l JOIN k ON contains(lower(line), keyword) GROUP BY keyword")
ORACLE["Q15_uptime"] = (
    "WITH m AS (SELECT event_type, count(DISTINCT date_trunc('minute', ts)) AS up, min(date_trunc('minute', ts)) AS f, "
    "max(date_trunc('minute', ts)) AS l FROM events GROUP BY 1),\n"
    "e AS (SELECT *, (epoch(l) - epoch(f)) / 60 + 1 AS expected FROM m)\n"
    "SELECT event_type, up AS up_minutes, cast(expected AS bigint) AS expected_minutes, round(up / expected, 6) AS uptime, "
    "up / expected >= 0.9995 AS sla_met FROM e")
ORACLE["Q15_outages"] = (
    "WITH m AS (SELECT DISTINCT event_type, date_trunc('minute', ts) AS minute FROM events),\n"
    "g AS (SELECT *, lag(minute) OVER (PARTITION BY event_type ORDER BY minute) AS prev FROM m)\n"
    "SELECT event_type, strftime(prev, '%Y-%m-%d %H:%M') AS last_up, strftime(minute, '%Y-%m-%d %H:%M') AS back_up, "
    "cast((epoch(minute) - epoch(prev)) / 60 - 1 AS bigint) AS down_minutes FROM g "
    "WHERE (epoch(minute) - epoch(prev)) / 60 >= 120")
ORACLE["Q16_should_retrain"] = _with(("predictions",), _TR + ",\n"
    "lt AS (SELECT model, min(ts) AS trained_at FROM predictions GROUP BY model)",
    "SELECT tr.model, false AS triggered, slope > 0 AS decaying, "
    "coalesce(date_diff('day', cast(trained_at AS date), date '2024-01-20') >= 30, true) AS scheduled, "
    "false OR slope > 0 OR coalesce(date_diff('day', cast(trained_at AS date), date '2024-01-20') >= 30, true) "
    "AS retrain FROM tr LEFT JOIN lt ON tr.model = lt.model")
_DAILY = ("dm AS (SELECT model, strftime(ts, '%Y-%m-%d') AS day, count_if((p >= 0.5) = (y = 1)) / count(*) AS accuracy, "
          "avg(pow(p - y, 2)) AS brier FROM predictions GROUP BY 1, 2)")
ORACLE["Q17_poisoning_suspects"] = _with(("predictions",), _DAILY,
    "SELECT model, day, round(accuracy, 6) AS accuracy FROM dm WHERE accuracy < 0.85")
ORACLE["Q18_unregistered_versions"] = _with(("predictions",),
    "v AS (SELECT model || '-w' || cast(weekofyear(ts) AS varchar) AS model_id, dayofmonth(ts) AS dom FROM predictions)",
    "SELECT DISTINCT model_id FROM v WHERE model_id NOT IN (SELECT model_id FROM v WHERE dom <= 21)")
ORACLE["Q19_latest_performance"] = _with(("predictions",), _DAILY,
    "SELECT model, max(day) AS as_of, round(arg_max(accuracy, day), 6) AS accuracy, round(arg_max(brier, day), 6) AS brier, "
    "concat_ws(',', CASE WHEN arg_max(accuracy, day) < 0.55 THEN 'accuracy' END, "
    "CASE WHEN arg_max(brier, day) > 0.3 THEN 'brier' END) AS breaches FROM dm GROUP BY model")

# ---------------------------------------------------------------- G
_REG = ("reg AS (SELECT strftime(t.trained_at, '%Y%m%d') || '_' || substr(md5(auc.model), 1, 6) AS id, auc.model, "
        "auc.auc AS performance FROM auc JOIN (SELECT model, max(ts) AS trained_at FROM predictions GROUP BY 1) t "
        "ON auc.model = t.model)")
ORACLE["G1_register_models"] = _with(("predictions",), ",\n".join([_SC, _AUC, _REG]),
                                     "SELECT id, model, round(performance, 6) AS performance FROM reg")
ORACLE["G1_second_registration"] = _with(("predictions",), ",\n".join([_SC, _AUC, _REG]),
                                         "SELECT id, model, model < 'purchase' AS rejected FROM reg")
ORACLE["G2_best_model"] = _with(("predictions",), ",\n".join([_SC, _AUC, _REG]),
    "SELECT id, model, round(performance, 6) AS performance FROM reg ORDER BY performance DESC, id LIMIT 1")
ORACLE["G3_audit_models"] = _with(("predictions",), ",\n".join([_SC, _AUC, _REG]),
    "SELECT id, model, round(performance, 6) AS performance FROM reg WHERE performance < 0.92")

# ---------------------------------------------------------------- C
ORACLE["C1_latest_vitals"] = _with(("vitals",),
    "r AS (SELECT *, row_number() OVER (PARTITION BY patient_key, metric ORDER BY ts DESC, event_id DESC) AS rn "
    "FROM vitals)",
    "SELECT patient_key, metric, round(value, 6) AS latest_value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS latest_ts "
    "FROM r WHERE rn = 1")
ORACLE["C1_vital_zscores"] = _with(("vitals",),
    "w AS (SELECT patient_key, metric, event_id, value, avg(value) OVER t AS m, stddev_pop(value) OVER t AS s, "
    "count(value) OVER t AS c FROM vitals WINDOW t AS (PARTITION BY patient_key, metric ORDER BY ts, event_id "
    "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),\n"
    "z AS (SELECT *, CASE WHEN c > 0 AND s > 1e-12 THEN (value - m) / s END AS z FROM w)",
    "SELECT patient_key, metric, event_id, round(z, 4) AS z, coalesce(abs(z) > 2.0, false) AS anomaly FROM z")
_BAD = ("bad AS (SELECT v.* FROM vitals v JOIN (VALUES ('glucose', 70.0, 200.0), ('potassium', 3.5, 5.2), "
        "('creatinine', 0.6, 1.3)) AS r(metric, low, high) ON v.metric = r.metric "
        "WHERE NOT (v.value BETWEEN r.low AND r.high))")
ORACLE["C2_lab_out_of_range_24h"] = _with(("vitals",), _BAD,
    "SELECT patient_key, metric, strftime(date_trunc('hour', ts) - to_hours(k.range), '%Y-%m-%d %H:%M:%S') "
    "AS window_start, count(*) AS n FROM bad, range(0, 24) k GROUP BY 1, 2, 3")
ORACLE["C3_missed_dose_runs"] = _with(("meds",),
    "d AS (SELECT DISTINCT patient_id, drug, cast(ts AS date) AS day FROM meds),\n"
    "g AS (SELECT *, lag(day) OVER (PARTITION BY patient_id, drug ORDER BY day) AS prev FROM d)",
    "SELECT patient_id, drug, strftime(prev, '%Y-%m-%d') AS last_taken, strftime(day, '%Y-%m-%d') AS next_taken, "
    "cast(date_diff('day', prev, day) - 1 AS int) AS missed_days FROM g WHERE date_diff('day', prev, day) - 1 > 2")
ORACLE["C3_overuse"] = _with(("meds",),
    "d AS (SELECT patient_id, drug, cast(ts AS date) AS day, sum(qty) AS taken FROM meds GROUP BY 1, 2, 3)",
    "SELECT patient_id, drug, strftime(day, '%Y-%m-%d') AS day, round(taken, 6) AS taken FROM d WHERE taken > 1.2 * 25.0")
ORACLE["C4_progression"] = _with(("vitals",), "",
    "SELECT patient_key, metric, round(regr_slope(value, epoch(ts) / 86400.0), 4) AS slope_per_day, "
    "round(arg_max(value, ts) - arg_min(value, ts), 6) AS change, count(*) AS n FROM vitals GROUP BY 1, 2")
ORACLE["C5_safety_events_daily"] = (
    "SELECT cast(user_id % 10 AS int) AS unit, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, "
    "count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2")
ORACLE["C6_sepsis_screen"] = _with(("vitals",),
    "r AS (SELECT *, row_number() OVER (PARTITION BY patient_key, metric ORDER BY ts DESC, event_id DESC) AS rn "
    "FROM vitals WHERE metric IN ('heart_rate', 'resp_rate', 'temperature')),\n"
    "w AS (SELECT patient_key, max(CASE WHEN metric = 'heart_rate' THEN value END) AS hr, "
    "max(CASE WHEN metric = 'resp_rate' THEN value END) AS rr, max(CASE WHEN metric = 'temperature' THEN value END) AS t "
    "FROM r WHERE rn = 1 GROUP BY patient_key),\n"
    "s AS (SELECT *, cast(coalesce(hr > 90, false) AS int) + cast(coalesce(rr > 20, false) AS int) "
    "+ cast(coalesce(t > 38 OR t < 36, false) AS int) AS sirs_score FROM w)",
    "SELECT patient_key, round(hr, 6) AS heart_rate, round(rr, 6) AS resp_rate, round(t, 6) AS temperature, "
    "sirs_score, sirs_score >= 2 AS alert FROM s")
ORACLE["C7_assessment_gaps"] = _with(("vitals",),
    "a AS (SELECT DISTINCT patient_key, ts FROM vitals WHERE metric = 'temperature'),\n"
    "g AS (SELECT *, lag(ts) OVER (PARTITION BY patient_key ORDER BY ts) AS prev FROM a)",
    "SELECT patient_key, strftime(prev, '%Y-%m-%d %H:%M:%S.%f') AS gap_start, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') "
    "AS gap_end, false AS open FROM g WHERE (epoch(ts) - epoch(prev)) / 3600.0 > 96.0 UNION ALL "
    "SELECT patient_key, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f'), '2024-01-31 00:00:00.000000', true FROM a "
    "GROUP BY patient_key HAVING (epoch(timestamp '2024-01-31 00:00:00') - epoch(max(ts))) / 3600.0 > 96.0")
ORACLE["C8_overdue_followup"] = _with(("vitals",), "",
    "SELECT DISTINCT patient_key FROM vitals WHERE patient_key NOT IN (SELECT patient_key FROM vitals "
    "WHERE metric = 'spo2' AND ts >= timestamp '2024-01-31 00:00:00' - INTERVAL 10 DAY "
    "AND ts <= timestamp '2024-01-31 00:00:00')")
ORACLE["C9_must_score"] = _with(("clinical",), "",
    "SELECT patient_id, (CASE WHEN bmi > 20 THEN 0 WHEN bmi >= 18.5 THEN 1 ELSE 2 END) + (CASE WHEN weight_loss_pct > 10 "
    "THEN 2 WHEN weight_loss_pct >= 5 THEN 1 ELSE 0 END) + (CASE WHEN acute_illness THEN 2 ELSE 0 END) AS must_score "
    "FROM clinical")
ORACLE["C10_infection_surveillance"] = (
    "WITH e AS (SELECT CASE event_id % 3 WHEN 0 THEN 'mrsa' WHEN 1 THEN 'cdiff' ELSE 'vre' END AS pathogen, "
    "cast(user_id % 5 AS int) AS ward, date_trunc('week', ts) AS week FROM events WHERE event_type = 'error'),\n"
    "c AS (SELECT pathogen, ward, week, count(*) AS n FROM e GROUP BY 1, 2, 3),\n"
    "a AS (SELECT *, avg(n) OVER w AS m, stddev_pop(n) OVER w AS s FROM c "
    "WINDOW w AS (PARTITION BY pathogen, ward ORDER BY week ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))\n"
    "SELECT pathogen, ward, strftime(week, '%Y-%m-%d') AS week, n, round(m, 6) AS baseline_mean, "
    "round(s, 6) AS baseline_std, coalesce(n > m + 1.0 * s, false) AS alarm FROM a")
ORACLE["C11_census"] = (
    "SELECT count(DISTINCT o_custkey) AS census FROM orders WHERE o_orderdate <= timestamp '1996-06-15 00:00:00' "
    "AND (o_orderkey % 13 = 0 OR o_orderdate + to_days(cast(o_orderkey % 10 AS int)) > timestamp '1996-06-15 00:00:00')")
ORACLE["C12_cohort_stats"] = _with(("medical",), "",
    "SELECT CASE WHEN month(exam_date) <= 6 THEN 'h1' ELSE 'h2' END AS cohort, sex, count(weight_kg) AS n, "
    "round(avg(weight_kg), 6) AS mean, round(stddev_samp(weight_kg), 6) AS std, "
    "round(quantile_cont(weight_kg, 0.5), 6) AS median FROM medical WHERE exam_date >= date '2024-01-01' GROUP BY 1, 2")
ORACLE["C13_drug_interactions"] = _with(("meds",),
    "pr AS (SELECT DISTINCT a AS drug_a, b AS drug_b FROM (SELECT printf('D%02d', p_partkey % 50) AS a, "
    "printf('D%02d', (p_partkey * 7) % 50) AS b FROM part WHERE p_size <= 3) WHERE a < b),\n"
    "pd AS (SELECT DISTINCT patient_id, drug FROM meds)",
    "SELECT x.patient_id, p.drug_a, p.drug_b FROM pd x JOIN pr p ON x.drug = p.drug_a "
    "WHERE EXISTS (SELECT 1 FROM pd y WHERE y.patient_id = x.patient_id AND y.drug = p.drug_b)")
ORACLE["C14_guideline_gaps"] = _with(("clinical", "vitals"),
    "pb AS (SELECT patient_id, 'diabetes' AS problem FROM clinical WHERE diabetes UNION ALL "
    "SELECT patient_id, 'hypertension' FROM clinical WHERE hypertension),\n"
    "ru AS (SELECT * FROM (VALUES ('diabetes', 'glucose', 10), ('hypertension', 'heart_rate', 5)) "
    "AS t(problem, lab, max_age_days)),\n"
    "lb AS (SELECT printf('P%03d', patient_key) AS patient_id, metric AS lab, ts FROM vitals)",
    "SELECT pb.patient_id, pb.problem, ru.lab FROM pb JOIN ru ON pb.problem = ru.problem WHERE NOT EXISTS "
    "(SELECT 1 FROM lb WHERE lb.patient_id = pb.patient_id AND lb.lab = ru.lab AND lb.ts <= timestamp '2024-01-31 00:00:00' "
    "AND lb.ts > timestamp '2024-01-31 00:00:00' - to_days(ru.max_age_days))")
ORACLE["C15_new_alerts"] = _with(("vitals",), _BAD + ",\n"
    "f AS (SELECT patient_key, metric, date_trunc('hour', ts) AS hour, min(ts) AS first_ts FROM bad "
    "WHERE ts > timestamp '2024-01-25 00:00:00' GROUP BY 1, 2, 3)",
    "SELECT patient_key, metric, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, "
    "strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS first_ts, (SELECT count(*) FROM f) AS total_new FROM f")
ORACLE["C16_patient_timeline"] = _with(("vitals",), "",
    "SELECT patient_key, event_id, row_number() OVER (PARTITION BY patient_key ORDER BY ts, event_id) AS seq FROM vitals")
ORACLE["C16_treatment_options"] = _with(("clinical",),
    "dx AS (SELECT patient_id, 'diabetes' AS diagnosis FROM clinical WHERE diabetes UNION ALL "
    "SELECT patient_id, 'hypertension' FROM clinical WHERE hypertension UNION ALL "
    "SELECT patient_id, 'ckd' FROM clinical WHERE egfr < 30),\n"
    "tx AS (SELECT * FROM (VALUES ('diabetes', 'metformin'), ('diabetes', 'sglt2'), ('hypertension', 'ace_inhibitor'), "
    "('hypertension', 'thiazide')) AS t(diagnosis, treatment)),\n"
    "ci AS (SELECT * FROM (VALUES ('ckd', 'metformin'), ('diabetes', 'thiazide')) AS t(comorbidity, treatment))",
    "SELECT dx.diagnosis, dx.patient_id, tx.treatment FROM dx JOIN tx ON dx.diagnosis = tx.diagnosis WHERE NOT EXISTS "
    "(SELECT 1 FROM dx d2 JOIN ci ON d2.diagnosis = ci.comorbidity WHERE d2.patient_id = dx.patient_id "
    "AND ci.treatment = tx.treatment)")
ORACLE["C17_risk_stratification"] = _with(("clinical",),
    "d AS (SELECT sex || '_' || CASE WHEN age >= 60 THEN '60+' ELSE '<60' END AS cohort, "
    "CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END AS category FROM clinical)",
    "SELECT cohort, cast(count_if(category = 'low') AS bigint) AS low, cast(count_if(category = 'medium') AS bigint) "
    "AS medium, cast(count_if(category = 'high') AS bigint) AS high FROM d GROUP BY cohort")

# ---------------------------------------------------------------- S
ORACLE["S1_csv_roundtrip"] = _with(("medical",), "",
    "SELECT patient_id, birth_year, sex, strftime(exam_date, '%Y-%m-%d') AS exam_date, weight_kg, zip_code, "
    "blood_pressure, disease_risk, true AS well_formed FROM medical")
ORACLE["S2_json_lines_roundtrip"] = _with(("lifestyle",), "", "SELECT * FROM lifestyle")
ORACLE["S3_geojson_zones"] = _with(("zones",), "", "SELECT zip_code, pm2_5, min_x, max_x, min_y, max_y FROM zones")
_SHAPES = """
sh AS (SELECT zip_code, pm2_5, min_x, max_x, min_y, max_y, cast(substr(zip_code, 2) AS int) % 3 AS kind FROM zones
       UNION ALL SELECT 'ALL', max(pm2_5), -50000, 50000, -50000, 50000, 2 FROM zones)"""
ORACLE["S3_geojson_collections"] = _with(("zones",), _SHAPES,
    "SELECT zip_code, pm2_5, cast(CASE WHEN kind = 2 THEN 1 ELSE 2 END AS bigint) AS n_rings, "
    "cast(CASE WHEN kind = 2 THEN 5 ELSE 10 END AS bigint) AS n_points, min_x, max_x, min_y, max_y FROM sh")
ORACLE["J5_holes_and_parts"] = _with(("medical", "zones"), _SHAPES,
    "SELECT m.patient_id, z.zip_code AS zone FROM medical m LEFT JOIN sh z ON m.latitude > z.min_y AND "
    "m.latitude < z.max_y AND CASE z.kind "
    "WHEN 0 THEN m.longitude > z.min_x AND m.longitude < z.max_x AND NOT (m.longitude BETWEEN z.min_x + 4 AND "
    "z.max_x - 4 AND m.latitude BETWEEN z.min_y + 3 AND z.max_y - 3) "
    "WHEN 1 THEN (m.longitude > z.min_x AND m.longitude < z.min_x + 7) OR (m.longitude > z.max_x - 7 AND "
    "m.longitude < z.max_x) ELSE m.longitude > z.min_x AND m.longitude < z.max_x END")
ORACLE["S4_clean_dataset_roundtrip"] = ORACLE["J1_medical_lifestyle_join"]


def _rowhash_sql(cols):
    return ("sha256(concat_ws(chr(1), " + ", ".join(f"coalesce(cast({c} AS VARCHAR), '\\N')" for c in sorted(cols))
            + "))")


_S5_NEW = ("nw AS (SELECT printf('P%03d', c_custkey) AS patient_id, cast(50 + (c_custkey * 13) % 60 + CASE WHEN "
           "c_custkey % 20 = 0 THEN 1 ELSE 0 END AS double) AS weight_kg, cast(30 + (c_custkey * 5) % 50 AS double) "
           "AS hdl_cholesterol FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT printf('N%03d', c_custkey), "
           "cast(70 AS double), cast(40 AS double) FROM customer WHERE c_custkey % 97 = 0)")
_S5C = ["patient_id", "weight_kg", "hdl_cholesterol"]
ORACLE["S5_snapshot_delta"] = _with(("medical",), _S5_NEW + ",\n"
    f"o AS (SELECT patient_id, {_rowhash_sql(_S5C)} AS h FROM medical),\n"
    f"n AS (SELECT patient_id, {_rowhash_sql(_S5C)} AS h FROM nw),\n"
    "j AS (SELECT coalesce(o.patient_id, n.patient_id) AS patient_id, CASE WHEN o.h IS NULL THEN 'inserted' "
    "WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'updated' END AS change FROM o FULL OUTER JOIN n "
    "ON o.patient_id = n.patient_id)",
    "SELECT patient_id, change FROM j WHERE change IS NOT NULL")
_MED_COLS = [a for _, a in SPECS["medical"][2]]
ORACLE["S5_snapshot_digest"] = _with(("medical",), "",
    "SELECT count(*) AS n_rows, bit_xor(('0x' || substr(" + _rowhash_sql(_MED_COLS) + ", 1, 15))::BIGINT) AS digest "
    "FROM medical")
ORACLE["S6_report_points"] = _with(("predictions",),
    "r AS (SELECT row_number() OVER w AS rn, sum(cast((p >= 0.5) = (y = 1) AS int)) OVER w AS ok, "
    "sum(cast(pow(round(p * 1000) - y * 1000, 2) AS bigint)) OVER w AS se FROM predictions "
    "WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))",
    "SELECT cast(rn AS bigint) AS row_index, cast(ok AS double) / cast(rn AS double) AS accuracy, "
    "cast(se AS double) / cast(rn * 1000000 AS double) AS brier FROM r WHERE rn % 100 = 0")
ORACLE["S9_standardize_records"] = ("SELECT event_id AS event_key, event_type AS kind, "
    "try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, value AS amount FROM events")
ORACLE["S10_risk_resources"] = _with(("clinical",),
    "c AS (SELECT patient_id, CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END AS category, "
    "sex FROM clinical)",
    "SELECT patient_id, json_object('resourceType', 'RiskAssessment', 'subject', patient_id, 'category', category, "
    "'sex', sex)::VARCHAR AS json FROM c")

# ---------------------------------------------------------------- A audits
ORACLE["A6_tokenize_roundtrip"] = "SELECT c_custkey, 36 AS token_len, true AS roundtrip_ok FROM customer"
ORACLE["A7_consent_revocation"] = _with(("medical",),
    "rv AS (SELECT printf('P%03d', c_custkey) AS rid FROM customer WHERE c_custkey % 100 = 1)",
    "SELECT patient_id FROM medical WHERE NOT EXISTS (SELECT 1 FROM rv WHERE starts_with(patient_id, rid))")
_ACC = ("acc AS (SELECT CASE user_id % 3 WHEN 0 THEN 'doctor' WHEN 1 THEN 'nurse' ELSE 'admin' END AS role, "
        "CASE event_type WHEN 'view' THEN 'patient_records' WHEN 'click' THEN 'prescriptions' WHEN 'purchase' "
        "THEN 'vital_signs' WHEN 'signup' THEN 'medication_admin' ELSE 'billing' END AS resource FROM events)")
ORACLE["A12_rbac_violations"] = ("WITH " + _ACC + "\nSELECT role, resource, count(*) AS n FROM acc WHERE (role, resource) "
    "NOT IN (SELECT * FROM (VALUES ('doctor', 'patient_records'), ('doctor', 'prescriptions'), ('nurse', 'vital_signs'), "
    "('nurse', 'medication_admin'))) GROUP BY 1, 2")
ORACLE["A13_abac_audit"] = (
    "SELECT coalesce(CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END = 'high' AND "
    "CASE user_id % 4 WHEN 0 THEN 'cardiology' WHEN 1 THEN 'oncology' ELSE 'icu' END = 'cardiology', false) AS allowed, "
    "count(*) AS n FROM events GROUP BY 1")
ORACLE["A14_out_of_hours_access"] = (
    "SELECT event_type, count(*) AS n FROM events WHERE NOT (hour(ts) * 3600 + minute(ts) * 60 + second(ts) "
    "BETWEEN 28800 AND 64800) GROUP BY 1")
ORACLE["A15_intrusion_windows"] = (
    "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n_hits FROM events "
    "WHERE event_type IN ('error', 'signup') GROUP BY 1, 2")
ORACLE["A16_block_list_audit"] = ("SELECT c_custkey FROM customer WHERE c_nationkey IN "
                                  "(SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
ORACLE["A16_allow_list_audit"] = ("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN "
                                  "(SELECT c_nationkey FROM customer WHERE c_nationkey % 3 = 0)")
ORACLE["A17_file_integrity"] = (
    "WITH f AS (SELECT page_id // 25 AS part, string_agg(coalesce(html, ''), chr(10) ORDER BY page_id) AS before, "
    "string_agg(coalesce(html, '') || CASE WHEN page_id // 25 % 10 = 4 AND page_id % 25 = 7 THEN 'x' ELSE '' END, chr(10) "
    "ORDER BY page_id) AS after FROM pages GROUP BY 1)\n"
    "SELECT cast(part AS VARCHAR) AS name, CASE part % 10 WHEN 3 THEN 'new' WHEN 5 THEN 'missing' ELSE "
    "CASE WHEN before = after THEN 'same' ELSE 'changed' END END AS status FROM f")
ORACLE["A18_audit_hash_chain"] = (
    "WITH RECURSIVE d AS (SELECT cast(ts AS date) AS day, bit_xor(('0x' || substr(md5(concat_ws('|', event_id, "
    "event_type, user_id)), 1, 15))::BIGINT) AS digest, count(*) AS n_lines FROM events GROUP BY 1),\n"
    "r AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM d),\n"
    "ch AS (SELECT i, day, digest, n_lines, sha256('|' || cast(day AS VARCHAR) || '|' || cast(digest AS VARCHAR) || "
    "'|' || cast(n_lines AS VARCHAR)) AS chain FROM r WHERE i = 1 UNION ALL "
    "SELECT r.i, r.day, r.digest, r.n_lines, sha256(ch.chain || '|' || cast(r.day AS VARCHAR) || '|' || "
    "cast(r.digest AS VARCHAR) || '|' || cast(r.n_lines AS VARCHAR)) FROM r JOIN ch ON r.i = ch.i + 1)\n"
    "SELECT strftime(day, '%Y-%m-%d') AS day, digest, n_lines, chain FROM ch")
ORACLE["A19_missing_approvals"] = (
    "WITH u AS (SELECT user_id, cast(ts AS date) AS day, list(DISTINCT event_type) AS ap FROM events GROUP BY 1, 2),\n"
    "m AS (SELECT user_id, day, list_filter(['purchase', 'view'], lambda x: NOT list_contains(ap, x)) AS miss FROM u)\n"
    "SELECT user_id, strftime(day, '%Y-%m-%d') AS day, array_to_string(list_sort(miss), ',') AS missing FROM m "
    "WHERE len(miss) > 0")
ORACLE["A20_config_audit"] = (
    "SELECT s_suppkey, coalesce(s_suppkey % 3 <> 0, false) AND coalesce(s_suppkey % 4 <> 0, false) AND NOT "
    "coalesce(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 5 = 1 END, true) AS config_ok, "
    "coalesce(s_suppkey % 2 = 0, false) AND coalesce(CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE true END, false) "
    "AND NOT coalesce(s_suppkey % 6 = 0, true) AS device_ok FROM supplier")
ORACLE["A21_risk_register"] = (
    "SELECT s_suppkey, cast((s_suppkey % 5 + 1) * (s_nationkey % 5 + 1) AS int) AS risk, "
    "s_acctbal / 1000.0 >= 8.5 AS vendor_high_risk, CASE s_nationkey % 4 WHEN 1 THEN 'Low severity: Log and monitor' "
    "WHEN 2 THEN 'Medium: Isolate systems' WHEN 3 THEN 'High: Activate emergency protocol' "
    "ELSE 'Unknown severity level' END AS plan FROM supplier")
ORACLE["A23_expired_artifacts"] = ("SELECT o_orderkey FROM orders WHERE o_orderdate < "
                                   "timestamp '2001-01-01 00:00:00' - to_days(1500)")
ORACLE["A24_phi_access_counts"] = (
    "SELECT user_id, cast(event_id % 50 AS int) AS patient, strftime(cast(ts AS date), '%Y-%m-%d') AS day, "
    "count(*) AS n_access FROM events GROUP BY 1, 2, 3")

# ---------------------------------------------------------------- M
ORACLE["M11_gradient_step"] = (
    "WITH e AS (SELECT CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y, unnest(embedding) AS x, "
    "generate_subscripts(embedding, 1) AS i FROM embeddings)\n"
    "SELECT cast(i - 1 AS int) AS i, round(-0.1 * avg((0.5 - y) * cast(x AS double)), 6) AS weight FROM e GROUP BY i "
    "UNION ALL SELECT -1, round(-0.1 * avg(0.5 - CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END), 6) FROM embeddings")
ORACLE["M12_uncertain_cases"] = _with(("predictions",), "",
    "SELECT event_id, round(0.5 - abs(p - 0.5), 6) AS uncertainty FROM predictions WHERE abs(p - 0.5) < 0.3")
ORACLE["M15_replay_buffer"] = _with(("predictions",),
    "b AS (SELECT model, event_id, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS slot "
    "FROM predictions)", "SELECT model, event_id, cast(slot AS int) AS slot FROM b WHERE slot <= 1000")

ORACLE["Q7_ddm_first_drift"] = _with(("predictions",), """
r AS (SELECT model, row_number() OVER w AS n, sum(cast((p >= 0.5) <> (y = 1) AS double)) OVER w AS e
      FROM predictions WINDOW w AS (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, e / n AS pp, sqrt((e / n) * (1 - e / n) / n) AS s FROM r),
m AS (SELECT *, min(CASE WHEN n >= 30 THEN pp + s END) OVER w2 AS vmin,
      arg_min(CASE WHEN n >= 30 THEN s END, CASE WHEN n >= 30 THEN pp + s END) OVER w2 AS smin
      FROM q WINDOW w2 AS (PARTITION BY model ORDER BY n ROWS UNBOUNDED PRECEDING))""",
    "SELECT model, min(CASE WHEN n >= 30 AND pp + s > (vmin - smin) + 2.0 * smin THEN n END) AS first_warning, "
    "min(CASE WHEN n >= 30 AND pp + s > (vmin - smin) + 3.0 * smin THEN n END) AS first_drift, max(n) AS n "
    "FROM m GROUP BY model")
ORACLE["Q7_page_hinkley_first_alarm"] = _with(("predictions",), """
a AS (SELECT model, ts, event_id, p, row_number() OVER w AS n, sum(p) OVER w AS sx FROM predictions
      WINDOW w AS (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, sum(p - sx / n - 0.005) OVER w AS m FROM a
      WINDOW w AS (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, min(m) OVER w AS mm FROM b WINDOW w AS (PARTITION BY model ORDER BY ts, event_id
      ROWS UNBOUNDED PRECEDING))""",
    "SELECT model, min(CASE WHEN m - mm > 5.0 THEN n END) AS first_alarm, max(n) AS n FROM c GROUP BY model")

# ---------------------------------------------------------------- streaming forms
ORACLE["C2_lab_alerts_stream"] = ORACLE["C2_lab_out_of_range_24h"]
ORACLE["C5_safety_events_stream"] = ORACLE["C5_safety_events_daily"]
ORACLE["C15_dedup_alerts_stream"] = _with(("vitals",), _BAD,
    "SELECT DISTINCT patient_key, metric, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM bad "
    "WHERE ts > timestamp '2024-01-25 00:00:00'")
ORACLE["C7_assessment_sessions_stream"] = _with(("vitals",),
    "a AS (SELECT patient_key, ts FROM vitals WHERE metric = 'temperature'),\n"
    "g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY patient_key ORDER BY ts) IS NULL OR "
    "ts >= lag(ts) OVER (PARTITION BY patient_key ORDER BY ts) + INTERVAL 96 HOUR THEN 1 ELSE 0 END AS brk FROM a),\n"
    "s AS (SELECT *, sum(brk) OVER (PARTITION BY patient_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)",
    "SELECT patient_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, "
    "strftime(max(ts) + INTERVAL 96 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS n FROM s "
    "GROUP BY patient_key, sid")

# ---------------------------------------------------------------- V11
_REGB = ("rb AS (SELECT c_custkey + 100000 AS rid, CASE WHEN c_custkey % 7 = 0 THEN substr(c_name, 1, length(c_name) - 1) "
         "|| 'X' ELSE c_name END AS c_name, CASE WHEN c_custkey % 11 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END "
         "AS c_nationkey, c_mktsegment, cast(floor(c_acctbal) AS bigint) AS bal FROM customer)")
ORACLE["V11_deterministic_matches"] = ("WITH " + _REGB + "\nSELECT a.c_custkey AS l_id, rb.rid AS r_id FROM customer a "
    "JOIN rb ON lower(trim(a.c_name)) = lower(trim(rb.c_name)) AND lower(trim(cast(a.c_nationkey AS VARCHAR))) = "
    "lower(trim(cast(rb.c_nationkey AS VARCHAR)))")
ORACLE["V11_probabilistic_matches"] = ("WITH " + _REGB + ",\n"
    "ra AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, cast(floor(c_acctbal) AS bigint) AS bal FROM customer),\n"
    "cand AS (SELECT ra.c_custkey AS l_id, rb.rid AS r_id FROM ra JOIN rb ON ra.c_name = rb.c_name UNION "
    "SELECT ra.c_custkey, rb.rid FROM ra JOIN rb ON ra.c_nationkey = rb.c_nationkey AND ra.bal = rb.bal UNION "
    "SELECT ra.c_custkey, rb.rid FROM ra JOIN rb ON ra.c_mktsegment = rb.c_mktsegment AND ra.bal = rb.bal),\n"
    "sc AS (SELECT cand.l_id, cand.r_id, (CASE WHEN ra.c_name IS NOT DISTINCT FROM rb.c_name THEN 4.0 ELSE 0.0 END) "
    "+ (CASE WHEN ra.c_nationkey IS NOT DISTINCT FROM rb.c_nationkey THEN 2.0 ELSE 0.0 END) "
    "+ (CASE WHEN ra.bal IS NOT DISTINCT FROM rb.bal THEN 3.0 ELSE 0.0 END) "
    "+ (CASE WHEN ra.c_mktsegment IS NOT DISTINCT FROM rb.c_mktsegment THEN 1.0 ELSE 0.0 END) "
    "+ (CASE WHEN levenshtein(ra.c_name, rb.c_name) <= 2 THEN 2.0 ELSE 0.0 END) AS score_d "
    "FROM cand JOIN ra ON cand.l_id = ra.c_custkey JOIN rb ON cand.r_id = rb.rid),\n"
    "bt AS (SELECT *, cast(score_d AS double) AS score, row_number() OVER (PARTITION BY l_id ORDER BY score_d DESC, "
    "r_id ASC) AS rn FROM sc WHERE score_d >= 5.0)\nSELECT l_id, r_id, score FROM bt WHERE rn = 1")

# sorted neighbourhoods and the weights' fit (twenty steps) replayed by a recursive query
_F4 = ("c_name", "c_nationkey", "bal", "c_mktsegment")


def _near(order):
    by = ", ".join(f"{c} NULLS FIRST" for c in order)
    return (f"SELECT a.id AS l_id, b.id AS r_id FROM (SELECT *, row_number() OVER (ORDER BY {by}, side, id) AS i FROM both_) a "
            f"JOIN (SELECT *, row_number() OVER (ORDER BY {by}, side, id) AS i FROM both_) b "
            "ON a.side = 0 AND b.side = 1 AND b.i BETWEEN a.i - 3 AND a.i + 3")


_LIKE = {q: " * ".join(f"(CASE s{k} WHEN 1 THEN {q}{k} WHEN 0 THEN 1 - {q}{k} ELSE 1 END)" for k in range(4)) for q in "mu"}
_STEP = ", ".join(f"least(greatest(sum(n * {w} * cast(s{k} = 1 AS int)) / greatest(sum(n * {w} * cast(s{k} >= 0 AS int)), 1e-6), 1e-6), 1 - 1e-6)"
                  for w in ("g", "(1 - g)") for k in range(4))
_SCORE = " + ".join(f"(CASE s{k} WHEN 1 THEN log2(m{k} / u{k}) WHEN 0 THEN log2((1 - m{k}) / (1 - u{k})) ELSE 0 END)" for k in range(4))
ORACLE["V11_learned_matches"] = ("WITH RECURSIVE " + _REGB + ",\n"
    "ra AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, cast(floor(c_acctbal) AS bigint) AS bal FROM customer),\n"
    "both_ AS (SELECT c_custkey AS id, 0 AS side, c_name, bal, c_mktsegment FROM ra UNION ALL "
    "SELECT rid, 1, c_name, bal, c_mktsegment FROM rb),\n"
    "cand AS (" + _near(["c_name"]) + " UNION " + _near(["bal", "c_mktsegment"]) + "),\n"
    "ag AS (SELECT l_id, r_id, " + ", ".join(f"coalesce(cast(ra.{f} = rb.{f} AS int), -1) AS s{k}" for k, f in enumerate(_F4)) +
    " FROM cand JOIN ra ON l_id = ra.c_custkey JOIN rb ON r_id = rb.rid),\n"
    "pat AS (SELECT s0, s1, s2, s3, count(*) AS n FROM ag GROUP BY ALL),\n"
    "em AS (SELECT 0 AS it, 0.1::DOUBLE AS share, " + ", ".join(f"0.9::DOUBLE AS m{k}" for k in range(4)) + ", " +
    ", ".join(f"0.1::DOUBLE AS u{k}" for k in range(4)) + " UNION ALL\n"
    "SELECT it + 1, least(greatest(sum(n * g) / sum(n), 1e-6), 1 - 1e-6), " + _STEP + " FROM (SELECT it, n, s0, s1, s2, s3, "
    "share * a / (share * a + (1 - share) * b) AS g FROM (SELECT em.it, em.share, pat.*, " + _LIKE["m"] + " AS a, " + _LIKE["u"] +
    " AS b FROM em, pat WHERE em.it < 20) x) y GROUP BY it),\n"
    "sc AS (SELECT l_id, r_id, share, " + _SCORE + " AS score FROM ag, em WHERE em.it = 20)\n"
    "SELECT l_id, r_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS rn "
    "FROM sc WHERE score >= log2(9) - log2(share / (1 - share))) z WHERE rn = 1")

ORACLE["I3_one_hot_sparse"] = (
    "WITH " + ", ".join(f"{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM "
                        f"(SELECT DISTINCT cast({col} AS VARCHAR) AS v FROM orders))"
                        for c, col in (("c1", "o_custkey"), ("c2", "o_orderstatus"), ("c3", "o_orderpriority"))) +
    "\nSELECT o_orderkey, concat_ws(',', c1.i, c1.n + c2.i, c1.n + c2.n + c3.i) AS places FROM orders "
    "JOIN c1 ON cast(o_custkey AS VARCHAR) = c1.v JOIN c2 ON o_orderstatus = c2.v JOIN c3 ON o_orderpriority = c3.v")
ORACLE["S7_report_json_roundtrip"] = ORACLE["E10_evaluation_report"]
ORACLE["S8_export_tables"] = ("SELECT 'predictions' AS \"table\", count(*) AS n_rows FROM events UNION ALL "
                              "SELECT 'lineitem_flags', count(*) FROM lineitem")

for _k, _d in SETS.items():
    ORACLE[f"{_k}_{_d[0]}_rule_hits"] = _with(("clinical",), "", hits_sql(_d))

ORACLE["I5_column_transformer"] = _with(("medical", "lifestyle"), _M_AGE_BMI + """,
j AS (SELECT m.patient_id, m.fasting_glucose, m.triglycerides, m.bmi, l.smoking_status FROM m
      JOIN lifestyle l ON m.patient_id = l.patient_id),
fv AS (SELECT median(fasting_glucose) AS g, median(triglycerides) AS t,
       (SELECT smoking_status FROM j WHERE smoking_status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
       AS s FROM j),
f AS (SELECT patient_id, coalesce(fasting_glucose, g) AS fasting_glucose, coalesce(triglycerides, t) AS triglycerides,
      bmi, coalesce(smoking_status, s) AS smoking_status FROM j, fv),
st AS (SELECT avg(fasting_glucose) AS mg, stddev_pop(fasting_glucose) AS sg, avg(triglycerides) AS mt,
       stddev_pop(triglycerides) AS stg, quantile_cont(bmi, [0.2, 0.4, 0.6, 0.8]) AS q FROM f)""",
    "SELECT patient_id, round((fasting_glucose - mg) / sg, 6) AS fasting_glucose, round((triglycerides - mt) / stg, 6) "
    "AS triglycerides, coalesce(cast(smoking_status = 'current' AS int), 0) AS smoking_status_current, "
    "coalesce(cast(smoking_status = 'former' AS int), 0) AS smoking_status_former, "
    "coalesce(cast(smoking_status = 'never' AS int), 0) AS smoking_status_never, "
    "cast(bmi >= q[1] AS int) + cast(bmi >= q[2] AS int) + cast(bmi >= q[3] AS int) + cast(bmi >= q[4] AS int) AS bmi_bin "
    "FROM f, st")

ORACLE["S6_prediction_log_stream"] = _with(("predictions",), "",
    "SELECT model, strftime(cast(ts AS date), '%Y-%m-%d') AS day, count(*) AS n FROM predictions GROUP BY 1, 2")


def _unit(cols: str, seed: int) -> str:
    """hash_unit: first 48 bits of md5('seed|c1|c2...') / 2^48."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {cols})), 1, 12))::BIGINT / 281474976710656.0)"


ORACLE["A3_gaussian_noise"] = _with(("medical",), "",
    f"SELECT patient_id, round(weight_kg + 2.0 * sqrt(-2.0 * ln(1.0 - {_unit('patient_id', 11)})) * "
    f"cos(2.0 * 3.141592653589793 * {_unit('patient_id', 12)}), 6) AS weight_noisy FROM medical")
ORACLE["R25_rule_samples"] = _with(("clinical",),
    "h AS (" + hits_sql() + "),\n"
    f"r AS (SELECT h.*, row_number() OVER (PARTITION BY h.disease, h.code ORDER BY "
    f"{_unit('h.patient_id', 7)}, h.patient_id) AS rn FROM h)",
    "SELECT patient_id, disease, code FROM r WHERE rn <= 3")
ORACLE["M15_replay_sample"] = _with(("predictions",),
    "b AS (SELECT model, event_id, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS slot "
    "FROM predictions),\nbuf AS (SELECT * FROM b WHERE slot <= 1000),\n"
    "sz AS (SELECT model, max(slot) AS size FROM buf GROUP BY model),\n"
    f"dr AS (SELECT model, cast(d.range AS int) AS draw, cast(floor({_unit('model, cast(d.range AS varchar)', 0)} * size) "
    "+ 1 AS int) AS slot FROM sz, range(1, 65) d)",
    "SELECT dr.model, dr.draw, dr.slot, buf.event_id FROM dr JOIN buf ON dr.model = buf.model AND dr.slot = buf.slot")

# DDM with reset (the stateful stream form), replayed row by row with a recursive CTE
ORACLE["Q7_ddm_stream"] = _with(("predictions",), """
r AS (SELECT model, event_id, cast((p >= 0.5) <> (y = 1) AS double) AS err,
      row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS i FROM predictions),
st(model, i, event_id, n, errors, pmin, smin, level, n_out) AS (
  SELECT model, 0, NULL::BIGINT, 0::BIGINT, 0.0::DOUBLE, 'Infinity'::DOUBLE, 'Infinity'::DOUBLE, NULL::VARCHAR,
         NULL::BIGINT FROM (SELECT DISTINCT model FROM r)
  UNION ALL
  SELECT st.model, r.i, r.event_id,
    CASE WHEN c.lvl = 'drift' THEN 0 ELSE c.n1 END,
    CASE WHEN c.lvl = 'drift' THEN 0.0 ELSE c.e1 END,
    CASE WHEN c.lvl = 'drift' THEN 'Infinity'::DOUBLE ELSE c.pm END,
    CASE WHEN c.lvl = 'drift' THEN 'Infinity'::DOUBLE ELSE c.sm END,
    c.lvl, CASE WHEN c.lvl IS NOT NULL THEN c.n1 END
  FROM st JOIN r ON r.model = st.model AND r.i = st.i + 1,
  LATERAL (SELECT b.n1, b.e1, b.pm, b.sm,
             CASE WHEN b.n1 < 30 THEN NULL WHEN b.p + b.s > b.pm + 3.0 * b.sm THEN 'drift'
                  WHEN b.p + b.s > b.pm + 2.0 * b.sm THEN 'warning' END AS lvl
           FROM (SELECT a.n1, a.e1, a.p, a.s,
                   CASE WHEN a.n1 >= 30 AND a.p + a.s < st.pmin + st.smin THEN a.p ELSE st.pmin END AS pm,
                   CASE WHEN a.n1 >= 30 AND a.p + a.s < st.pmin + st.smin THEN a.s ELSE st.smin END AS sm
                 FROM (SELECT st.n + 1 AS n1, st.errors + r.err AS e1, (st.errors + r.err) / (st.n + 1) AS p,
                         sqrt(((st.errors + r.err) / (st.n + 1)) * (1 - (st.errors + r.err) / (st.n + 1)) / (st.n + 1)) AS s
                      ) a) b) c)""",
    "SELECT model, event_id, level, n_out AS n_since_reset FROM st WHERE level IS NOT NULL")
ORACLE["Q7_ddm_stream"] = "WITH RECURSIVE " + ORACLE["Q7_ddm_stream"][len("WITH "):]

ORACLE["Q7_ddm_alarms"] = ORACLE["Q7_ddm_stream"]

# one row after the other: n rows and k errors since the reset, place of the last
# error, sum of squared distances, largest level
ORACLE["Q7_eddm_alarms"] = _with(("predictions",), """
r AS (SELECT model, event_id, (p >= 0.5) <> (y = 1) AS err,
      row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS i FROM predictions),
st(model, i, event_id, n, k, last, dd, top, level, n_out) AS (
  SELECT model, 0, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, NULL::VARCHAR, NULL::BIGINT
  FROM (SELECT DISTINCT model FROM r)
  UNION ALL
  SELECT st.model, r.i, r.event_id, CASE WHEN c.lvl = 'drift' THEN 0 ELSE st.n + 1 END,
    CASE WHEN c.lvl = 'drift' THEN 0 ELSE c.k1 END, CASE WHEN c.lvl = 'drift' THEN 0 WHEN r.err THEN st.n + 1 ELSE st.last END,
    CASE WHEN c.lvl = 'drift' THEN 0 ELSE c.dd1 END, CASE WHEN c.lvl = 'drift' THEN 0.0 ELSE c.top1 END,
    c.lvl, CASE WHEN c.lvl IS NOT NULL THEN st.n + 1 END
  FROM st JOIN r ON r.model = st.model AND r.i = st.i + 1,
  LATERAL (SELECT b.k1, b.dd1, b.top1, CASE WHEN r.err AND b.k1 >= 30 THEN
             CASE WHEN b.v / b.top1 < 0.90 THEN 'drift' WHEN b.v / b.top1 < 0.95 THEN 'warning' END END AS lvl
           FROM (SELECT a.k1, a.dd1, a.v, CASE WHEN r.err AND a.k1 >= 30 THEN greatest(st.top, a.v) ELSE st.top END AS top1
                 FROM (SELECT z.k1, z.dd1, (st.n + 1) / z.k1 + 2.0::DOUBLE * sqrt(greatest(z.dd1 / z.k1
                         - ((st.n + 1) / z.k1) * ((st.n + 1) / z.k1), 0.0)) AS v
                       FROM (SELECT st.k + CASE WHEN r.err THEN 1 ELSE 0 END AS k1,
                               st.dd + CASE WHEN r.err THEN (st.n + 1 - st.last) * (st.n + 1 - st.last) ELSE 0 END AS dd1) z) a) b) c)""",
    "SELECT model, event_id, level, n_out AS n_since_reset FROM st WHERE level IS NOT NULL")
ORACLE["Q7_eddm_alarms"] = "WITH RECURSIVE " + ORACLE["Q7_eddm_alarms"][len("WITH "):]

# one hour after the other; o holds the running sums, its row 0 is empty
ORACLE["Q8_adwin_changes"] = _with(("predictions",), """
x AS (SELECT model, cast(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS bucket,
      cast(round((p + CASE WHEN day(ts) >= 20 THEN 0.2::DOUBLE WHEN day(ts) >= 10 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) / 1e-6::DOUBLE)
      AS HUGEINT) AS x FROM predictions),
b AS (SELECT model, bucket, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY 1, 2),
o AS MATERIALIZED (SELECT model, row_number() OVER w AS t, bucket, cast(sum(n) OVER w AS BIGINT) AS n, sum(s) OVER w AS s, sum(q) OVER w AS q
      FROM b WINDOW w AS (PARTITION BY model ORDER BY bucket)
      UNION ALL SELECT DISTINCT model, 0, NULL, 0, 0, 0 FROM b),
k AS (SELECT h.model, h.t, m.t AS c, lo.t AS start, h.n - lo.n AS n, m.n - lo.n AS n0, h.n - m.n AS n1, h.s - lo.s AS s, h.q - lo.q AS q,
             m.s - lo.s AS s0, h.s - m.s AS s1
      FROM o h JOIN o m ON m.model = h.model AND m.t < h.t AND bit_count(h.t - m.t) = 1
      JOIN o lo ON lo.model = h.model AND lo.t < m.t),
d AS MATERIALIZED (SELECT model, t, start, max(c) AS c FROM (
        SELECT *, 1.0::DOUBLE / n0 + 1.0::DOUBLE / n1 AS inv, ln(2.0::DOUBLE * ln(cast(n AS DOUBLE)) / 0.002::DOUBLE) AS lg,
               (cast(q AS DOUBLE) - cast(s AS DOUBLE) * cast(s AS DOUBLE) / n) / n * (1e-6::DOUBLE * 1e-6::DOUBLE) AS v FROM k
        WHERE n0 >= 5 AND n1 >= 5)
      WHERE abs(cast(s0 AS DOUBLE) / n0 - cast(s1 AS DOUBLE) / n1) * 1e-6::DOUBLE
            > sqrt(2.0::DOUBLE * inv * greatest(v, 0.0) * lg) + 2.0::DOUBLE / 3.0::DOUBLE * inv * lg
      GROUP BY 1, 2, 3),
st(model, t, before, start) AS (
  SELECT DISTINCT model, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM b
  UNION ALL
  SELECT st.model, st.t + 1, st.start, coalesce(d.c, st.start)
  FROM st JOIN o ON o.model = st.model AND o.t = st.t + 1 LEFT JOIN d ON d.model = st.model AND d.t = st.t + 1 AND d.start = st.start)""",
    "SELECT st.model, h.bucket, nx.bucket AS cut, m.n - lo.n AS n_before, h.n - m.n AS n_after, "
    "round(cast(m.s - lo.s AS DOUBLE) / (m.n - lo.n) * 1e-6::DOUBLE, 6) AS mean_before, "
    "round(cast(h.s - m.s AS DOUBLE) / (h.n - m.n) * 1e-6::DOUBLE, 6) AS mean_after "
    "FROM st JOIN o h ON h.model = st.model AND h.t = st.t JOIN o m ON m.model = st.model AND m.t = st.start "
    "JOIN o lo ON lo.model = st.model AND lo.t = st.before JOIN o nx ON nx.model = st.model AND nx.t = st.start + 1 "
    "WHERE st.start <> st.before")
ORACLE["Q8_adwin_changes"] = "WITH RECURSIVE " + ORACLE["Q8_adwin_changes"][len("WITH "):]

# as many samples as the classes differ by, all inside the bounds of the minority
ORACLE["I6_smote_balance"] = (
    "WITH n AS (SELECT count_if(label >= 7) AS few, count_if(label < 7) AS many, min(len(embedding)) AS dim FROM embeddings)\n"
    "SELECT cast(many - few AS BIGINT) AS n_samples, cast(many - few AS BIGINT) AS n_ids, cast(dim AS int) AS dim, 0::BIGINT AS n_outside FROM n")

# the reloaded package must score every row exactly like the saved model
ORACLE["M8_save_load_roundtrip"] = "SELECT vec_id, true AS same FROM embeddings"

ORACLE["C12_cohort_cube"] = _with(("medical",), "",
    "SELECT CASE WHEN month(exam_date) <= 6 THEN 'h1' ELSE 'h2' END AS cohort, sex, count(*) AS n, "
    "round(avg(weight_kg), 6) AS mean, cast(grouping_id(CASE WHEN month(exam_date) <= 6 THEN 'h1' ELSE 'h2' END, sex) "
    "AS int) AS grouping_id FROM medical GROUP BY CUBE (CASE WHEN month(exam_date) <= 6 THEN 'h1' ELSE 'h2' END, sex)")

ORACLE["Q12_resource_breaches"] = (
    "WITH e AS (SELECT CASE event_id % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'memory' ELSE 'gpu' END AS resource, "
    "value / 400.0 AS util FROM events)\n"
    "SELECT resource, util > CASE resource WHEN 'cpu' THEN 0.8 WHEN 'memory' THEN 0.75 ELSE 0.9 END AS breach, "
    "CASE WHEN util >= 0.95 THEN 'critical' WHEN util >= 0.90 THEN 'alert' WHEN util >= 0.85 THEN 'warning' "
    "ELSE 'ok' END AS level, count(*) AS n FROM e GROUP BY 1, 2, 3")

ORACLE["L3_prs_wide"] = _with(("genotypes", "medical"), _prs_sql("true"),
    "SELECT patient_id, round(max(CASE WHEN condition = 'alzheimers' THEN prs END), 6) AS alzheimers, "
    "round(max(CASE WHEN condition = 'diabetes' THEN prs END), 6) AS diabetes FROM allp GROUP BY patient_id")
ORACLE["V2_failing_samples"] = _with(("medical",), _M_AGE_BMI + ",\nh AS (" + " UNION ALL ".join(
    f"SELECT patient_id, '{c}: {n}' AS rule FROM m WHERE NOT coalesce({p}, false)" for c, n, p in _RULES) + "),\n"
    f"r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY {_unit('patient_id', 5)}, patient_id) AS rank FROM h)",
    "SELECT patient_id, rule, cast(rank AS int) AS rank FROM r WHERE rank <= 2")

# drift table: KS rows as in Q1; chi-square p-values from the regularised
# lower incomplete gamma series, summed in log space (2000 terms)
ORACLE["Q2_drift_table"] = ("WITH " + _KS + ",\n"
    "lg2 AS (" + _long_sql(_CATF, "varchar") + "),\n"
    "cc AS (SELECT feature, value, count_if(is_ref) AS o_ref, count_if(NOT is_ref) AS o_cur FROM lg2 GROUP BY 1, 2),\n"
    "ct AS (SELECT *, sum(o_ref) OVER (PARTITION BY feature) AS n_ref, sum(o_cur) OVER (PARTITION BY feature) AS n_cur "
    "FROM cc),\nce AS (SELECT *, (o_ref + o_cur) * n_ref / (n_ref + n_cur) AS e_ref, "
    "(o_ref + o_cur) * n_cur / (n_ref + n_cur) AS e_cur FROM ct),\n"
    "cs AS (SELECT feature, sum(pow(o_ref - e_ref, 2) / e_ref + pow(o_cur - e_cur, 2) / e_cur) AS x, "
    "(count(*) - 1) / 2.0 AS a FROM ce GROUP BY feature),\n"
    "cp AS (SELECT feature, x, 1.0 - (SELECT sum(exp((a + t.n) * ln(x / 2.0) - x / 2.0 - lgamma(a + t.n + 1))) "
    "FROM range(0, 2000) t(n)) AS p FROM cs),\n"
    "rows_ AS (SELECT feature, 'ks' AS test, d AS statistic, p_value, p_value < 0.05 / 6 AS drift FROM kp UNION ALL "
    "SELECT feature, 'chi2', x, greatest(p, 0.0), greatest(p, 0.0) < 0.05 / 6 FROM cp)\n"
    "SELECT feature, test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, drift, "
    "round(avg(cast(drift AS double)) OVER (), 6) AS drifted_share, "
    "avg(cast(drift AS double)) OVER () >= 0.5 AS dataset_drift FROM rows_")
