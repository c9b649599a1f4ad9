"""DuckDB-side SQL for the oracle check: an independent, plain-SQL statement
of the cleaning and feature chain, shared by the oracle queries as CTEs.

``enc`` is the raw encounter view (same text as the Spark source), ``clean``
the load-and-clean result, ``feat`` the featured table.
"""

from __future__ import annotations

from riskloom.functions.clinical import (
    A1C_ORDINAL, AGE_MIDPOINTS, GLU_ORDINAL, ICD9_GROUPS, NUMBER_PATTERN,
)
from riskloom.operators.clean import DECEASED_DISPOSITION_IDS
from riskloom.sources.encounters import (
    CRITICAL_NUMERIC, DRUG_COLUMNS, NA_TOKENS, encounter_columns, encounter_schema, encounters_sql,
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return "(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def enc_cte() -> str:
    return f"enc AS (\n{encounters_sql()}\n)"


def clean_cte(top_k: int = 10) -> str:
    schema = encounter_schema()
    strings = {f.name for f in schema.fields if f.dataType.simpleString() == "string"}
    toks = _in_list(NA_TOKENS)
    cols = []
    for name, _ in encounter_columns():
        if name in strings:
            cols.append(f"CASE WHEN {name} IN {toks} THEN NULL ELSE {name} END AS {name}")
        else:
            cols.append(name)
    nn = ",\n    ".join(cols)
    keep = [n for n, _ in encounter_columns() if n not in ("weight", "payer_code")]
    sel = []
    for n in keep:
        if n == "medical_specialty":
            sel.append("CASE WHEN t.v IS NULL THEN 'Other' ELSE coalesce(s1.medical_specialty, 'Unknown') END"
                       " AS medical_specialty")
        elif n in ("race", "diag_1", "diag_2", "diag_3"):
            sel.append(f"coalesce(s1.{n}, 'Unknown') AS {n}")
        else:
            sel.append(f"s1.{n}")
    sel.append("s1.readmitted_binary")
    crit = " AND ".join(f"s1.{c} IS NOT NULL" for c in CRITICAL_NUMERIC)
    return f"""nn AS (
  SELECT
    {nn}
  FROM enc
),
s1 AS (
  SELECT *, CAST(coalesce(readmitted = '<30', false) AS INTEGER) AS readmitted_binary
  FROM nn
  WHERE discharge_disposition_id IS NULL OR discharge_disposition_id NOT IN {_in_list(DECEASED_DISPOSITION_IDS)}
),
spec_top AS (
  SELECT coalesce(medical_specialty, 'Unknown') AS v, count(*) AS c FROM s1
  GROUP BY 1 ORDER BY c DESC, v ASC LIMIT {top_k}
),
clean AS (
  SELECT {", ".join(sel)}
  FROM s1 LEFT JOIN spec_top t ON coalesce(s1.medical_specialty, 'Unknown') = t.v
  WHERE {crit}
)"""


def diag_group_sql(col: str) -> str:
    t = f"trim({col})"
    n = f"TRY_CAST(trunc(TRY_CAST({t} AS DOUBLE)) AS BIGINT)"
    ranges = " ".join(f"WHEN {n} BETWEEN {lo} AND {hi} THEN {_q(g)}" for g, lo, hi in ICD9_GROUPS)
    return (f"CASE WHEN {t} IS NULL OR {t} = '' OR {t} = '?' THEN 'Unknown' "
            f"WHEN starts_with({t}, 'E') OR starts_with({t}, 'V') THEN 'External' "
            f"WHEN regexp_matches({t}, {_q(NUMBER_PATTERN)}) AND {n} IS NOT NULL THEN CASE {ranges} ELSE 'Other' END "
            f"ELSE 'Other' END")


def _map_sql(col: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {col} = {_q(k)} THEN {v}" for k, v in mapping.items())
    return f"coalesce(CASE {whens} END, {default})"


def feat_cte() -> str:
    drugs = DRUG_COLUMNS
    active = " + ".join(f"CAST(NOT ({d} IS NOT DISTINCT FROM 'No') AS INTEGER)" for d in drugs)
    changes = " + ".join(f"CAST(coalesce({d} IN ('Up', 'Down'), false) AS INTEGER)" for d in drugs)
    return f"""g AS (
  SELECT *, {diag_group_sql('diag_1')} AS diag_1_group,
            {diag_group_sql('diag_2')} AS diag_2_group,
            {diag_group_sql('diag_3')} AS diag_3_group
  FROM clean
),
feat AS (
  SELECT encounter_id, patient_nbr, readmitted_binary, race, gender, age, A1Cresult, insulin, medical_specialty,
    diag_1_group, diag_2_group, diag_3_group,
    time_in_hospital, num_lab_procedures, num_procedures, num_medications,
    number_outpatient, number_emergency, number_inpatient, number_diagnoses,
    {active} AS num_active_medications,
    {changes} AS medication_change_count,
    CAST(NOT (insulin IS NOT DISTINCT FROM 'No') AS INTEGER) AS has_insulin,
    CAST(coalesce(insulin IN ('Up', 'Down'), false) AS INTEGER) AS insulin_changed,
    number_outpatient + number_emergency + number_inpatient AS total_visits_prior,
    CAST(coalesce(number_outpatient + number_emergency + number_inpatient >= 3, false) AS INTEGER) AS high_utilizer,
    CAST(coalesce(starts_with(diag_1, '250'), false) AS INTEGER) AS diabetes_primary,
    CAST(len(list_distinct([diag_1_group, diag_2_group, diag_3_group])) AS INTEGER) AS num_comorbidities,
    CAST(coalesce(time_in_hospital > 7, false) AS INTEGER) AS long_stay,
    CAST(coalesce(admission_type_id = 1, false) AS INTEGER) AS emergency_admission,
    CAST({_map_sql('age', AGE_MIDPOINTS, 55)} AS DOUBLE) AS age_numeric,
    CAST(coalesce("change" = 'Ch', false) AS INTEGER) AS med_changed,
    CAST(coalesce(diabetesMed = 'Yes', false) AS INTEGER) AS on_diabetes_med,
    CAST({_map_sql('A1Cresult', A1C_ORDINAL, 0)} AS INTEGER) AS a1c_ordinal,
    CAST({_map_sql('max_glu_serum', GLU_ORDINAL, 0)} AS INTEGER) AS glu_ordinal,
    CAST(coalesce(gender = 'Male', false) AS INTEGER) AS gender_male
  FROM g
)"""


def with_views(select_sql: str, *views: str, extra: str = "") -> str:
    """WITH-prefixed query over the requested views ('enc', 'clean', 'feat')
    plus any ``extra`` CTEs (text 'name AS (...), ...')."""
    parts = [enc_cte()]
    if "clean" in views or "feat" in views:
        parts.append(clean_cte())
    if "feat" in views:
        parts.append(feat_cte())
    if extra.strip():
        parts.append(extra.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n" + select_sql


def hash_bits_sql(key: str, salt: str) -> str:
    """DuckDB twin of ``functions.clinical.hash_bits``."""
    return f"('0x' || substring(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT"


def split_cte(frac: str = "0.2") -> str:
    """``tr`` and ``te``: the exact stratified split of ``feat`` (F1)."""
    return f"""split AS (
  SELECT *, row_number() OVER (PARTITION BY readmitted_binary ORDER BY {hash_bits_sql('encounter_id', 'split42')}, encounter_id)
            <= round(count(*) OVER (PARTITION BY readmitted_binary) * {frac}) AS is_test FROM feat),
tr AS (SELECT * FROM split WHERE NOT is_test),
te AS (SELECT * FROM split WHERE is_test)"""


AGE_GROUP_SQL = ("CASE WHEN age_numeric > 0 AND age_numeric <= 40 THEN '<40' "
                 "WHEN age_numeric > 40 AND age_numeric <= 60 THEN '40-60' "
                 "WHEN age_numeric > 60 AND age_numeric <= 75 THEN '60-75' "
                 "WHEN age_numeric > 75 AND age_numeric <= 100 THEN '75+' ELSE 'nan' END")

RATIONAL_SCORE_SQL = ("CAST((number_inpatient * 90 + time_in_hospital * 10 + num_medications) % 1000 AS DOUBLE)"
                      " / 1000.0::DOUBLE")
ALT_SCORE_SQL = "CAST((num_lab_procedures * 7 + num_procedures * 13) % 100 AS DOUBLE) / 100.0::DOUBLE"


def scored_cte(split_salt: str = "split42", test_cut: int = 858993459) -> str:
    """``scored_all``: every featured row with split flag, fold, age group and
    two deterministic scores; ``scored``: its test rows."""
    return f"""scored_all AS (
  SELECT encounter_id, readmitted_binary AS label, race, gender, age_numeric, {AGE_GROUP_SQL} AS age_group,
         {RATIONAL_SCORE_SQL} AS score, {ALT_SCORE_SQL} AS alt_score,
         {hash_bits_sql('encounter_id', split_salt)} < {test_cut} AS is_test,
         CAST({hash_bits_sql('encounter_id', 'fold42')} % 5 AS INTEGER) AS fold
  FROM feat
),
scored AS (SELECT * FROM scored_all WHERE is_test)"""
