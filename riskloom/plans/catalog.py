"""Registered queries: one per operator of SURVEY section 2, each with its
DuckDB oracle where the operator is SQL-expressible.

Every query reads the driver tables at ``sf_dir`` (or data Spark derives
from them) in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.clinical import AGE_ORDER, OUTCOME_LABELS, diagnosis_group, map_values
from riskloom.operators import clean as C
from riskloom.operators import cohort as E
from riskloom.operators.features import FEATURES
from riskloom.plans import hospital as H
from riskloom.plans.oracle import diag_group_sql, with_views
from riskloom.plans.registry import ORACLE, QUERIES, Query, register  # noqa: F401
from riskloom.session import table_path
from riskloom.sources.encounters import load_encounters

def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _feat(spark, sf_dir):
    return H.hospital_features(spark, sf_dir)


def _clean(spark, sf_dir):
    return H.clean_encounters(load_encounters(spark, sf_dir))


# ---------------------------------------------------------------- flagship

FLAGSHIP_SQL = with_views("""
SELECT d.pos, d.age, r.rate, CAST(coalesce(r.n, 0) AS BIGINT) AS n
FROM (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{a}')" for i, a in enumerate(AGE_ORDER)) + """) v(pos, age)) d
LEFT JOIN (SELECT age, avg(CAST(readmitted_binary AS DOUBLE)) AS rate, count(*) AS n
           FROM feat WHERE age IS NOT NULL GROUP BY age) r ON d.age = r.age
""", "feat")


@register("flagship_rate_by_age", FLAGSHIP_SQL)
def flagship_rate_by_age(spark, sf_dir):
    """Minimum slice: raw -> clean -> features -> outcome rate by age bracket."""
    return E.outcome_rate_by(_feat(spark, sf_dir), "age", "readmitted_binary", domain=AGE_ORDER)


# ---------------------------------------------------------------- sources

@register("f4_encounters_raw", with_views("SELECT * FROM enc"))
def f4_encounters_raw(spark, sf_dir):
    return load_encounters(spark, sf_dir)


# ---------------------------------------------------------------- cleaning

@register("b_clean_encounters", with_views("SELECT * FROM clean", "clean"))
def b_clean_encounters(spark, sf_dir):
    """B1-B7 chained: NA tokens, hospice filter, label, drops, fills, top-10."""
    return _clean(spark, sf_dir)


@register("b1_null_counts", with_views("""
SELECT count(*) - count(CASE WHEN race IN ('?','Unknown/Invalid','None') THEN NULL ELSE race END) AS race_nulls,
       count(*) - count(CASE WHEN gender IN ('?','Unknown/Invalid','None') THEN NULL ELSE gender END) AS gender_nulls,
       count(*) - count(CASE WHEN A1Cresult IN ('?','Unknown/Invalid','None') THEN NULL ELSE A1Cresult END) AS a1c_nulls,
       count(*) - count(CASE WHEN diag_1 IN ('?','Unknown/Invalid','None') THEN NULL ELSE diag_1 END) AS diag_1_nulls
FROM enc"""))
def b1_null_counts(spark, sf_dir):
    df = C.normalise_nulls(load_encounters(spark, sf_dir), ["?", "Unknown/Invalid", "None"])
    return df.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(f"{a}_nulls")
                    for c, a in [("race", "race"), ("gender", "gender"), ("A1Cresult", "a1c"),
                                 ("diag_1", "diag_1")]])


@register("b3_exclude_codes", with_views("""
SELECT discharge_disposition_id, count(*) AS n FROM enc
WHERE discharge_disposition_id IS NULL OR discharge_disposition_id NOT IN (11, 13, 14, 19, 20, 21)
GROUP BY discharge_disposition_id"""))
def b3_exclude_codes(spark, sf_dir):
    df = C.exclude_codes(load_encounters(spark, sf_dir), "discharge_disposition_id", C.DECEASED_DISPOSITION_IDS)
    return df.groupBy("discharge_disposition_id").agg(F.count(F.lit(1)).alias("n"))


@register("b4_binary_label", with_views("""
SELECT readmitted, CAST(coalesce(readmitted = '<30', false) AS INTEGER) AS readmitted_binary, count(*) AS n
FROM enc GROUP BY 1, 2"""))
def b4_binary_label(spark, sf_dir):
    df = C.binary_label(load_encounters(spark, sf_dir), "readmitted", "<30")
    return df.groupBy("readmitted", "readmitted_binary").agg(F.count(F.lit(1)).alias("n"))


B7_SQL = with_views("""
SELECT CASE WHEN t.v IS NULL THEN 'Other' ELSE coalesce(s.medical_specialty, 'Unknown') END AS medical_specialty,
       count(*) AS n
FROM s LEFT JOIN t ON coalesce(s.medical_specialty, 'Unknown') = t.v GROUP BY 1""", extra="""
s AS (SELECT CASE WHEN medical_specialty = '?' THEN NULL ELSE medical_specialty END AS medical_specialty FROM enc),
t AS (SELECT coalesce(medical_specialty, 'Unknown') AS v, count(*) AS c FROM s GROUP BY 1 ORDER BY c DESC, v LIMIT 5)""")


@register("b7_lump_top5_specialty", B7_SQL)
def b7_lump_top5_specialty(spark, sf_dir):
    """Top-k with a tie at the cut (k = 5 falls inside a 9-way tie)."""
    df = C.normalise_nulls(load_encounters(spark, sf_dir), ["?"], ["medical_specialty"])
    df = C.lump_top_k(df.fillna({"medical_specialty": "Unknown"}), "medical_specialty", 5)
    return df.groupBy("medical_specialty").agg(F.count(F.lit(1)).alias("n"))


@register("b7_lump_top10_part_brand", """
WITH t AS (SELECT p_brand AS v, count(*) AS c FROM part WHERE p_brand IS NOT NULL
           GROUP BY 1 ORDER BY c DESC, v LIMIT 10)
SELECT CASE WHEN t.v IS NULL THEN 'Other' ELSE p.p_brand END AS p_brand, count(*) AS n
FROM part p LEFT JOIN t ON p.p_brand = t.v GROUP BY 1""")
def b7_lump_top10_part_brand(spark, sf_dir):
    df = C.lump_top_k(_t(spark, sf_dir, "part"), "p_brand", 10)
    return df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@register("b8_numeric_only", with_views("""
SELECT encounter_id, admission_type_id, discharge_disposition_id, admission_source_id, time_in_hospital,
       num_lab_procedures, num_procedures, num_medications, number_outpatient, number_emergency,
       number_inpatient, number_diagnoses, readmitted_binary FROM clean""", "clean"))
def b8_numeric_only(spark, sf_dir):
    return C.numeric_only(_clean(spark, sf_dir).drop("patient_nbr"), keep=["encounter_id"])


@register("b10_align_features", with_views("""
SELECT encounter_id, time_in_hospital, CAST(0 AS INTEGER) AS unseen_feature, num_medications FROM clean""", "clean"))
def b10_align_features(spark, sf_dir):
    return C.align_features(_clean(spark, sf_dir), ["time_in_hospital", "unseen_feature", "num_medications"],
                            keep=["encounter_id"])


# ---------------------------------------------------------------- lookups

@register("c2_outcome_labels", with_views("""
SELECT coalesce(CASE readmitted WHEN 'NO' THEN 'No Readmission' WHEN '<30' THEN 'Readmitted <30 days'
                WHEN '>30' THEN 'Readmitted >30 days' END, readmitted) AS outcome, count(*) AS n
FROM enc WHERE readmitted IS NOT NULL GROUP BY 1"""))
def c2_outcome_labels(spark, sf_dir):
    vc = E.value_counts(load_encounters(spark, sf_dir), "readmitted")
    return vc.select(F.coalesce(map_values("readmitted", OUTCOME_LABELS), F.col("readmitted")).alias("outcome"), "n")


@register("c3_age_counts_reindexed", with_views("""
SELECT d.pos, d.age, CAST(coalesce(r.n, 0) AS BIGINT) AS n
FROM (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{a}')" for i, a in enumerate(AGE_ORDER)) + """) v(pos, age)) d
LEFT JOIN (SELECT age, count(*) AS n FROM enc WHERE age IS NOT NULL GROUP BY age) r ON d.age = r.age"""))
def c3_age_counts_reindexed(spark, sf_dir):
    vc = E.value_counts(load_encounters(spark, sf_dir), "age")
    return C.reindex_domain(vc, "age", AGE_ORDER, fill={"n": 0})


# ---------------------------------------------------------------- row functions

@register("d1_diagnosis_groups", with_views(f"""
SELECT encounter_id, diag_1, diag_2, diag_3,
       {diag_group_sql("CASE WHEN diag_1 = '?' THEN NULL ELSE diag_1 END")} AS diag_1_group,
       {diag_group_sql('diag_2')} AS diag_2_group,
       {diag_group_sql('diag_3')} AS diag_3_group
FROM enc"""))
def d1_diagnosis_groups(spark, sf_dir):
    df = load_encounters(spark, sf_dir)
    return df.select("encounter_id", "diag_1", "diag_2", "diag_3",
                     diagnosis_group(F.when(F.col("diag_1") == "?", None).otherwise(F.col("diag_1")))
                     .alias("diag_1_group"),
                     diagnosis_group("diag_2").alias("diag_2_group"),
                     diagnosis_group("diag_3").alias("diag_3_group"))


@register("d11_model_table", with_views("""
SELECT encounter_id, patient_nbr, readmitted_binary, race, gender, """ + ", ".join(FEATURES) + " FROM feat", "feat"))
def d11_model_table(spark, sf_dir):
    """D1-D11 through the full chain: key, label, sensitive columns, 24 features."""
    return H.hospital_model_table(spark, sf_dir)


# ---------------------------------------------------------------- cohort aggregates

@register("e1_value_counts_race", with_views("""
SELECT race, count(*) AS n FROM (SELECT CASE WHEN race = '?' THEN NULL ELSE race END AS race FROM enc)
WHERE race IS NOT NULL GROUP BY race"""))
def e1_value_counts_race(spark, sf_dir):
    return E.value_counts(C.normalise_nulls(load_encounters(spark, sf_dir), ["?"], ["race"]), "race")


@register("e1_value_counts_orderpriority", """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def e1_value_counts_orderpriority(spark, sf_dir):
    return E.value_counts(_t(spark, sf_dir, "orders"), "o_orderpriority")


def _rate_sql(col: str) -> str:
    return with_views(f"""
SELECT {col}, avg(CASE WHEN readmitted = '<30' THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n
FROM (SELECT CASE WHEN {col} IN ('?','Unknown/Invalid','None') THEN NULL ELSE {col} END AS {col}, readmitted FROM enc)
WHERE {col} IS NOT NULL GROUP BY {col}""")


def _rate_query(col: str) -> Query:
    def q(spark, sf_dir):
        raw = C.normalise_nulls(load_encounters(spark, sf_dir), ["?", "Unknown/Invalid", "None"])
        return E.outcome_rate_by(raw, col, F.col("readmitted").eqNullSafe("<30"))
    return q


for _col in ["race", "A1Cresult", "insulin"]:
    register(f"e2_rate_by_{_col.lower()}", _rate_sql(_col))(_rate_query(_col))


@register("e2_rate_by_age_domain", with_views("""
SELECT d.pos, d.age, r.rate, CAST(coalesce(r.n, 0) AS BIGINT) AS n
FROM (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{a}')" for i, a in enumerate(AGE_ORDER)) + """) v(pos, age)) d
LEFT JOIN (SELECT age, avg(CASE WHEN readmitted = '<30' THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n
           FROM enc WHERE age IS NOT NULL GROUP BY age) r ON d.age = r.age"""))
def e2_rate_by_age_domain(spark, sf_dir):
    raw = load_encounters(spark, sf_dir)
    return E.outcome_rate_by(raw, "age", F.col("readmitted").eqNullSafe("<30"), domain=AGE_ORDER)


@register("e3_distinct_patients", with_views("SELECT count(DISTINCT patient_nbr) AS n_distinct FROM enc"))
def e3_distinct_patients(spark, sf_dir):
    return E.count_distinct(load_encounters(spark, sf_dir), "patient_nbr")


@register("e4_cohort_kpis", with_views("""
SELECT count(*) AS n_rows, CAST(50 AS BIGINT) AS n_columns, count(DISTINCT patient_nbr) AS n_patients,
       avg(CASE WHEN readmitted = '<30' THEN 1.0 ELSE 0.0 END) AS positive_rate FROM enc"""))
def e4_cohort_kpis(spark, sf_dir):
    raw = load_encounters(spark, sf_dir)
    return E.cohort_kpis(raw, "patient_nbr", F.col("readmitted").eqNullSafe("<30"))


_CORR_COLS = ["time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications",
              "number_outpatient", "number_emergency", "number_inpatient", "number_diagnoses"]


@register("e5_correlation", with_views("""
SELECT feature, correlation FROM c UNPIVOT (correlation FOR feature IN (""" + ", ".join(_CORR_COLS) + "))",
    extra="c AS (SELECT " + ", ".join(f"corr(CAST({c} AS DOUBLE), y) AS {c}" for c in _CORR_COLS)
    + " FROM (SELECT *, CASE WHEN readmitted = '<30' THEN 1.0 ELSE 0.0 END AS y FROM enc))"))
def e5_correlation(spark, sf_dir):
    raw = load_encounters(spark, sf_dir)
    return E.correlate_with(raw, _CORR_COLS, F.col("readmitted").eqNullSafe("<30").cast("int"))


@register("e6_histogram_stay", with_views("""
SELECT b.bin, CAST(1.0 + b.bin AS DOUBLE) AS bin_lo, CAST(2.0 + b.bin AS DOUBLE) AS bin_hi, CAST(coalesce(h.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(14)) b
LEFT JOIN (SELECT CAST(least(floor((time_in_hospital - 1.0) / 1.0), 13) AS INTEGER) AS bin, count(*) AS n
           FROM enc WHERE time_in_hospital >= 1 AND time_in_hospital <= 15 GROUP BY 1) h ON b.bin = h.bin"""))
def e6_histogram_stay(spark, sf_dir):
    return E.histogram(load_encounters(spark, sf_dir), "time_in_hospital", 1.0, 15.0, 14)


@register("e7_class_weights", with_views("""
SELECT readmitted_binary, n_class, n_total / (2.0 * n_class) AS weight,
       CASE WHEN n_pos > 0 THEN n_neg / CAST(n_pos AS DOUBLE) ELSE 1.0 END AS imbalance_ratio
FROM c, t""", "clean", extra="""
c AS (SELECT readmitted_binary, count(*) AS n_class FROM clean GROUP BY 1),
t AS (SELECT sum(n_class) AS n_total, sum(CASE WHEN readmitted_binary = 1 THEN n_class ELSE 0 END) AS n_pos,
             sum(CASE WHEN readmitted_binary = 0 THEN n_class ELSE 0 END) AS n_neg FROM c)"""))
def e7_class_weights(spark, sf_dir):
    return E.class_weights(_clean(spark, sf_dir), "readmitted_binary")


@register("e8_top10_customers", """
SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey ASC LIMIT 10""")
def e8_top10_customers(spark, sf_dir):
    return E.top_n(_t(spark, sf_dir, "customer"), "c_acctbal", 10, tiebreak="c_custkey")


@register("a6_dataset_summary", with_views("""
SELECT count(*) AS n_encounters, CAST(24 AS BIGINT) AS n_features,
       avg(CAST(readmitted_binary AS DOUBLE)) AS positive_rate FROM feat""", "feat"))
def a6_dataset_summary(spark, sf_dir):
    return E.dataset_summary(_feat(spark, sf_dir), "readmitted_binary", FEATURES)


# the other catalog modules register on import
from riskloom.plans import catalog_eval  # noqa: E402,F401
from riskloom.plans import catalog_smote  # noqa: E402,F401
from riskloom.plans import catalog_ml  # noqa: E402,F401
from riskloom.plans import catalog_io  # noqa: E402,F401
from riskloom.plans import catalog_score  # noqa: E402,F401
