"""Registered queries for split, folds, encoding, scaling (F), evaluation
(H), fairness (I) and cost (K). Scores are the deterministic ones of
``plans.hospital`` so that Spark and DuckDB agree exactly; the model-based
runs of the same operators live in ``catalog_ml``."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.clinical import AGE_BIN_EDGES, AGE_BIN_LABELS, bin_right_closed
from riskloom.operators import cost as K
from riskloom.operators import evaluate as Ev
from riskloom.operators import fairness as Fa
from riskloom.operators import prep as P
from riskloom.operators.cohort import melt
from riskloom.operators.features import FEATURES
from riskloom.operators.prefix import global_rank, prefix_sum
from riskloom.plans import hospital as H
from riskloom.plans.oracle import hash_bits_sql, scored_cte, split_cte, with_views
from riskloom.plans.registry import register
from riskloom.session import table_path
from riskloom.sources.encounters import load_encounters

FAIR_THRESHOLDS = [0.5, 0.3]
# --- fixed values: the default cost scenario of the source dashboard, plus a second one ---
SCENARIOS = [("default", 20000.0, 15200.0, 250.0, 0.40), ("large", 50000.0, 12000.0, 400.0, 0.30)]
SCEN_SQL = ("scen AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)" for a, b, c, d, e in SCENARIOS)
    + ") v(scenario_id, annual_volume, readmission_cost, intervention_cost, prevention_rate))")


def ev_sql(select: str, extra: str = "") -> str:
    return with_views(select, "feat", extra=scored_cte() + ("," + extra if extra.strip() else ""))


def conf_sql(t: str, score: str = "score", label: str = "label") -> str:
    return (f"CAST(sum(CASE WHEN NOT ({score} >= {t}) AND {label} <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
            f"CAST(sum(CASE WHEN {score} >= {t} AND {label} <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            f"CAST(sum(CASE WHEN NOT ({score} >= {t}) AND {label} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
            f"CAST(sum(CASE WHEN {score} >= {t} AND {label} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp")


def _r(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END"


METRICS_SQL = (f"{_r('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_r('tp', 'tp + fp')} AS precision, "
               f"{_r('tp', 'tp + fn')} AS recall, {_r('2 * tp', '2 * tp + fp + fn')} AS f1, "
               f"{_r('tn', 'tn + fp')} AS specificity")


def auc_sql(src: str, by: list[str], score: str = "score", label: str = "label", name: str = "a") -> str:
    """CTE text computing exact AUC per ``by`` group of table ``src``."""
    b = ", ".join(by)
    bc = (b + ", ") if by else ""
    part = f"PARTITION BY {b} " if by else ""
    return f"""{name}_c AS (SELECT {bc}{score} AS s, CAST(sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                 CAST(sum(CASE WHEN {label} <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM {src} GROUP BY {bc}{score}),
{name}_cc AS (SELECT *, sum(neg) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
          FROM {name}_c),
{name} AS (SELECT {bc}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
       (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) - sum(CAST(pos AS DOUBLE) * CAST(cum_neg - neg AS DOUBLE))
        - sum(CAST(pos AS DOUBLE) * CAST(neg AS DOUBLE)) * 0.5) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))
       END AS auc FROM {name}_cc {('GROUP BY ' + b) if by else ''})"""


def roc_sql(src: str, by: list[str], name: str = "roc") -> str:
    b = ", ".join(by)
    bc = (b + ", ") if by else ""
    part = f"PARTITION BY {b} " if by else ""
    return f"""{name}_c AS (SELECT {bc}score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                 CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM {src} GROUP BY {bc}score),
{name}_t AS (SELECT {bc}CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM {name}_c
         {('GROUP BY ' + b) if by else ''}),
{name}_cum AS (SELECT {bc}score,
        CAST(sum(pos) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
        CAST(sum(neg) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp
        FROM {name}_c),
{name} AS (
  SELECT {bc.replace(', ', ', ') if not by else ', '.join('x.' + c for c in by) + ', '}CAST(x.score AS DOUBLE) AS threshold, x.tp, x.fp,
         {_r('x.tp', 't.n_pos')} AS tpr, {_r('x.fp', 't.n_neg')} AS fpr, t.n_pos, t.n_neg
  FROM {name}_cum x {'JOIN ' + name + '_t t USING (' + b + ')' if by else 'CROSS JOIN ' + name + '_t t'}
  UNION ALL
  SELECT {bc}'inf'::DOUBLE AS threshold, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, 0.0::DOUBLE AS tpr,
         0.0::DOUBLE AS fpr, n_pos, n_neg FROM {name}_t)"""


def _scored_all(spark, sf_dir):
    return H.scored_all(spark, sf_dir)


def _scored(spark, sf_dir):
    return H.scored_test(spark, sf_dir)


def _docs_scored(spark, sf_dir):
    """labels joined to documents: quality as label, n_chars as score."""
    labels = spark.read.parquet(table_path(sf_dir, "labels"))
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "lang", "source", "n_chars")
    return labels.join(docs, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("label"),
                                               F.col("n_chars").cast("double").alias("score"))


DOCS_SQL = ("docs AS (SELECT l.doc_id, d.lang, d.source, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score "
            "FROM labels l JOIN documents d ON l.doc_id = d.doc_id)")


# ---------------------------------------------------------------- P1

@register("p1_global_rank", ev_sql(
    "SELECT encounter_id, score, CAST(row_number() OVER (ORDER BY score, encounter_id) AS BIGINT) AS rank FROM scored"))
def p1_global_rank(spark, sf_dir):
    return global_rank(_scored(spark, sf_dir).select("encounter_id", "score"), "score", tiebreak=["encounter_id"])


@register("p1_prefix_sum_by_race", ev_sql("""
SELECT encounter_id, race, score, CAST(label AS BIGINT) AS label,
       CAST(sum(label) OVER (PARTITION BY race ORDER BY score DESC, encounter_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_label FROM scored"""))
def p1_prefix_sum_by_race(spark, sf_dir):
    df = _scored(spark, sf_dir).select("encounter_id", "race", "score", F.col("label").cast("long").alias("label"))
    return prefix_sum(df, "score", ["label"], by=["race"], descending=True, tiebreak=["encounter_id"])


def _null_order(spark, sf_dir):
    """Encounters whose raw diag_2 may be missing, as an order key with nulls
    and of type string."""
    return load_encounters(spark, sf_dir).select("encounter_id", "race", F.nullif("diag_2", F.lit("?")).alias("code"))


NULL_ORDER_SQL = "nord AS (SELECT encounter_id, race, nullif(diag_2, '?') AS code FROM enc)"


@register("p1_rank_null_order", with_views(
    "SELECT encounter_id, code, CAST(row_number() OVER (ORDER BY code ASC NULLS FIRST, encounter_id) AS BIGINT) AS rank "
    "FROM nord", extra=NULL_ORDER_SQL))
def p1_rank_null_order(spark, sf_dir):
    """Rank by a string that may be null: nulls come first."""
    return global_rank(_null_order(spark, sf_dir).drop("race"), "code", tiebreak=["encounter_id"])


@register("p1_sum_null_order_desc", with_views(
    "SELECT encounter_id, race, code, CAST(1 AS BIGINT) AS one, CAST(sum(1) OVER (PARTITION BY race ORDER BY code DESC "
    "NULLS LAST, encounter_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_one FROM nord",
    extra=NULL_ORDER_SQL))
def p1_sum_null_order_desc(spark, sf_dir):
    """Running count by a descending key that may be null (nulls last), in
    groups of which one is null."""
    df = _null_order(spark, sf_dir).withColumn("one", F.lit(1).cast("long"))
    return prefix_sum(df, "code", ["one"], by=["race"], descending=True, tiebreak=["encounter_id"])


@register("p1_rank_string_key", """
SELECT text_key, tied, CAST(row_number() OVER (ORDER BY tied, text_key) AS BIGINT) AS rank
FROM (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS text_key,
             CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 1000 END AS tied FROM orders)""")
def p1_rank_string_key(spark, sf_dir):
    """A third of all rows tie on the order key and the tiebreak is a string."""
    orders = spark.read.parquet(table_path(sf_dir, "orders"))
    df = orders.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("text_key"),
                       F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 1000).alias("tied"))
    return global_rank(df, "tied", tiebreak=["text_key"])


# ---------------------------------------------------------------- F1-F4

def _label_rows(spark, sf_dir):
    return H.hospital_features(spark, sf_dir).select(H.KEY, H.LABEL)


@register("f1_split_hash_counts", ev_sql(
    "SELECT is_test, label AS readmitted_binary, count(*) AS n FROM scored_all GROUP BY 1, 2"))
def f1_split_hash_counts(spark, sf_dir):
    """The map-only variant of the split."""
    df = P.stratified_split(H.hospital_features(spark, sf_dir), H.KEY, H.LABEL, exact=False)
    return df.groupBy("is_test", H.LABEL).agg(F.count(F.lit(1)).alias("n"))


@register("f1_split_counts", with_views(
    "SELECT is_test, readmitted_binary, count(*) AS n FROM split GROUP BY 1, 2", "feat", extra=split_cte()))
def f1_split_counts(spark, sf_dir):
    """The split as the pipeline uses it: stratified exactly."""
    df = P.stratified_split(_label_rows(spark, sf_dir), H.KEY, H.LABEL)
    return df.groupBy("is_test", H.LABEL).agg(F.count(F.lit(1)).alias("n"))


@register("f1_split_exact_counts", ev_sql(f"""
SELECT is_test, readmitted_binary, count(*) AS n FROM (
  SELECT readmitted_binary,
         row_number() OVER (PARTITION BY readmitted_binary ORDER BY {hash_bits_sql('encounter_id', 'split42')}, encounter_id)
           <= round(count(*) OVER (PARTITION BY readmitted_binary) * 0.2) AS is_test
  FROM feat) GROUP BY 1, 2"""))
def f1_split_exact_counts(spark, sf_dir):
    df = P.stratified_split(_label_rows(spark, sf_dir), H.KEY, H.LABEL, exact=True)
    return df.groupBy("is_test", H.LABEL).agg(F.count(F.lit(1)).alias("n"))


@register("f2_fold_hash_counts", ev_sql(
    "SELECT fold, label AS readmitted_binary, count(*) AS n FROM scored_all WHERE NOT is_test GROUP BY 1, 2"))
def f2_fold_hash_counts(spark, sf_dir):
    """The map-only variants of split and folds."""
    df = P.stratified_split(H.hospital_features(spark, sf_dir), H.KEY, H.LABEL, exact=False).filter(~F.col("is_test"))
    return (P.assign_folds(df, H.KEY, H.LABEL, exact=False).groupBy("fold", H.LABEL)
            .agg(F.count(F.lit(1)).alias("n")))


@register("f2_fold_counts", with_views(f"""
SELECT fold, readmitted_binary, count(*) AS n FROM (
  SELECT readmitted_binary, CAST((row_number() OVER (PARTITION BY readmitted_binary
         ORDER BY {hash_bits_sql('encounter_id', 'fold42')}, encounter_id) - 1) % 5 AS INTEGER) AS fold
  FROM tr) GROUP BY 1, 2""", "feat", extra=split_cte()))
def f2_fold_counts(spark, sf_dir):
    """Folds of the training rows as cross-validation uses them."""
    df = P.stratified_split(_label_rows(spark, sf_dir), H.KEY, H.LABEL).filter(~F.col("is_test"))
    return P.assign_folds(df, H.KEY, H.LABEL).groupBy("fold", H.LABEL).agg(F.count(F.lit(1)).alias("n"))


@register("f2_fold_exact_counts", ev_sql(f"""
SELECT fold, readmitted_binary, count(*) AS n FROM (
  SELECT readmitted_binary, CAST((row_number() OVER (PARTITION BY readmitted_binary
         ORDER BY {hash_bits_sql('encounter_id', 'fold42')}, encounter_id) - 1) % 5 AS INTEGER) AS fold
  FROM feat WHERE NOT ({hash_bits_sql('encounter_id', 'split42')} < 858993459)) GROUP BY 1, 2"""))
def f2_fold_exact_counts(spark, sf_dir):
    df = P.stratified_split(_label_rows(spark, sf_dir), H.KEY, H.LABEL, exact=False).filter(~F.col("is_test"))
    return P.assign_folds(df, H.KEY, H.LABEL, exact=True).groupBy("fold", H.LABEL).agg(F.count(F.lit(1)).alias("n"))


_TE_COLS = ["medical_specialty", "diag_1_group"]


@register("f3_target_encoding", with_views("""
SELECT s.column, s.value, s.n, p.prior,
       (1.0 - 1.0 / (1.0 + exp(-(s.n - 20) / 1.0))) * p.prior + 1.0 / (1.0 + exp(-(s.n - 20) / 1.0)) * s.mean AS encoding
FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS n, avg(CAST(readmitted_binary AS DOUBLE)) AS mean "
    f"FROM tr GROUP BY {c}" for c in _TE_COLS) + """) s, (SELECT avg(CAST(readmitted_binary AS DOUBLE)) AS prior FROM tr) p""",
    "feat", extra=split_cte()))
def f3_target_encoding(spark, sf_dir):
    df = P.stratified_split(H.hospital_features(spark, sf_dir), H.KEY, H.LABEL, keep=[H.KEY, H.LABEL, *_TE_COLS])
    return P.target_encode_fit(df.filter(~F.col("is_test")), _TE_COLS, H.LABEL)


@register("f3_target_encoding_applied", with_views("""
SELECT t.encounter_id, """ + ", ".join(
    f"coalesce(e{i}.encoding, p.prior) AS {c}" for i, c in enumerate(_TE_COLS)) + " FROM te_f3 t CROSS JOIN p3 p "
    + " ".join(f"LEFT JOIN enc_f3 e{i} ON e{i}.\"column\" = '{c}' AND e{i}.value = t.{c}" for i, c in enumerate(_TE_COLS)),
    "feat", extra=split_cte() + """,
p3 AS (SELECT avg(CAST(readmitted_binary AS DOUBLE)) AS prior FROM tr),
te_f3 AS (SELECT encounter_id, CASE WHEN encounter_id % 50 = 0 THEN 'never seen' ELSE medical_specialty END AS medical_specialty,
                 CASE WHEN encounter_id % 70 = 0 THEN NULL ELSE diag_1_group END AS diag_1_group FROM te),
enc_f3 AS (SELECT s."column", s.value, (1.0 - 1.0 / (1.0 + exp(-(s.n - 20) / 1.0))) * p.prior
                  + 1.0 / (1.0 + exp(-(s.n - 20) / 1.0)) * s.mean AS encoding
           FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n, avg(CAST(readmitted_binary AS DOUBLE)) AS mean "
    f"FROM tr GROUP BY {c}" for c in _TE_COLS) + ") s, p3 p)"))
def f3_target_encoding_applied(spark, sf_dir):
    """F3 fitted on the training rows and applied to the test rows, of which
    some hold an unseen or a missing value."""
    df = P.stratified_split(H.hospital_features(spark, sf_dir).select(H.KEY, H.LABEL, *_TE_COLS), H.KEY, H.LABEL)
    train, test = df.filter(~F.col("is_test")), df.filter("is_test")
    enc = P.target_encode_fit(train, _TE_COLS, H.LABEL)
    prior = train.agg(F.avg(F.col(H.LABEL).cast("double"))).first()[0]
    test = test.withColumns({
        "medical_specialty": F.when(F.col(H.KEY) % 50 == 0, "never seen").otherwise(F.col("medical_specialty")),
        "diag_1_group": F.when(F.col(H.KEY) % 70 != 0, F.col("diag_1_group"))})
    return P.target_encode_apply(test, enc, _TE_COLS, float(prior)).select(H.KEY, *_TE_COLS)


@register("f4_scaled_test", with_views(
    "SELECT t.encounter_id, " + ", ".join(
        f"(CAST(t.{f} AS DOUBLE) - m.m_{f}) / m.s_{f} AS {f}" for f in FEATURES)
    + " FROM te t, m",
    "feat", extra=split_cte() + ","
          "m AS (SELECT " + ", ".join(
              f"avg(CAST({f} AS DOUBLE)) AS m_{f}, CASE WHEN stddev_pop(CAST({f} AS DOUBLE)) > 0 "
              f"THEN stddev_pop(CAST({f} AS DOUBLE)) ELSE 1.0 END AS s_{f}" for f in FEATURES) + " FROM tr)"))
def f4_scaled_test(spark, sf_dir):
    _, test, _ = P.prepare_features(H.hospital_features(spark, sf_dir), H.KEY, H.LABEL, FEATURES)
    return test.select(H.KEY, *FEATURES)


# ---------------------------------------------------------------- H1-H8

@register("h1_confusion_by_race", ev_sql(f"SELECT race, {conf_sql('0.5')} FROM scored GROUP BY race"))
def h1_confusion_by_race(spark, sf_dir):
    return Ev.confusion(_scored(spark, sf_dir), "label", "score", 0.5, by=["race"])


@register("h2_metrics_at_half", ev_sql(
    f"SELECT tn, fp, fn, tp, {METRICS_SQL} FROM (SELECT {conf_sql('0.5')} FROM scored)"))
def h2_metrics_at_half(spark, sf_dir):
    return Ev.classification_metrics(Ev.confusion(_scored(spark, sf_dir), "label", "score", 0.5))


@register("h3_roc_points", ev_sql("SELECT * FROM roc", extra=roc_sql("scored", [])))
def h3_roc_points(spark, sf_dir):
    return Ev.roc_points(_scored(spark, sf_dir), "label", "score")


@register("h3_roc_points_by_age_group", ev_sql("SELECT * FROM roc", extra=roc_sql("scored", ["age_group"])))
def h3_roc_points_by_age_group(spark, sf_dir):
    return Ev.roc_points(_scored(spark, sf_dir), "label", "score", by=["age_group"])


@register("h4_auc", ev_sql("SELECT auc FROM a", extra=auc_sql("scored", [])))
def h4_auc(spark, sf_dir):
    return Ev.roc_auc(_scored(spark, sf_dir), "label", "score")


@register("h4_auc_by_race", ev_sql("SELECT race, auc FROM a", extra=auc_sql("scored", ["race"])))
def h4_auc_by_race(spark, sf_dir):
    return Ev.roc_auc(_scored(spark, sf_dir), "label", "score", by=["race"])


@register("h4_auc_documents_by_lang", "WITH " + DOCS_SQL + ",\n" + auc_sql("docs", ["lang"]) + "\nSELECT lang, auc FROM a")
def h4_auc_documents_by_lang(spark, sf_dir):
    return Ev.roc_auc(_docs_scored(spark, sf_dir), "label", "score", by=["lang"])


def _null_groups(spark, sf_dir):
    """Scored rows with a group column in which two of the races are null."""
    race = F.when(~F.col("race").isin("Asian", "Hispanic"), F.col("race"))
    return _scored(spark, sf_dir).withColumn("race", race)


NULL_GROUPS_SQL = ("ng AS (SELECT encounter_id, label, CASE WHEN race IN ('Asian', 'Hispanic') THEN NULL ELSE race END AS race, "
                   "score FROM scored)")


@register("h4_auc_by_gender_raw", ev_sql("SELECT race, auc FROM a", extra=NULL_GROUPS_SQL + ",\n" + auc_sql("ng", ["race"])))
def h4_auc_by_gender_raw(spark, sf_dir):
    """AUC by a key of which one value is null: a group like any other."""
    return Ev.roc_auc(_null_groups(spark, sf_dir), "label", "score", by=["race"])


@register("h3_roc_points_null_group", ev_sql("""
SELECT c.race, CAST(c.score AS DOUBLE) AS threshold, c.tp, c.fp,
       CASE WHEN t.n_pos > 0 THEN c.tp / t.n_pos::DOUBLE ELSE 0.0 END AS tpr,
       CASE WHEN t.n_neg > 0 THEN c.fp / t.n_neg::DOUBLE ELSE 0.0 END AS fpr, t.n_pos, t.n_neg
FROM roc_cum c JOIN roc_t t ON c.race IS NOT DISTINCT FROM t.race
UNION ALL SELECT race, 'inf'::DOUBLE, 0, 0, 0.0, 0.0, n_pos, n_neg FROM roc_t""",
    extra=NULL_GROUPS_SQL + ",\n" + roc_sql("ng", ["race"])))
def h3_roc_points_null_group(spark, sf_dir):
    return Ev.roc_points(_null_groups(spark, sf_dir), "label", "score", by=["race"])


YOUDEN_SQL = ("yd AS (SELECT threshold, tpr - fpr AS youden_j FROM roc "
              "ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1)")


@register("h5_youden", ev_sql("SELECT threshold, youden_j FROM yd", extra=roc_sql("scored", []) + ",\n" + YOUDEN_SQL))
def h5_youden(spark, sf_dir):
    return Ev.youden_threshold(Ev.roc_points(_scored(spark, sf_dir), "label", "score"))


def _report_sql(t: str) -> str:
    return (f"SELECT CAST({t} AS DOUBLE) AS threshold, tn, fp, fn, tp, round(accuracy, 4) AS accuracy, "
            "round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, "
            f"round(specificity, 4) AS specificity FROM (SELECT tn, fp, fn, tp, {METRICS_SQL} "
            f"FROM (SELECT {conf_sql(t)} FROM scored))")


@register("h6_threshold_report", ev_sql(
    _report_sql("0.5") + " UNION ALL " + _report_sql("(SELECT threshold FROM yd)"),
    extra=roc_sql("scored", []) + ",\n" + YOUDEN_SQL))
def h6_threshold_report(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    best = Ev.youden_threshold(Ev.roc_points(scored, "label", "score")).first()["threshold"]
    return Ev.threshold_report(scored, "label", "score", [0.5, float(best)])


def _fold_metrics(spark, sf_dir):
    """Per scorer and fold: AUC, F1, recall at 0.5 on the training folds."""
    df = _scored_all(spark, sf_dir).filter(~F.col("is_test"))
    long = df.select("fold", "label", F.explode(F.array(
        F.struct(F.lit("rational").alias("model"), F.col("score").alias("s")),
        F.struct(F.lit("alt").alias("model"), F.col("alt_score").alias("s")))).alias("m")
    ).select("fold", "label", "m.model", F.col("m.s").alias("s"))
    auc = Ev.roc_auc(long, "label", "s", by=["model", "fold"])
    met = Ev.classification_metrics(Ev.confusion(long, "label", "s", 0.5, by=["model", "fold"]))
    return met.join(auc, ["model", "fold"]).select("model", "fold", "auc", "f1", "recall")


FOLD_SQL = ("lf AS (SELECT fold, label, 'rational' AS model, score AS s FROM scored_all WHERE NOT is_test "
            "UNION ALL SELECT fold, label, 'alt' AS model, alt_score AS s FROM scored_all WHERE NOT is_test),\n"
            + auc_sql("lf", ["model", "fold"], score="s", name="fa") + ",\n"
            "fm AS (SELECT model, fold, " + _r('2 * tp', '2 * tp + fp + fn') + " AS f1, " + _r('tp', 'tp + fn')
            + " AS recall FROM (SELECT model, fold, " + conf_sql("0.5", score="s") + " FROM lf GROUP BY model, fold)),\n"
            "folds AS (SELECT fm.model, fm.fold, fa.auc, fm.f1, fm.recall FROM fm JOIN fa USING (model, fold))")


@register("h7_cv_summary", ev_sql(
    "SELECT model, avg(auc) AS cv_auc, avg(f1) AS cv_f1, avg(recall) AS cv_recall FROM folds GROUP BY model",
    extra=FOLD_SQL))
def h7_cv_summary(spark, sf_dir):
    return Ev.cv_summary(_fold_metrics(spark, sf_dir))


def _test_rows(spark, sf_dir):
    t = _scored(spark, sf_dir)
    long = t.select("label", F.explode(F.array(
        F.struct(F.lit("rational").alias("model"), F.col("score").alias("s")),
        F.struct(F.lit("alt").alias("model"), F.col("alt_score").alias("s")))).alias("m")
    ).select("label", "m.model", F.col("m.s").alias("s"))
    auc = Ev.roc_auc(long, "label", "s", by=["model"]).withColumnRenamed("auc", "test_auc")
    met = Ev.classification_metrics(Ev.confusion(long, "label", "s", 0.5, by=["model"]))
    return met.join(auc, "model").select(
        "model", "test_auc", F.col("f1").alias("test_f1"), F.col("recall").alias("test_recall"),
        F.col("precision").alias("test_precision"), F.col("specificity").alias("test_specificity"),
        F.col("accuracy").alias("test_accuracy"))


TEST_SQL = ("lt AS (SELECT label, 'rational' AS model, score AS s FROM scored "
            "UNION ALL SELECT label, 'alt' AS model, alt_score AS s FROM scored),\n"
            + auc_sql("lt", ["model"], score="s", name="ta") + ",\n"
            "tm AS (SELECT model, " + METRICS_SQL + " FROM (SELECT model, " + conf_sql("0.5", score="s")
            + " FROM lt GROUP BY model)),\n"
            "tests AS (SELECT tm.model, ta.auc AS test_auc, f1 AS test_f1, recall AS test_recall, precision AS test_precision,"
            " specificity AS test_specificity, accuracy AS test_accuracy FROM tm JOIN ta USING (model))")

COMPARISON_SQL = ("cmp AS (SELECT c.model, c.cv_auc, c.cv_f1, c.cv_recall, t.test_auc, t.test_f1, t.test_recall, "
                  "t.test_precision, t.test_specificity, t.test_accuracy, CASE c.model WHEN 'rational' THEN 0 ELSE 1 END "
                  "AS position FROM (SELECT model, avg(auc) AS cv_auc, avg(f1) AS cv_f1, avg(recall) AS cv_recall "
                  "FROM folds GROUP BY model) c JOIN tests t USING (model) "
                  "UNION ALL SELECT 'rational (tuned)' AS model, c.cv_auc, NULL, NULL, t.test_auc, t.test_f1, t.test_recall, "
                  "t.test_precision, t.test_specificity, t.test_accuracy, 2 AS position FROM "
                  "(SELECT avg(auc) AS cv_auc FROM folds WHERE model = 'rational') c, "
                  "(SELECT * FROM tests WHERE model = 'rational') t)")


def _comparison(spark, sf_dir):
    cv = Ev.cv_summary(_fold_metrics(spark, sf_dir))
    test = _test_rows(spark, sf_dir)
    base = cv.join(test, "model").withColumn(
        "position", F.when(F.col("model") == "rational", 0).otherwise(1))
    tuned = (cv.filter(F.col("model") == "rational").select("model", "cv_auc")
             .join(test, "model")
             .withColumn("model", F.lit("rational (tuned)")).withColumn("position", F.lit(2)))
    return Ev.comparison_table(base, tuned)


@register("h8_comparison_table", ev_sql("SELECT * FROM cmp", extra=FOLD_SQL + ",\n" + TEST_SQL + ",\n" + COMPARISON_SQL))
def h8_comparison_table(spark, sf_dir):
    return _comparison(spark, sf_dir)


@register("g6_pick_best", ev_sql(
    "SELECT * FROM cmp ORDER BY test_auc DESC, position ASC LIMIT 1",
    extra=FOLD_SQL + ",\n" + TEST_SQL + ",\n" + COMPARISON_SQL))
def g6_pick_best(spark, sf_dir):
    return Ev.pick_best(_comparison(spark, sf_dir))


@register("e9_melt_comparison", ev_sql(
    "SELECT model, metric, score FROM (SELECT model, test_auc, test_f1, test_recall, test_precision FROM cmp) "
    "UNPIVOT INCLUDE NULLS (score FOR metric IN (test_auc, test_f1, test_recall, test_precision))",
    extra=FOLD_SQL + ",\n" + TEST_SQL + ",\n" + COMPARISON_SQL))
def e9_melt_comparison(spark, sf_dir):
    return melt(_comparison(spark, sf_dir), ["model"], ["test_auc", "test_f1", "test_recall", "test_precision"])


# ---------------------------------------------------------------- I1-I4

def _audit_sql(src: str, attrs: list[str], thresholds: list[float], min_n: int = 30) -> str:
    longs = " UNION ALL ".join(f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp, label, score FROM {src}"
                               for a in attrs)
    confs = " UNION ALL ".join(
        f"SELECT attribute, grp, CAST({t} AS DOUBLE) AS threshold, {conf_sql(str(t))} FROM al GROUP BY attribute, grp"
        for t in thresholds)
    return (f"al AS ({longs}),\n" + auc_sql("al", ["attribute", "grp"], name="ga") + ",\n"
            f"gc AS ({confs}),\n"
            "audit AS (SELECT gc.attribute, gc.grp, gc.threshold, tn + fp + fn + tp AS n, "
            "CAST(tp + fn AS DOUBLE) / (tn + fp + fn + tp) AS prevalence, "
            "CAST(tp + fp AS DOUBLE) / (tn + fp + fn + tp) AS predicted_positive_rate, ga.auc, "
            f"{_r('tp', 'tp + fn')} AS recall, {_r('tp', 'tp + fp')} AS precision, {_r('2 * tp', '2 * tp + fp + fn')} AS f1 "
            f"FROM gc LEFT JOIN ga USING (attribute, grp) WHERE tn + fp + fn + tp >= {min_n})")


DI_SQL = ("di AS (SELECT attribute, threshold, CASE WHEN max(predicted_positive_rate) > 0 THEN "
          "min(predicted_positive_rate) / max(predicted_positive_rate) END AS disparate_impact_ratio, "
          "max(predicted_positive_rate) AS max_rate FROM audit WHERE n >= 30 GROUP BY attribute, threshold)")


@register("i4_fairness_audit", ev_sql("SELECT * FROM audit",
                                      extra=_audit_sql("scored", ["race", "age_group"], FAIR_THRESHOLDS)))
def i4_fairness_audit(spark, sf_dir):
    return Fa.fairness_audit(_scored(spark, sf_dir), "label", "score", ["race", "age_group"], FAIR_THRESHOLDS)


@register("i1_group_fairness_documents", "WITH " + DOCS_SQL + ",\n" + _audit_sql("docs", ["lang"], [3000.0])
          + "\nSELECT * FROM audit")
def i1_group_fairness_documents(spark, sf_dir):
    return Fa.group_fairness(_docs_scored(spark, sf_dir), "label", "score", "lang", 3000.0)


@register("i1_fairness_null_group", ev_sql("SELECT * REPLACE (ga_null.auc AS auc) FROM audit LEFT JOIN "
    "(SELECT attribute AS a2, grp AS g2, auc FROM ga) ga_null ON a2 = attribute AND g2 IS NOT DISTINCT FROM grp"
    .replace("SELECT * REPLACE (ga_null.auc AS auc)", "SELECT attribute, grp, threshold, n, prevalence, "
             "predicted_positive_rate, ga_null.auc, recall, precision, f1"),
    extra=NULL_GROUPS_SQL + ",\n" + _audit_sql("ng", ["race"], [0.5, 0.3])))
def i1_fairness_null_group(spark, sf_dir):
    """The audit keeps a null group, with its AUC."""
    return Fa.fairness_audit(_null_groups(spark, sf_dir), "label", "score", ["race"], [0.5, 0.3])


@register("i2_disparate_impact", ev_sql(
    "SELECT attribute, threshold, disparate_impact_ratio, max_rate FROM di",
    extra=_audit_sql("scored", ["race", "age_group"], FAIR_THRESHOLDS) + ",\n" + DI_SQL))
def i2_disparate_impact(spark, sf_dir):
    audit = Fa.fairness_audit(_scored(spark, sf_dir), "label", "score", ["race", "age_group"], FAIR_THRESHOLDS)
    return Fa.disparate_impact(audit)


@register("i3_four_fifths", ev_sql(
    "SELECT attribute, threshold, disparate_impact_ratio, max_rate, coalesce(disparate_impact_ratio >= 0.8, false) "
    "AS passes, max_rate * 0.8 AS four_fifths_line FROM di",
    extra=_audit_sql("scored", ["race", "age_group"], FAIR_THRESHOLDS) + ",\n" + DI_SQL))
def i3_four_fifths(spark, sf_dir):
    audit = Fa.fairness_audit(_scored(spark, sf_dir), "label", "score", ["race", "age_group"], FAIR_THRESHOLDS)
    return Fa.four_fifths(Fa.disparate_impact(audit))


@register("d10_age_group_counts", ev_sql("SELECT age_group, count(*) AS n FROM scored_all GROUP BY 1"))
def d10_age_group_counts(spark, sf_dir):
    df = H.hospital_features(spark, sf_dir)
    return (df.select(bin_right_closed("age_numeric", AGE_BIN_EDGES, AGE_BIN_LABELS).alias("age_group"))
            .groupBy("age_group").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- K1-K3

def _conf_points(scored):
    rep = Ev.threshold_report(scored, "label", "score", FAIR_THRESHOLDS)
    return rep.select("threshold", "tn", "fp", "fn", "tp")


CONF_POINTS_SQL = ("cp AS (" + " UNION ALL ".join(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, {conf_sql(str(t))} FROM scored" for t in FAIR_THRESHOLDS) + ")")


def _money_sql(tp: str, fp: str) -> tuple[str, str, str, str]:
    sav = f"({tp}) * prevention_rate * readmission_cost"
    cos = f"(({tp}) + ({fp})) * intervention_cost"
    net = f"({sav} - {cos})"
    roi = f"CASE WHEN {cos} > 0 THEN {net} / ({cos}) * 100.0 ELSE 0.0 END"
    return sav, cos, net, roi


_K1_TP = "tp * (annual_volume / (tn + fp + fn + tp))"
_K1_FP = "fp * (annual_volume / (tn + fp + fn + tp))"
_s, _c, _n, _roi = _money_sql(_K1_TP, _K1_FP)


@register("k1_cost_benefit", ev_sql(
    f"SELECT threshold, tn, fp, fn, tp, scenario_id, {_s} AS savings, {_c} AS costs, {_n} AS net_benefit, "
    f"{_roi} AS roi_pct, CAST(floor(({_K1_TP}) * prevention_rate) AS BIGINT) AS prevented, "
    f"CAST(floor(({_K1_TP}) + ({_K1_FP})) AS BIGINT) AS flagged FROM cp CROSS JOIN scen",
    extra=CONF_POINTS_SQL + ",\n" + SCEN_SQL))
def k1_cost_benefit(spark, sf_dir):
    return K.cost_benefit(_conf_points(_scored(spark, sf_dir)), K.scenarios(spark, SCENARIOS))


_K2_TP = "tp * (annual_volume / (n_pos + n_neg))"
_K2_FP = "fp * (annual_volume / (n_pos + n_neg))"
_s2, _c2, _n2, _roi2 = _money_sql(_K2_TP, _K2_FP)


@register("k2_cost_curve", ev_sql(
    f"SELECT scenario_id, threshold, tpr, fpr, {_n2} AS net_benefit, {_roi2} AS roi_pct FROM roc CROSS JOIN scen",
    extra=roc_sql("scored", []) + ",\n" + SCEN_SQL))
def k2_cost_curve(spark, sf_dir):
    return K.cost_curve(Ev.roc_points(_scored(spark, sf_dir), "label", "score"), K.scenarios(spark, SCENARIOS))


@register("k3_strategy_table", ev_sql(
    "SELECT scenario_id, 'none' AS strategy, 0.0::DOUBLE AS flagged, 0.0::DOUBLE AS caught, 0.0::DOUBLE AS costs, "
    "0.0::DOUBLE AS savings, 0.0::DOUBLE AS net_benefit, NULL::DOUBLE AS roi_pct FROM m "
    "UNION ALL SELECT scenario_id, 'everyone', annual_volume, ec, annual_volume * intervention_cost, "
    "ec * prevention_rate * readmission_cost, ec * prevention_rate * readmission_cost - annual_volume * intervention_cost, "
    "CASE WHEN annual_volume * intervention_cost > 0 THEN (ec * prevention_rate * readmission_cost - annual_volume * "
    "intervention_cost) / (annual_volume * intervention_cost) * 100.0 ELSE 0.0 END FROM m "
    f"UNION ALL SELECT scenario_id, 'model', CAST(floor(({_K1_TP}) + ({_K1_FP})) AS DOUBLE), {_K1_TP}, {_c}, {_s}, "
    f"{_n}, {_roi} FROM m",
    extra="cp AS (SELECT " + conf_sql("0.3") + " FROM scored),\n" + SCEN_SQL
          + ",\nm AS (SELECT *, CAST(tp + fn AS DOUBLE) / (tn + fp + fn + tp) * annual_volume AS ec FROM cp CROSS JOIN scen)"))
def k3_strategy_table(spark, sf_dir):
    conf = Ev.confusion(_scored(spark, sf_dir), "label", "score", 0.3)
    return K.strategy_table(conf, K.scenarios(spark, SCENARIOS))
