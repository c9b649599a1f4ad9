"""Registered queries of compiled models (G8, G9, G1-G4 as SQL) and of tree
attribution by value (J3): a saved logistic model, and an ensemble that
aggregates alone fit, so DuckDB can rebuild both from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.clinical import AGE_BIN_EDGES, AGE_BIN_LABELS, bin_right_closed
from riskloom.operators import explain as J
from riskloom.operators import prep as P
from riskloom.operators import train as G
from riskloom.operators.features import FEATURES
from riskloom.operators.compile import ObliviousTrees, SavedLinear, trees_sql
from riskloom.plans import hospital as H
from riskloom.plans.oracle import AGE_GROUP_SQL, split_cte, with_views
from riskloom.plans.registry import register

# --- fixed values: a saved logistic model, as fitted by g1 on the sf0.01 tables (six digits) ---
# feature, mean and sd of the training rows, coefficient on the scaled feature
SAVED = SavedLinear([
    ("time_in_hospital", 7.40063, 4.07932, 0.106331),
    ("num_lab_procedures", 66.2327, 38.0534, 0.0455713),
    ("num_procedures", 2.99302, 2.01008, -0.0397034),
    ("num_medications", 40.6345, 23.3105, -0.0127745),
    ("number_outpatient", 0.70443, 1.42049, -0.741117),
    ("number_emergency", 0.199694, 0.677017, -0.432738),
    ("number_inpatient", 0.842503, 1.46932, 0.886124),
    ("number_diagnoses", 4.9977, 1.98285, 0.00955967),
    ("num_active_medications", 4.44359, 1.39656, -0.790908),
    ("medication_change_count", 3.29729, 1.64729, 0.540878),
    ("has_insulin", 0.749115, 0.433523, 0.295026),
    ("insulin_changed", 0.50244, 0.499994, -0.147185),
    ("total_visits_prior", 1.74663, 2.17045, 0.293043),
    ("high_utilizer", 0.33059, 0.470426, -0.191556),
    ("diabetes_primary", 0.112716, 0.316246, -0.0629672),
    ("num_comorbidities", 2.77973, 0.429171, 0.088646),
    ("long_stay", 0.489714, 0.499894, -0.121969),
    ("emergency_admission", 0.12573, 0.331544, -0.0811285),
    ("age_numeric", 50.1909, 28.5357, -0.0132319),
    ("med_changed", 0.501292, 0.499998, 0.797876),
    ("on_diabetes_med", 0.753325, 0.431076, -0.442377),
    ("a1c_ordinal", 0.59889, 1.01828, -0.915117),
    ("glu_ordinal", 0.297388, 0.777871, 0.918298),
    ("gender_male", 0.493254, 0.499954, -0.284335),
], intercept=-0.530692, threshold=0.441645)

SAVED_SQL = "saved AS (SELECT *, 1::DOUBLE / (1::DOUBLE + exp(-(" + f"{SAVED.intercept}::DOUBLE" + "".join(
    f" + ({w}::DOUBLE) * (({f}::DOUBLE - {m}::DOUBLE) / {s}::DOUBLE)" for f, m, s, w in SAVED.terms) + "))) AS prob FROM te)"


def saved_sql(select: str) -> str:
    return with_views(select, "feat", extra=split_cte() + ",\n" + SAVED_SQL)


def _split_rows(spark, sf_dir):
    """Unscaled rows of the exact split: training and test."""
    split = P.stratified_split(H.hospital_features(spark, sf_dir), H.KEY, H.LABEL, exact=True,
                               keep=[H.KEY, H.LABEL, "race", "gender", *FEATURES])
    return split.filter(~F.col("is_test")), split.filter(F.col("is_test"))


def _test_rows(spark, sf_dir):
    return _split_rows(spark, sf_dir)[1]


def _saved_scores(spark, sf_dir):
    return G.score(SAVED.probability(), P.scale_apply(_test_rows(spark, sf_dir), SAVED.scaler))


@register("g8_saved_model_scores", saved_sql(
    f"SELECT encounter_id, readmitted_binary, race, gender, {AGE_GROUP_SQL} AS age_group, prob, "
    "CAST(prob >= 0.5 AS INTEGER) AS pred FROM saved"))
def g8_saved_model_scores(spark, sf_dir):
    """G8 with a saved logistic model compiled to SQL: every test row."""
    d = _test_rows(spark, sf_dir).withColumn(
        "age_group", bin_right_closed("age_numeric", AGE_BIN_EDGES, AGE_BIN_LABELS))
    scored = G.score(SAVED.probability(), P.scale_apply(d, SAVED.scaler))
    return scored.select(H.KEY, H.LABEL, "race", "gender", "age_group", "prob", "pred")


@register("g9_saved_model_screen", saved_sql(
    f"SELECT encounter_id, prob, prob >= {SAVED.threshold}::DOUBLE AS flagged, "
    f"CASE WHEN prob >= {SAVED.threshold}::DOUBLE THEN 'High' WHEN prob >= {0.6 * SAVED.threshold!r}::DOUBLE THEN 'Medium' "
    "ELSE 'Low' END AS band FROM saved"))
def g9_saved_model_screen(spark, sf_dir):
    """G9 with the saved model: align, scale, score, flag and band."""
    return G.screen(_test_rows(spark, sf_dir), SAVED.probability(), SAVED.scaler, SAVED.features, SAVED.threshold,
                    keep=[H.KEY])


@register("g1_saved_model_metrics", saved_sql("""
SELECT race, tn, fp, fn, tp, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
       CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
       CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0.0 END AS specificity, auc
FROM (SELECT race, CAST(sum(CASE WHEN prob < 0.5 AND readmitted_binary = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN prob >= 0.5 AND readmitted_binary = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN prob < 0.5 AND readmitted_binary = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN prob >= 0.5 AND readmitted_binary = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
      FROM saved GROUP BY race)
JOIN (SELECT race, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                   THEN CAST(sum(pos * (below + 0.5::DOUBLE * neg)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc
      FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY race ORDER BY prob
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
            FROM (SELECT race, prob, count(*) FILTER (readmitted_binary = 1) AS pos,
                         count(*) FILTER (readmitted_binary <> 1) AS neg FROM saved GROUP BY race, prob))
      GROUP BY race) USING (race)"""))
def g1_saved_model_metrics(spark, sf_dir):
    """H1, H2, H4 of the saved model's scores on the test rows, by race."""
    return G.evaluate_scored(_saved_scores(spark, sf_dir), H.LABEL, by=["race"])


# ---------------------------------------------------------------- trees fitted by aggregates

TREE_FEATURES = ["time_in_hospital", "num_medications", "number_inpatient", "num_lab_procedures", "age_numeric"]
# levels of each tree as (feature, multiple of its mean); features come twice
LAYOUTS = [[("time_in_hospital", 1.0), ("num_medications", 1.0), ("number_inpatient", 1.0)],
           [("num_medications", 1.0), ("num_lab_procedures", 1.0), ("num_medications", 0.5)],
           [("age_numeric", 1.0), ("time_in_hospital", 1.5), ("age_numeric", 0.5)]]
ENSEMBLE = ObliviousTrees(TREE_FEATURES, LAYOUTS)


def _bit_sql(f: str, k: float) -> str:
    return f"CASE WHEN {f}::DOUBLE <= {k}::DOUBLE * mu_{f} THEN 0 ELSE 1 END"


def _trees_cte() -> str:
    """``mu``: means; ``gN``: leaves of tree N with their ratios on the way;
    ``tb``: test rows with their bits in every tree."""
    mu = "mu AS (SELECT " + ", ".join(f"avg({f}::DOUBLE) AS mu_{f}" for f in TREE_FEATURES) + " FROM tr)"
    parts = [mu]
    for n, levels in enumerate(LAYOUTS):
        bits = ", ".join(f"{_bit_sql(f, k)} AS b{i}" for i, (f, k) in enumerate(levels))
        parts.append(f"""r{n} AS (SELECT readmitted_binary, {bits} FROM tr, mu),
g{n} AS (
  SELECT b0, b1, b2, n, CASE WHEN n > 0 THEN s / n ELSE 0 END AS v,
         sum(n) OVER (PARTITION BY b0) / sum(n) OVER () AS q0,
         sum(n) OVER (PARTITION BY b0, b1) / greatest(sum(n) OVER (PARTITION BY b0), 1e-300) AS q1,
         n / greatest(sum(n) OVER (PARTITION BY b0, b1), 1e-300) AS q2
  FROM (SELECT a.b0, a.b1, a.b2, count(readmitted_binary)::DOUBLE AS n, coalesce(sum(readmitted_binary), 0)::DOUBLE AS s
        FROM (SELECT x AS b0, y AS b1, z AS b2 FROM range(2) i(x), range(2) j(y), range(2) k(z)) a
        LEFT JOIN r{n} USING (b0, b1, b2) GROUP BY ALL))""")
    rows = ", ".join(f"{_bit_sql(f, k)} AS t{n}_{i}" for n, levels in enumerate(LAYOUTS) for i, (f, k) in enumerate(levels))
    parts.append(f"tb AS (SELECT te.*, {rows} FROM te, mu)")
    return ",\n".join([split_cte(), *parts])


@register("g2_oblivious_tree_scores", with_views(
    "SELECT encounter_id, ((0::DOUBLE + w * g0.v) + w * g1.v) + w * g2.v AS prob FROM "
    f"(SELECT *, 1::DOUBLE / {len(LAYOUTS)} AS w FROM tb) t "
    + " ".join(f"JOIN g{n} ON g{n}.b0 = t{n}_0 AND g{n}.b1 = t{n}_1 AND g{n}.b2 = t{n}_2" for n in range(len(LAYOUTS))),
    "feat", extra=_trees_cte()))
def g2_oblivious_tree_scores(spark, sf_dir):
    """Trees fitted by aggregates on the training rows, compiled to SQL and
    scored on every test row."""
    train, test = _split_rows(spark, sf_dir)
    trees, weights = ENSEMBLE.fit(train, H.LABEL)
    return test.select(H.KEY, F.expr(trees_sql(trees, weights, TREE_FEATURES)).alias("prob"))


def _coalition_sql() -> str:
    """Shapley values over all 32 coalitions of the five features, from the
    conditional expectations of every leaf."""
    index = {f: i for i, f in enumerate(TREE_FEATURES)}
    expected = []
    for n, levels in enumerate(LAYOUTS):
        ways = " * ".join(f"CASE WHEN (s >> {index[f]}) & 1 = 1 THEN (b{i} = t{n}_{i})::INTEGER::DOUBLE ELSE q{i} END"
                          for i, (f, _) in enumerate(levels))
        expected.append(f"SELECT encounter_id, s, sum(v * {ways}) / {len(LAYOUTS)} AS e FROM tb, subsets, g{n} GROUP BY ALL")
    weight = " ".join(f"WHEN {s} THEN {w}" for s, w in enumerate(("1 / 5.0", "1 / 20.0", "1 / 30.0", "1 / 20.0", "1 / 5.0")))
    names = " ".join(f"WHEN {i} THEN '{f}'" for f, i in index.items())
    values = " ".join(f"WHEN {i} THEN tb.{f}::DOUBLE" for f, i in index.items())
    return with_views(f"""
SELECT tb.encounter_id AS row_id, CASE f {names} END AS feature, CASE f {values} END AS value,
       round(phi, 9) + 0.0::DOUBLE AS phi, round(base, 9) AS base_value
FROM (SELECT a.encounter_id, f, sum((b.e - a.e) * CASE bit_count(a.s) {weight} END) AS phi
      FROM whole a JOIN range(5) r(f) ON (a.s >> f) & 1 = 0
      JOIN whole b ON b.encounter_id = a.encounter_id AND b.s = a.s + (1 << f) GROUP BY ALL) p
JOIN tb USING (encounter_id) JOIN (SELECT encounter_id, e AS base FROM whole WHERE s = 0) USING (encounter_id)""",
                      "feat", extra=_trees_cte() + ",\nsubsets AS (SELECT range::INTEGER AS s FROM range(32)),\n"
                      "parts AS (" + " UNION ALL ".join(expected) + "),\n"
                      "whole AS (SELECT encounter_id, s, sum(e) AS e FROM parts GROUP BY ALL)")


@register("j3_tree_shap_coalitions", _coalition_sql())
def j3_tree_shap_coalitions(spark, sf_dir):
    """J3 by value: the leaf-path attribution of five features for every test
    row, which the SQL computes over all coalitions."""
    train, test = _split_rows(spark, sf_dir)
    trees, weights = ENSEMBLE.fit(train, H.LABEL)
    shap = J.tree_attribution(test, H.KEY, TREE_FEATURES, trees, weights)
    base = J.expected_value(trees, weights)
    return shap.select("row_id", "feature", "value", (F.round("phi", 9) + F.lit(0.0)).alias("phi"),
                       F.round(F.lit(base), 9).alias("base_value"))
