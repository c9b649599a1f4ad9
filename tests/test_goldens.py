"""Golden values derived from the published result files (FIXTURES.md F5)."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import cost as K
from riskloom.operators import evaluate as Ev
from riskloom.operators import fairness as Fa


def _conf(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")


def test_metrics_tuned_model_at_half(spark):
    r = Ev.classification_metrics(_conf(spark, 17588, 18, 2232, 31)).first()
    assert r["accuracy"] == pytest.approx(0.8867582666, abs=1e-9)
    assert r["recall"] == pytest.approx(0.0136986301, abs=1e-9)
    assert r["precision"] == pytest.approx(0.6326530612, abs=1e-9)
    assert r["specificity"] == pytest.approx(0.9989776213, abs=1e-9)
    assert r["f1"] == pytest.approx(0.0268166090, abs=1e-9)


def test_metrics_at_youden(spark):
    r = Ev.classification_metrics(_conf(spark, 12888, 4718, 1230, 1033)).first()
    assert round(r["recall"], 4) == 0.4565
    assert round(r["precision"], 4) == 0.1796
    assert round(r["f1"], 4) == 0.2578
    assert round(r["specificity"], 4) == 0.732


def test_metrics_zero_divisor(spark):
    r = Ev.classification_metrics(_conf(spark, 10, 0, 0, 0)).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0 and r["specificity"] == 1.0


def test_cost_benefit_golden(spark):
    scen = K.scenarios(spark, [("s", 20000.0, 15200.0, 250.0, 0.40)])
    r = K.cost_benefit(_conf(spark, 12888, 4718, 1230, 1033), scen).first()
    assert r["savings"] == pytest.approx(6322049.42, abs=0.01)
    assert r["costs"] == pytest.approx(1447229.35, abs=0.01)
    assert r["net_benefit"] == pytest.approx(4874820.07, abs=0.01)
    assert r["roi_pct"] == pytest.approx(336.838, abs=1e-3)
    assert r["prevented"] == 415 and r["flagged"] == 5788


def test_strategy_everyone_golden(spark):
    scen = K.scenarios(spark, [("s", 20000.0, 15200.0, 250.0, 0.40)])
    rows = {r["strategy"]: r for r in K.strategy_table(_conf(spark, 12888, 4718, 1230, 1033), scen).collect()}
    e = rows["everyone"]
    assert e["caught"] == pytest.approx(2277.92, abs=0.01)
    assert e["savings"] == pytest.approx(13849755.90, abs=0.01)
    assert e["costs"] == pytest.approx(5000000.0)
    assert e["net_benefit"] == pytest.approx(8849755.90, abs=0.01)
    assert e["roi_pct"] == pytest.approx(176.995, abs=1e-3)
    assert rows["none"]["flagged"] == 0.0 and rows["none"]["roi_pct"] is None
    assert rows["model"]["costs"] == pytest.approx(1447229.35, abs=0.01)


def test_disparate_impact_published_rates(spark):
    # published group sizes and predicted-positive rates at threshold 0.5
    rows = [("race", 0.5, "AfricanAmerican", 3809, 0.002887897085849304), ("race", 0.5, "Asian", 128, 0.0078125),
            ("race", 0.5, "Caucasian", 14743, 0.002509665604015465), ("race", 0.5, "Hispanic", 410, 0.0),
            ("race", 0.5, "Other", 304, 0.0), ("race", 0.5, "Unknown", 475, 0.0),
            ("age", 0.5, "40-60", 5321, 0.003946626573952265), ("age", 0.5, "60-75", 9523, 0.0011550981833455844),
            ("age", 0.5, "75+", 3785, 0.0), ("age", 0.5, "<40", 1240, 0.013709677419354839)]
    groups = spark.createDataFrame(rows, "attribute string, threshold double, grp string, n long, "
                                         "predicted_positive_rate double")
    got = {r["attribute"]: r for r in Fa.four_fifths(Fa.disparate_impact(groups)).collect()}
    assert got["race"]["disparate_impact_ratio"] == 0.0 and got["age"]["disparate_impact_ratio"] == 0.0
    assert got["race"]["passes"] is False and got["age"]["passes"] is False
    assert got["age"]["four_fifths_line"] == pytest.approx(0.8 * 0.013709677419354839)


def test_disparate_impact_all_zero_is_null(spark):
    groups = spark.createDataFrame([("a", 0.5, "x", 50, 0.0), ("a", 0.5, "y", 60, 0.0)],
                                   "attribute string, threshold double, grp string, n long, "
                                   "predicted_positive_rate double")
    r = Fa.four_fifths(Fa.disparate_impact(groups)).first()
    assert r["disparate_impact_ratio"] is None and r["passes"] is False


def test_pick_best_is_published_winner(spark):
    rows = [("Logistic Regression", 0, 0.6271403027198829), ("Random Forest", 1, 0.6155971664141131),
            ("XGBoost", 2, 0.6183462367632776), ("LightGBM", 3, 0.6275707991124425)]
    df = spark.createDataFrame(rows, "model string, position int, test_auc double")
    assert Ev.pick_best(df).first()["model"] == "LightGBM"


def test_pick_best_tie_first_wins(spark):
    df = spark.createDataFrame([("a", 0, 0.7), ("b", 1, 0.7)], "model string, position int, test_auc double")
    assert Ev.pick_best(df).first()["model"] == "a"
    assert F is not None
