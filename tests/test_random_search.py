"""The random search: a resumable trial table, undefined folds, the winner."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators import train as G

SPACE = {"C": (1e-3, 10.0, "log")}


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.range(240).select(
        F.col("id"), ((F.col("id") * 7) % 13).cast("double").alias("a"), ((F.col("id") * 3) % 5).cast("double").alias("b"))
    df = df.withColumn("y", ((F.col("a") + F.col("b")) > 9).cast("int"))
    return df.filter("id < 180"), df.filter("id >= 180")


def search(tables, table=None, n=3, folds=None, **params):
    return G.random_search(*tables, "id", "y", ["a", "b"], G.base_models()["logreg"], SPACE, n, k=2, table=table,
                           parallelism=2, folds=folds, **params)


def test_a_search_that_was_ended_goes_on(spark, tables, tmp_path, monkeypatch):
    table, fitted = str(tmp_path / "trials"), []
    real = G.fit_model

    def counted(*args, **kwargs):
        if len(fitted) == 3 and counted.fail:
            raise RuntimeError("ended")
        fitted.append(kwargs.get("params"))
        return real(*args, **kwargs)

    counted.fail = True
    monkeypatch.setattr(G, "fit_model", counted)
    with pytest.raises(RuntimeError):
        search(tables, table)
    before = G.read_trials(spark, table).count()
    assert 0 < before <= 3
    counted.fail, at = False, len(fitted)
    found = search(tables, table)
    assert len(fitted) - at == 3 * 2 - before + 1  # the folds that were missing, and the final fit
    rows = G.read_trials(spark, table).collect()
    assert len(rows) == 6 and {(r["trial"], r["fold"]) for r in rows} == {(i, f) for i in range(3) for f in range(2)}
    fresh = search(tables)
    assert (found.best_trial, found.best) == (fresh.best_trial, fresh.best)
    assert found.best_auc == pytest.approx(fresh.best_auc) and len(found.trials) == 3
    means = {i: sum(r["auc"] for r in rows if r["trial"] == i) / 2 for i in range(3)}
    assert found.best_auc == pytest.approx(max(means.values()))


def test_a_longer_search_keeps_its_first_trials(spark, tables, tmp_path):
    table = str(tmp_path / "trials")
    short = search(tables, table, n=2)
    longer = search(tables, table, n=3)
    assert longer.trials[:2] == short.trials and G.read_trials(spark, table).count() == 6


def test_another_search_is_refused(spark, tables, tmp_path):
    table = str(tmp_path / "trials")
    search(tables, table, n=1)
    with pytest.raises(ValueError, match="another search"):
        search(tables, table, n=1, seed=7)


def test_undefined_folds_do_not_win(spark, tables):
    train, test = tables
    one_class = train.filter("y = 0")
    folds = ({f: train for f in range(2)}, {0: one_class, 1: train}, train)
    with pytest.raises(ValueError, match="no trial"):
        search((train, test), folds=folds)


def test_missing_table_reads_as_empty(spark, tmp_path):
    assert G.read_trials(spark, str(tmp_path / "none")).count() == 0


def test_held_out_rows_end_the_rounds(spark, tables):
    spec = G.base_models()["gbt6"]
    m = G.fit_model(spec, tables[0], "id", "y", ["a", "b"], params={"maxIter": 40, "maxDepth": 2, "held_out": 0.3})
    assert 1 <= m.stages[-1].getNumTrees < 40


def test_min_samples_split_bounds_the_children():
    assert G._min_instances({}) == 1
    assert G._min_instances({"min_samples_split": 20, "minInstancesPerNode": 3}) == 10


def test_boosted_fits_keep_no_node_ids(spark, tables):
    """They cost a pass a level; without them the trees are the same."""
    models = G.base_models(fast=True)
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(tables[0].withColumn("__w", F.lit(1.0)))
    for name in ("gbt6", "gbt8"):
        est = models[name].make({"maxIter": 3}).setFeaturesCol("features").setLabelCol("y")
        assert not est.getCacheNodeIds()
        one, two = (e.fit(data.coalesce(1)).toDebugString.split("\n", 1)[1] for e in (est, est.copy({est.cacheNodeIds: True})))
        assert one == two
    assert models["forest"].make({}).getCacheNodeIds()


def test_a_fold_is_laid_out_once(spark, tables, monkeypatch):
    calls = []
    real = G.fit_layout
    monkeypatch.setattr(G, "fit_layout", lambda *a, **kw: calls.append(1) or real(*a, **kw))
    search(tables, n=4)
    assert len(calls) == 2 + 1  # two folds, and the final fit


def test_a_laid_out_table_gives_the_same_model(spark, tables):
    models = G.base_models(fast=True)
    for name in ("logreg", "forest", "gbt6"):
        args = (models[name], tables[0], "id", "y", ["a", "b"])
        laid = G.lay_out(tables[0], "id", "y", ["a", "b"], models[name].weighting)
        one, two = G.fit_model(*args), G.fit_model(*args, laid=laid)
        got = [[(r["id"], r["prob"]) for r in G.score(m, tables[1]).orderBy("id").collect()] for m in (one, two)]
        assert got[0] == got[1] and len(got[0]) == 60
