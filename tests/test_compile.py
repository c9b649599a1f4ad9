"""Compiled models: the SQL text against the fitted model, in Spark and in DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators import train as G
from riskloom.operators.compile import MAX_NODES, ObliviousTrees, model_sql, number, trees_sql
from riskloom.operators.explain import TreeArrays, path_attribution, leaf_paths, expected_value

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(500).select(
        F.col("id"), (F.col("id") % 7).cast("double").alias("a"), ((F.col("id") * 13) % 11 / 3).alias("b"),
        ((F.col("id") * 5) % 3).cast("double").alias("c"))
    return df.withColumn("y", ((F.col("a") + F.col("b") > 5) | (F.col("c") == 2)).cast("double"))


@pytest.mark.parametrize("make", [
    lambda: LogisticRegression(maxIter=30), lambda: RandomForestClassifier(numTrees=6, maxDepth=4, seed=1),
    lambda: GBTClassifier(maxIter=6, maxDepth=3, seed=1)], ids=["logreg", "forest", "gbt"])
def test_compiled_equals_the_model(spark, rows, make):
    est = make()
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"),
                             est.setLabelCol("y")]).fit(rows)
    sql = model_sql(spark, model, FEATURES)
    odd = spark.createDataFrame([(1000, None, 1.0, 2.0), (1001, 3.0, float("nan"), 0.0)], "id long, a double, b double, c double")
    if not isinstance(est, LogisticRegression):  # a linear score of a missing value is no number in either
        rows = rows.drop("y").unionByName(odd)
    rows = rows.select("id", *FEATURES)
    want = {r["id"]: r["prob"] for r in G.score(model, rows).collect()}
    got = {r["id"]: (r["prob"], r["pred"]) for r in G.score(sql, rows).collect()}
    con = duckdb.connect()
    con.register("t", rows.toPandas())
    duck = dict(con.execute(f"SELECT id, {sql} FROM t").fetchall())
    for i, p in want.items():
        assert got[i][0] == pytest.approx(p, abs=1e-12) and got[i][1] == (p >= 0.5)
        if i != 1000:  # pandas turns the null into a NaN, which sorts the same way
            assert duck[i] == pytest.approx(p, abs=1e-12)


def test_compiled_scoring_needs_no_python(spark, rows):
    plan = G.score("1e0 / (1e0 + exp(-(a + b)))", rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbers_read_back():
    for v in (0.1, 1e-300, -2.5, 1 / 3, 12345678901234567.0, 0.0):
        assert duckdb.connect().execute(f"SELECT {number(v)}").fetchall() == [(v,)]


def test_large_ensembles_are_refused():
    t = TreeArrays(*[np.full(MAX_NODES, -1)] * 3, *[np.zeros(MAX_NODES)] * 3)
    with pytest.raises(ValueError):
        trees_sql([t, t], [1.0, 1.0], FEATURES)


def test_oblivious_trees(spark, rows):
    fit = ObliviousTrees(FEATURES, [[("a", 1.0), ("b", 1.0)], [("c", 0.5), ("a", 1.0), ("a", 0.5)]])
    trees, weights = fit.fit(rows, "y")
    pdf = rows.toPandas()
    mean = pdf[FEATURES].mean()
    first = pdf.groupby([pdf.a > mean.a, pdf.b > mean.b]).y.mean()
    scored = rows.select("id", F.expr(trees_sql(trees[:1], [1.0], FEATURES)).alias("p")).toPandas().set_index("id").p
    for r in pdf.itertuples():
        assert scored[r.id] == pytest.approx(first[(r.a > mean.a, r.b > mean.b)])
    # a path without rows has no cover: the attribution still adds up
    x = pdf[FEATURES].to_numpy()[:50]
    both = rows.orderBy("id").limit(50).select(F.expr(trees_sql(trees, weights, FEATURES)).alias("p")).toPandas().p
    phi = path_attribution(x, leaf_paths(trees, weights))
    assert np.allclose(phi.sum(1) + expected_value(trees, weights), both)


def test_oblivious_trees_of_an_empty_table(spark, rows):
    trees, _ = ObliviousTrees(FEATURES, [[("a", 1.0)]]).fit(rows.limit(0), "y")
    assert list(trees[0].cover) == [0, 0, 0] and list(trees[0].value) == [0, 0, 0]
