"""Fitted models as SQL expressions.

A logistic model, or an ensemble of small trees, becomes one SQL expression of
its probability over plain columns. The same text is valid in Spark and in
ANSI engines with ``CASE`` and double literals, so a model can be scored where
its rows are: inside a projection (whole-stage codegen, streams included), or
in another database. A null or NaN feature goes right at a split, as it does
in the fitted model.

``ObliviousTrees`` fits an ensemble by aggregates alone: all nodes of a level
share a split at a multiple of the feature's mean, a leaf holds the mean label
of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.explain import TreeArrays, extract_trees

# A nested CASE of more nodes than this is no sensible expression; larger
# ensembles are scored by the fitted model.
MAX_NODES = 5_000


def number(v: float) -> str:
    """A double literal that reads back as the same double in every engine."""
    text = repr(float(v))
    if "inf" in text or "nan" in text:
        return f"CAST('{text}' AS DOUBLE)"
    return text if "e" in text else f"{text}e0"


def _feature(name: str) -> str:
    return f"CAST({name} AS DOUBLE)"


def sigmoid_sql(margin: str) -> str:
    return f"(1e0 / (1e0 + exp(-({margin}))))"


def linear_margin_sql(features: Sequence[str], coef: Sequence[float], intercept: float) -> str:
    """Margin of a linear model; the terms are added in feature order."""
    text = number(intercept)
    for f, w in zip(features, coef, strict=True):
        text = f"({text} + {number(w)} * {_feature(f)})"
    return text


def tree_sql(t: TreeArrays, features: Sequence[str], node: int = 0) -> str:
    """One tree as nested CASE."""
    if t.left[node] < 0:
        return number(t.value[node])
    f = _feature(features[int(t.feature[node])])
    return (f"CASE WHEN {f} <= {number(t.threshold[node])} THEN {tree_sql(t, features, int(t.left[node]))} "
            f"ELSE {tree_sql(t, features, int(t.right[node]))} END")


def trees_sql(trees: Sequence[TreeArrays], weights: Sequence[float], features: Sequence[str]) -> str:
    """The weighted sum of an ensemble's trees."""
    nodes = sum(len(t.left) for t in trees)
    if nodes > MAX_NODES:
        raise ValueError(f"{nodes} nodes: an ensemble of more than {MAX_NODES} is scored by the model itself")
    text = "0e0"
    for t, w in zip(trees, weights, strict=True):
        text = f"({text} + {number(w)} * ({tree_sql(t, features)}))"
    return text


def model_sql(spark, model: PipelineModel, features: Sequence[str]) -> str:
    """SQL of the positive class's probability of a fitted pipeline (assembler
    and a binary logistic, forest or boosted classifier)."""
    est = model.stages[-1]
    kind = type(est).__name__
    if kind == "LogisticRegressionModel":
        return sigmoid_sql(linear_margin_sql(features, est.coefficients, est.intercept))
    if kind == "RandomForestClassificationModel":
        return trees_sql(*extract_trees(spark, est, "forest"), features)
    if kind == "GBTClassificationModel":
        return sigmoid_sql("2e0 * " + trees_sql(*extract_trees(spark, est, "gbt"), features))
    raise TypeError(f"no SQL for {kind}")


def score_sql(df: DataFrame, probability: str, threshold: float = 0.5, prob: str = "prob",
              pred: str = "pred") -> DataFrame:
    """G8 by a compiled expression: probability and label, JVM only."""
    return df.withColumn(prob, F.expr(probability)).withColumn(pred, (F.col(prob) >= F.lit(threshold)).cast("int"))


@dataclass
class SavedLinear:
    """A saved logistic model with its scaler: rows of (feature, mean, sd,
    coefficient) over unscaled features, an intercept and a threshold."""
    terms: Sequence[tuple[str, float, float, float]]
    intercept: float
    threshold: float

    @property
    def features(self) -> list[str]:
        return [t[0] for t in self.terms]

    @property
    def scaler(self) -> dict[str, tuple[float, float]]:
        return {f: (m, s) for f, m, s, _ in self.terms}

    def probability(self) -> str:
        """Over scaled columns."""
        return sigmoid_sql(linear_margin_sql(self.features, [t[3] for t in self.terms], self.intercept))


# ---------------------------------------------------------------- trees fitted by aggregates

@dataclass
class ObliviousTrees:
    """``layouts``: per tree, its levels as (feature, multiple of the mean)."""
    features: Sequence[str]
    layouts: Sequence[Sequence[tuple[str, float]]]

    def fit(self, df: DataFrame, label: str) -> tuple[list[TreeArrays], list[float]]:
        """Trees and equal weights. One aggregate gives the means, one a tree
        its 2^levels leaves, whatever the rows."""
        used = sorted({f for levels in self.layouts for f, _ in levels})
        means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in used]).first()
        return ([self._tree(df, label, levels, means) for levels in self.layouts],
                [1.0 / len(self.layouts)] * len(self.layouts))

    def _tree(self, df: DataFrame, label: str, levels, means) -> TreeArrays:
        cuts = [k * (means[f] or 0.0) for f, k in levels]
        depth = len(levels)

        def right(f: str, cut: float) -> Column:
            return (~F.coalesce(F.col(f).cast("double") <= F.lit(cut), F.lit(False))).cast("int")

        leaf = sum((right(f, cut) * (1 << (depth - 1 - i)) for i, ((f, _), cut) in enumerate(zip(levels, cuts))), F.lit(0))
        found = {r["leaf"]: (r["n"], r["s"]) for r in df.groupBy(leaf.alias("leaf")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("s")).collect()}
        n = np.array([found.get(i, (0, 0))[0] for i in range(1 << depth)], float)
        s = np.array([found.get(i, (0, 0))[1] or 0 for i in range(1 << depth)], float)
        # nodes in breadth-first order: node i of level l is number 2^l - 1 + i
        size, half = (1 << (depth + 1)) - 1, (1 << depth) - 1
        cover = np.concatenate([n.reshape(1 << level, -1).sum(1) for level in range(depth + 1)])
        value = np.concatenate([np.zeros(half), np.divide(s, n, out=np.zeros_like(s), where=n > 0)])
        inner = np.arange(size) < half
        level = np.floor(np.log2(np.arange(size) + 1)).astype(int)
        at = np.minimum(level, depth - 1)
        number_of = {f: i for i, f in enumerate(self.features)}
        return TreeArrays(
            np.where(inner, 2 * np.arange(size) + 1, -1), np.where(inner, 2 * np.arange(size) + 2, -1),
            np.where(inner, np.array([number_of[f] for f, _ in levels])[at], -1),
            np.where(inner, np.array(cuts)[at], 0.0), value, cover)
