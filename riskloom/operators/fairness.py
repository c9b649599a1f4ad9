"""Group fairness audit: per-group metrics in one pass over
the scored table, for several attributes and thresholds at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evaluate import roc_auc
from riskloom.operators.prefix import join_null_safe


def _group_metrics(conf: DataFrame) -> list:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def ratio(a, b):
        return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))

    return [
        n.alias("n"),
        ((tp + fn).cast("double") / n).alias("prevalence"),
        ((tp + fp).cast("double") / n).alias("predicted_positive_rate"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def fairness_audit(df: DataFrame, label: str, score: str, attrs: Sequence[str],
                   thresholds: Sequence[float], min_n: int = 30) -> DataFrame:
    """I4 (+ I1): long form (attribute, grp, threshold, n, prevalence,
    predicted_positive_rate, auc, recall, precision, f1) over all attributes
    and thresholds. Attributes are unpivoted (each row appears once per
    attribute), confusion counts for all thresholds come from one aggregate,
    and groups with fewer than ``min_n`` rows are left out."""
    long = df.select(F.col(label).alias("__y"), F.col(score).alias("__s"),
                     F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("grp"))
                                         for a in attrs])).alias("__a")
                     ).select("__y", "__s", "__a.attribute", "__a.grp")
    keys = ["attribute", "grp"]
    y = F.col("__y") == 1
    aggs = []
    for i, t in enumerate(thresholds):
        p = F.col("__s") >= F.lit(float(t))
        aggs += [F.sum((~p & ~y).cast("long")).alias(f"tn_{i}"), F.sum((p & ~y).cast("long")).alias(f"fp_{i}"),
                 F.sum((~p & y).cast("long")).alias(f"fn_{i}"), F.sum((p & y).cast("long")).alias(f"tp_{i}")]
    wide = long.groupBy(*keys).agg(*aggs)
    conf = wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tn_{i}").alias("tn"), F.col(f"fp_{i}").alias("fp"),
                 F.col(f"fn_{i}").alias("fn"), F.col(f"tp_{i}").alias("tp"))
        for i, t in enumerate(thresholds)])).alias("r")).select(*keys, "r.*")
    auc = roc_auc(long, "__y", "__s", by=keys)
    res = conf.select(*keys, "threshold", *_group_metrics(conf)).filter(F.col("n") >= min_n)
    # a null group is a group: its AUC is found by a null-safe join
    return join_null_safe(res, auc, keys).select(
        *keys, "threshold", "n", "prevalence", "predicted_positive_rate", "auc", "recall", "precision", "f1")


def group_fairness(df: DataFrame, label: str, score: str, attr: str, threshold: float,
                   min_n: int = 30) -> DataFrame:
    """The audit for one attribute at one threshold."""
    return fairness_audit(df, label, score, [attr], [threshold], min_n)


def disparate_impact(groups: DataFrame, by: Sequence[str] = ("attribute", "threshold"),
                     min_n: int = 30) -> DataFrame:
    """Min / max predicted-positive rate over the kept groups; null when
    no group is kept or the max is 0. Also the 0.8 x max line (I3)."""
    kept = groups.filter(F.col("n") >= min_n)
    agg = kept.groupBy(*by).agg(F.min("predicted_positive_rate").alias("__mn"),
                                F.max("predicted_positive_rate").alias("max_rate"))
    di = F.when(F.col("max_rate") > 0, F.col("__mn") / F.col("max_rate"))
    return agg.select(*by, di.alias("disparate_impact_ratio"), "max_rate")


def four_fifths(di: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Pass when the ratio is at least 0.8 (null fails); the reference
    line 0.8 x max rate."""
    return di.select("*", F.coalesce(F.col("disparate_impact_ratio") >= ratio, F.lit(False)).alias("passes"),
                     (F.col("max_rate") * ratio).alias("four_fifths_line"))
