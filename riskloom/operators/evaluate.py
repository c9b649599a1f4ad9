"""Evaluation of scored tables.

A scored table has a 0/1 label, a score and any grouping keys. ROC and AUC
are exact: rows are first collapsed to one row per distinct score (so heavy
ties cost nothing), then cumulative counts come from the distributed prefix
sum (P1), never from a single-task window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prefix import join_null_safe, prefix_sum
from riskloom.session import cut_lineage


def attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach a per-group table that has one row per ``by`` key to ``df``: a
    null-safe join on the keys (the planner broadcasts it where its size
    allows), or, with no keys, the single row's values as literals."""
    by = list(by)
    if by:
        return join_null_safe(df, small, by)
    row = small.first()  # one row
    vals = row.asDict() if row is not None else {c: None for c in small.columns}
    return df.select("*", *[F.lit(v).cast(small.schema[c].dataType).alias(c) for c, v in vals.items()])


def confusion(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """H1: tn, fp, fn, tp at ``score >= threshold`` per group."""
    pred = F.col(score) >= F.lit(threshold)
    y = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.sum((~pred & ~y).cast("long")).alias("tn"),
        F.sum((pred & ~y).cast("long")).alias("fp"),
        F.sum((~pred & y).cast("long")).alias("fn"),
        F.sum((pred & y).cast("long")).alias("tp"),
    )


def _ratio(num, den):
    """num / den, 0 where the divisor is 0, null where it is null."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).when(den.isNotNull(), F.lit(0.0))


def classification_metrics(conf: DataFrame) -> DataFrame:
    """H2: accuracy, precision, recall, F1, specificity; 0 where the divisor is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return conf.select(
        "*",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tn, tn + fp).alias("specificity"),
    )


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (partial aggregate)."""
    return df.groupBy(*by, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("neg"))


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
               n_parts: int | None = None) -> DataFrame:
    """H3: one point per distinct score, thresholds descending, plus the
    (0, 0) point at threshold +inf. Columns: by..., threshold, tp, fp, tpr,
    fpr, n_pos, n_neg (group totals). ``df`` is read once: the counts per
    score are cut, and the totals come with the prefix sums."""
    by = list(by)
    counts = cut_lineage(score_counts(df, label, score, by))
    cum = prefix_sum(counts, score, ["pos", "neg"], by, descending=True, n_parts=n_parts, totals="all_")
    pts = cum.select(
        *by, F.col(score).cast("double").alias("threshold"),
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        _ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
        _ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        F.col("all_pos").alias("n_pos"), F.col("all_neg").alias("n_neg"))
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    origin = totals.select(*by, F.lit(math.inf).alias("threshold"), F.lit(0).cast("long").alias("tp"),
                           F.lit(0).cast("long").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"),
                           F.col("P").alias("n_pos"), F.col("N").alias("n_neg"))
    return pts.unionByName(origin)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
            out: str = "auc", n_parts: int | None = None) -> DataFrame:
    """H4: exact ROC AUC per group, tied scores at half weight; null when a
    group has only one class. AUC = sum_s pos_s (N - cum_neg_s + neg_s / 2) / (P N)
    with cum_neg_s the negatives scoring >= s."""
    by = list(by)
    counts = cut_lineage(score_counts(df, label, score, by))
    cum = prefix_sum(counts, score, ["neg"], by, descending=True, n_parts=n_parts)
    part = cum.groupBy(*by).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg"))).alias("__above"),
        F.sum(F.col("pos").cast("double") * F.col("neg")).alias("__tie"),
    )
    # all (pos, neg) pairs minus those with the negative strictly above, minus half the ties
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0),
                 (F.col("P").cast("double") * F.col("N") - F.col("__above") - F.col("__tie") * 0.5)
                 / (F.col("P").cast("double") * F.col("N")))
    return part.select(*by, auc.alias(out))


def youden_threshold(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """H5: threshold maximising tpr - fpr; the highest threshold wins a tie."""
    j = F.col("tpr") - F.col("fpr")
    return (roc.groupBy(*by)
            .agg(F.max_by(F.struct(j.alias("j"), F.col("threshold").alias("threshold")),
                          F.struct(j, F.col("threshold"))).alias("best"))
            .select(*by, F.col("best.threshold").alias("threshold"), F.col("best.j").alias("youden_j")))


def threshold_report(df: DataFrame, label: str, score: str, thresholds: Sequence[float],
                     by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """H6: confusion counts and metrics at several thresholds in ONE pass
    (conditional sums per threshold, then unpivot), metrics rounded."""
    by = list(by)
    y = F.col(label) == 1
    aggs = []
    for i, t in enumerate(thresholds):
        pred = F.col(score) >= F.lit(float(t))
        aggs += [F.sum((~pred & ~y).cast("long")).alias(f"tn_{i}"), F.sum((pred & ~y).cast("long")).alias(f"fp_{i}"),
                 F.sum((~pred & y).cast("long")).alias(f"fn_{i}"), F.sum((pred & y).cast("long")).alias(f"tp_{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tn_{i}").alias("tn"), F.col(f"fp_{i}").alias("fp"),
                 F.col(f"fn_{i}").alias("fn"), F.col(f"tp_{i}").alias("tp"))
        for i, t in enumerate(thresholds)])).alias("r")
    long = wide.select(*by, stack).select(*by, "r.*")
    m = classification_metrics(long)
    return m.select(*by, "threshold", "tn", "fp", "fn", "tp",
                    *[F.round(c, digits).alias(c) for c in ("accuracy", "precision", "recall", "f1", "specificity")])


def cv_summary(fold_metrics: DataFrame, by: Sequence[str] = ("model",),
               metrics: Sequence[str] = ("auc", "f1", "recall")) -> DataFrame:
    """H7: mean of each metric over folds."""
    return fold_metrics.groupBy(*by).agg(*[F.avg(m).alias(f"cv_{m}") for m in metrics])


def comparison_table(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """H8: base model rows plus the tuned row (missing CV columns -> null)."""
    return base.unionByName(tuned, allowMissingColumns=True)


def pick_best(results: DataFrame, metric: str = "test_auc", position: str = "position") -> DataFrame:
    """The row with the highest metric; the first position wins a tie."""
    return results.orderBy(F.desc(metric), F.asc(position)).limit(1)
