"""Cohort aggregates. Each is one aggregate plan with a
map-side partial aggregation; none collects rows to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.clean import reindex_domain


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Count per value, nulls left out, descending (value breaks ties)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(out))
            .orderBy(F.desc(out), F.asc(col)))


def outcome_rate_by(df: DataFrame, col: str, outcome: Column | str, out: str = "rate",
                    domain: Sequence | None = None) -> DataFrame:
    """Mean of a 0/1 outcome per group (null groups left out). Sorted by
    rate descending, or in ``domain`` order with absent values as null."""
    o = F.col(outcome) if isinstance(outcome, str) else outcome
    agg = (df.filter(F.col(col).isNotNull()).groupBy(col)
           .agg(F.avg(o.cast("double")).alias(out), F.count(F.lit(1)).alias("n")))
    if domain is not None:
        return reindex_domain(agg, col, domain, fill={"n": 0}).orderBy("pos")
    return agg.orderBy(F.desc(out), F.asc(col))


def count_distinct(df: DataFrame, col: str, out: str = "n_distinct", approx: bool = False) -> DataFrame:
    """Exact distinct count (or HyperLogLog++ when ``approx``)."""
    f = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return df.agg(f.alias(out))


def cohort_kpis(df: DataFrame, patient_col: str, outcome: Column) -> DataFrame:
    """Rows, columns, distinct patients, outcome rate, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.countDistinct(patient_col).alias("n_patients"),
        F.avg(outcome.cast("double")).alias("positive_rate"),
    )


def correlate_with(df: DataFrame, cols: Sequence[str], label: Column | str,
                   feature_col: str = "feature", out: str = "correlation") -> DataFrame:
    """E5: Pearson correlation of each column with the label (pairs with a
    null left out), one aggregate pass for all columns, then long form."""
    lab = (F.col(label) if isinstance(label, str) else label).cast("double")
    wide = df.agg(*[F.corr(F.col(c).cast("double"), lab).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), feature_col, out)
    return long.orderBy(F.desc(out), F.asc(feature_col))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, out: str = "n") -> DataFrame:
    """Equal-width bins over [lo, hi]; the top edge falls in the last
    bin; values outside or null are left out. One row per bin (empty -> 0)."""
    w = (hi - lo) / bins
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")
    counts = (df.filter((x >= lo) & (x <= hi)).select(b.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias(out)))
    spark = df.sparkSession
    dom = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (F.broadcast(dom).join(counts, "bin", "left")
            .select("bin",
                    (F.lit(lo) + F.col("bin") * F.lit(w)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("bin_hi"),
                    F.coalesce(F.col(out), F.lit(0)).cast("bigint").alias(out))
            .orderBy("bin"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class count, balanced weight n / (2 n_c), and the imbalance
    ratio neg/pos (1.0 without positives), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.sum("n_class").alias("n_total"),
                     F.sum(F.when(F.col(label) == 1, F.col("n_class")).otherwise(0)).alias("n_pos"),
                     F.sum(F.when(F.col(label) == 0, F.col("n_class")).otherwise(0)).alias("n_neg"))
    t = tot.first()  # one row of class totals
    joined = counts.select("*", *[F.lit(t[c]).cast("long").alias(c) for c in ("n_total", "n_pos", "n_neg")])
    return (joined
            .select(label, "n_class",
                    (F.col("n_total") / (F.lit(2.0) * F.col("n_class"))).alias("weight"),
                    F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos").cast("double"))
                    .otherwise(F.lit(1.0)).alias("imbalance_ratio")))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the balanced class weight as a column (for Spark ML weightCol).
    The weight table has one row per class: broadcast is bounded."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")


def top_n(df: DataFrame, col: str, n: int, tiebreak: str | None = None) -> DataFrame:
    """The n rows with the largest ``col`` (TakeOrderedAndProject)."""
    order = [F.desc(col)] + ([F.asc(tiebreak)] if tiebreak else [])
    return df.orderBy(*order).limit(n)


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
         var: str = "metric", value: str = "score") -> DataFrame:
    """Wide -> long; values that are not numbers become null."""
    casted = df.select(*ids, *[F.col(c).cast("string").try_cast("double").alias(c) for c in cols])
    return casted.unpivot(list(ids), list(cols), var, value)


def dataset_summary(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Row count, feature count, positive rate."""
    return df.agg(F.count(F.lit(1)).alias("n_encounters"),
                  F.lit(len(features)).cast("bigint").alias("n_features"),
                  F.avg(F.col(label).cast("double")).alias("positive_rate"))
