"""Cleaning, lookups and alignment.

All operators are lazy DataFrame -> DataFrame transforms. Lookups against
small tables are broadcast hash joins; the small side is either bounded by
construction (top-k, a fixed domain) or its row count is checked first.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.clinical import diagnosis_code_number
from riskloom.session import sized_broadcast

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)

# --- fixed values: discharge codes meaning expired or hospice ---
DECEASED_DISPOSITION_IDS = [11, 13, 14, 19, 20, 21]


def normalise_nulls(df: DataFrame, tokens: Sequence[str], cols: Iterable[str] | None = None) -> DataFrame:
    """B1: NA tokens -> null in the (string) columns."""
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = set(cols) & string_cols if cols is not None else string_cols
    toks = list(tokens)
    return df.select(*[
        F.when(F.col(c).isin(toks), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in targets else F.col(c)
        for c in df.columns
    ])


def drop_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """B2: drop the listed columns that exist."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present)


def exclude_codes(df: DataFrame, col: str, codes: Sequence) -> DataFrame:
    """Drop rows whose code is in the list; null codes stay."""
    return df.filter(~F.coalesce(F.col(col).isin(list(codes)), F.lit(False)))


def binary_label(df: DataFrame, col: str, positive: str, out: str = "readmitted_binary") -> DataFrame:
    """1 where col equals ``positive`` else 0 (null -> 0)."""
    return df.withColumn(out, F.col(col).eqNullSafe(F.lit(positive)).cast("int"))


def lump_top_k(df: DataFrame, col: str, k: int = 10, other: str = "Other") -> DataFrame:
    """Keep the k most frequent values of ``col``, everything else (null
    included) becomes ``other``. Ties on the count break by value ascending.

    The count is a partial (map-side) aggregate, the top-k a
    TakeOrderedAndProject, and the k-row result is broadcast: its size is
    bounded by k, whatever the data size.
    """
    top = (df.groupBy(col).count().filter(F.col(col).isNotNull())
           .orderBy(F.desc("count"), F.asc(col)).limit(k)
           .select(F.col(col).alias("__top_value")))
    joined = df.join(F.broadcast(top), F.col(col) == F.col("__top_value"), "left")
    return joined.select(*[
        F.when(F.col("__top_value").isNull(), F.lit(other)).otherwise(F.col(c)).alias(c) if c == col else F.col(c)
        for c in df.columns
    ])


def numeric_only(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Numeric columns only, plus the ``keep`` columns."""
    keep = list(keep)
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in keep]
    return df.select(*keep, *cols)


def align_features(df: DataFrame, features: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """Exactly the feature list in order; a missing feature is 0."""
    have = set(df.columns)
    return df.select(*[F.col(c) for c in keep],
                     *[(F.col(f) if f in have else F.lit(0)).alias(f) for f in features])


def decode(df: DataFrame, lookup: DataFrame, columns: Mapping[str, str],
           default: str = "Unknown", section_col: str = "section",
           id_col: str = "id", text_col: str = "description") -> DataFrame:
    """Id -> text per section of a long lookup table; unmatched or null
    -> ``default``. One broadcast hash join per decoded column (the lookup
    is a code table; its size is checked before it is broadcast)."""
    out = df
    for src, dst in columns.items():
        lk = (lookup.filter(F.col(section_col) == src)
              .select(F.col(id_col).alias("__lk_id"), F.col(text_col).alias("__lk_text"))
              .dropDuplicates(["__lk_id"]))
        out = (out.join(sized_broadcast(lk), F.col(src) == F.col("__lk_id"), "left")
               .withColumn(dst, F.coalesce(F.col("__lk_text"), F.lit(default)))
               .drop("__lk_id", "__lk_text"))
    return out


def reindex_domain(counts: DataFrame, col: str, domain: Sequence, fill: Mapping[str, object] | None = None,
                   order_col: str = "pos") -> DataFrame:
    """One row per domain value, in domain order; values absent from
    ``counts`` get ``fill`` (e.g. 0 for counts, null for rates). The domain
    is a fixed list on the preserved side; the planner picks the join."""
    spark = counts.sparkSession
    dom_type = counts.schema[col].dataType
    dom = spark.createDataFrame([(i, v) for i, v in enumerate(domain)],
                                T.StructType([T.StructField(order_col, T.IntegerType()),
                                              T.StructField(col, dom_type)]))
    joined = dom.join(counts, on=col, how="left")
    fill = dict(fill or {})
    cols = [F.col(order_col), F.col(col)]
    for c in counts.columns:
        if c == col:
            continue
        cols.append(F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c))
    return joined.select(*cols)


RANGE_BUCKETS = 4_096


def range_lookup_join(df: DataFrame, col: str, ranges: DataFrame, out: str,
                      default: str = "Other", lo: str = "lo", hi: str = "hi",
                      label: str = "label", order: str | None = None) -> DataFrame:
    """C4 against a range table (for long lists; the fixed ICD-9 list uses the
    CASE form in ``functions.clinical.range_label``): the integer part of a
    code written as a plain number -> label of the first range holding it,
    by ``order`` (default: by lo, hi, label). Other codes get ``default``.

    Ranges of any width are cut into buckets, about ``RANGE_BUCKETS`` plus
    two per range in all; a bucket is one row with its ranges in order, so
    the lookup is an equi-join that never multiplies rows."""
    n = diagnosis_code_number(col)
    lo_, hi_ = F.col(lo).cast("long"), F.col(hi).cast("long")
    valid = ranges.filter(lo_ <= hi_)
    span = valid.agg(F.sum((hi_ - lo_ + 1).cast("double")).alias("w")).first()["w"] or 1.0
    width = max(1, math.ceil(span / RANGE_BUCKETS))
    rank = F.struct(*([F.col(order)] if order else []), lo_, hi_, F.col(label))
    cut = (valid.select(F.struct(rank.alias("rank"), lo_.alias("lo"), hi_.alias("hi"), F.col(label).alias("label")).alias("r"))
           .withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("r.lo") / width), F.floor(F.col("r.hi") / width))))
           .groupBy("__bucket").agg(F.array_sort(F.collect_list("r")).alias("__ranges")))
    keyed = df.withColumn("__n", n).withColumn("__bucket", F.floor(F.col("__n") / width))
    holds = F.filter("__ranges", lambda r: (r["lo"] <= F.col("__n")) & (F.col("__n") <= r["hi"]))
    return (keyed.join(cut, "__bucket", "left")
            .withColumn(out, F.coalesce(F.get(holds, F.lit(0))["label"], F.lit(default)))
            .select(*df.columns, out))
