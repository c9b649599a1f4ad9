"""Exact global prefix sums and ranks without a single-task window.

An unpartitioned ``Window.orderBy`` moves every row into one task. Instead:

1. rows are range-partitioned by (group, order, tiebreak, a hash of the row),
   so runs of equal values spread as well and keys of any type, nulls
   included, lie as the sort order places them; the partition number is kept
   as the bucket and the result is cut in the checkpoint folder;
2. per (group, bucket) totals are aggregated (at most groups + partitions
   rows, as a group's buckets are neighbours), and a prefix over them in two
   levels gives each bucket its offset, joined by the bucket;
3. a window partitioned by (group, bucket) finishes the sum inside a bucket.

All joins on group keys are null-safe: a null group is a group of its own.
One path serves every size; a task holds about rows / partitions rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import BROADCAST_MAX_ROWS, cut_lineage


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the null-safe join condition."""
    renamed = right.select(*[F.col(c).alias(f"__k{keys.index(c)}" if c in keys else c) for c in right.columns])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return renamed, cond


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match; ``right``'s other columns follow."""
    keys = list(keys)
    other, cond = null_safe(left, right, keys)
    return left.join(other, cond, how).drop(*[f"__k{i}" for i in range(len(keys))])


def _order(order: str, tiebreak: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(order).desc() if descending else F.col(order).asc(), *[F.col(t).asc() for t in tiebreak],
            F.col("__tie").asc()]


def ranged(df: DataFrame, order: str, by: Sequence[str] = (), tiebreak: Sequence[str] = (),
           descending: bool = False, n_parts: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` dealt into sorted ranges, with the range as ``__b`` and a hash
    of the row as ``__tie``; cut in the checkpoint folder. With ``keep``, only
    these columns travel (the hash is still that of the whole row), and the
    narrow rows are cut before the ranges are drawn, so the plan of ``df``
    runs once."""
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie", F.xxhash64(*df.columns))
    if keep is not None:
        tied = cut_lineage(tied.select(*keep, "__tie"))
    keys = [*[F.col(c).asc() for c in by], *_order(order, tiebreak, descending)]
    return cut_lineage(tied.repartitionByRange(n, *keys).withColumn("__b", F.spark_partition_id()))


# Buckets that one window of the first level holds.
SPAN = 1_024


def offsets(sums: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by..., __b, __off_<v>, __all_<v>): what lies before each bucket, and
    the whole of its group, from one row (by..., __b, __t_<v>) a bucket.

    Two levels: a window over spans of ``SPAN`` buckets, and one over the
    totals of the spans, so the plan does not grow with the buckets and a
    window holds a thousandth of them."""
    by, values = list(by), list(values)
    spans = sums.withColumn("__span", F.floor(F.col("__b") / SPAN).cast("long"))
    before = Window.partitionBy(*by, "__span").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inner = spans.select(*by, "__b", "__span",
                         *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__in_{v}") for v in values])
    group = by or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    totals = spans.groupBy(*by, "__span").agg(*[F.sum(f"__t_{v}").alias(f"__t_{v}") for v in values])
    totals = totals.select(
        *by, "__span",
        *[F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__up_{v}") for v in values],
        *[F.sum(f"__t_{v}").over(Window.partitionBy(*group)).alias(f"__all_{v}") for v in values])
    return join_null_safe(inner, totals, [*by, "__span"], "inner").select(
        *by, "__b", *[(F.col(f"__up_{v}") + F.col(f"__in_{v}")).alias(f"__off_{v}") for v in values],
        *[f"__all_{v}" for v in values])


def _attach(rows: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with their bucket's offsets. Without groups there is one row a
    partition, which is broadcast while it is small."""
    if by or rows.rdd.getNumPartitions() > BROADCAST_MAX_ROWS:
        return join_null_safe(rows, found, [*by, "__b"])
    return rows.join(F.broadcast(found), "__b", "left")


def prefix_sum(df: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = (),
               descending: bool = False, tiebreak: Sequence[str] = (), prefix: str = "cum_",
               inclusive: bool = True, n_parts: int | None = None, totals: str | None = None,
               keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``<prefix><value>``: the running sum of each value column over
    rows ordered by ``order`` (nulls first, or last when descending), then
    ``tiebreak``, within each ``by`` group. ``inclusive`` counts the row
    itself. ``totals`` names a prefix under which the group's whole sum is
    added as well, from the same aggregate. ``keep`` names the columns to
    return (all by default)."""
    by, values, tiebreak = list(by), list(values), list(tiebreak)
    columns = df.columns
    if keep is not None:
        columns = list(dict.fromkeys([*keep, *by, order, *tiebreak, *values]))
    rows = ranged(df, order, by, tiebreak, descending, n_parts, None if keep is None else columns)
    sums = rows.groupBy(*by, "__b").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    added = [f"__off_{v}" for v in values] + [f"__all_{v}" for v in values]
    joined = _attach(rows, offsets(sums, by, values), by)
    end = Window.currentRow if inclusive else -1
    inside = (Window.partitionBy(*by, "__b").orderBy(*_order(order, tiebreak, descending))
              .rowsBetween(Window.unboundedPreceding, end))
    out = joined.select(*columns, *added, *[F.sum(v).over(inside).alias(f"__in_{v}") for v in values])
    return out.select(
        *columns,
        *[(F.coalesce(f"__in_{v}", F.lit(0)) + F.col(f"__off_{v}")).alias(f"{prefix}{v}") for v in values],
        *([F.coalesce(f"__all_{v}", F.lit(0)).alias(f"{totals}{v}") for v in values] if totals else []))


def global_rank(df: DataFrame, order: str, by: Sequence[str] = (), tiebreak: Sequence[str] = (),
                out: str = "rank", n_parts: int | None = None, size: str | None = None,
                keep: Sequence[str] | None = None) -> DataFrame:
    """1-based row number by ``order`` (+ ``tiebreak``) within ``by`` groups,
    computed through ``prefix_sum`` of a constant 1; ``size`` names a column
    for the number of rows of the group."""
    ranked = prefix_sum(df.withColumn("__one", F.lit(1).cast("bigint")), order, ["__one"], by,
                        tiebreak=tiebreak, n_parts=n_parts, totals="__size_" if size else None, keep=keep)
    ranked = ranked.withColumnRenamed("cum___one", out).drop("__one")
    return ranked.withColumnRenamed("__size___one", size) if size else ranked
