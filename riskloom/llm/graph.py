"""Joins that keep hot keys apart, and connected components, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

# A key is hot when it holds more than this share of all rows, so there are at
# most 1 / HOT_SHARE of them: the proven bound of what is broadcast for them.
HOT_SHARE = 1 / 500
HOT_LEAST = 2_000
MAX_ROUNDS = 60


def hot_keys(rows: DataFrame, key: str, count: str | None = None) -> DataFrame | None:
    """Keys with more than a ``HOT_SHARE`` of the rows (at most 500), or None
    without any. ``count`` names a column of ``rows`` that already holds the
    number of rows of the key."""
    known = rows.filter(F.col(key).isNotNull())
    if count is None:
        counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        size = counts.agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).collect()[0]
    else:
        counts = known.select(key, F.col(count).alias("_n"))
        size = counts.agg(F.count(F.lit(1)).alias("n"), F.max("_n").alias("most")).collect()[0]
    limit = max(HOT_LEAST, int((size["n"] or 0) * HOT_SHARE))
    if (size["most"] or 0) <= limit:
        return None
    return cut_lineage(counts.filter(F.col("_n") > limit).select(key).distinct())


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner",
                count: str | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row a
    key. The rows of hot keys stay where they are and meet a broadcast of
    those few table rows; all other rows are shuffled. Both sides are read
    several times, so they should be cut."""
    hot = hot_keys(rows, key, count)
    if hot is None:
        return rows.join(table, key, how)
    few = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    tagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    warm = tagged.filter(F.col("_hot").isNotNull()).drop("_hot").join(few, key, how)
    cold = tagged.filter(F.col("_hot").isNull()).drop("_hot").join(table, key, how)
    return warm.unionByName(cold)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component, for the
    nodes of ``edges``. Labels move to the least neighbour and then to the
    label of the label, so long chains take few rounds; each round is one job,
    cut in the checkpoint folder. A hub is a hot key of two joins with one
    row a node on the other side, which the adaptive skew join splits; the
    minima are taken before the shuffle."""
    both = cut_lineage(edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
                       .unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
                       .filter("node <> other"))
    labels = cut_lineage(both.groupBy("node").agg(F.min("other").alias("_m"))
                         .select("node", F.least("node", "_m").alias("root")))
    for _ in range(MAX_ROUNDS):
        of = labels.select(F.col("node").alias("other"), F.col("root").alias("_far"))
        near = both.join(of, "other").groupBy("node").agg(F.min("_far").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("_old"),
                                                F.least("root", "_near").alias("_l"))
        jump = labels.select(F.col("node").alias("_l"), F.col("root").alias("_next"))
        new = cut_lineage(step.join(jump, "_l").select("node", F.col("_next").alias("root"),
                                                       (F.col("_next") != F.col("_old")).alias("moved")))
        labels = new.select("node", "root")
        if not new.filter("moved").take(1):
            return labels
    raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
