"""Cost-benefit of an operating point.

A scenario table holds (scenario_id, annual_volume, readmission_cost,
intervention_cost, prevention_rate). Operating points come from ``confusion`` or ``roc_points``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import sized_broadcast

SCENARIO_SCHEMA = ("scenario_id string, annual_volume double, readmission_cost double, "
                   "intervention_cost double, prevention_rate double")


def scenarios(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


SCENARIO_BLOCK = 5_000


def scenario_blocks(scen: DataFrame, n_blocks: int) -> DataFrame:
    """(__block, __all): the scenarios as arrays, one row a block."""
    block = F.pmod(F.xxhash64(*scen.columns), F.lit(n_blocks)).cast("int")
    return scen.groupBy(block.alias("__block")).agg(F.collect_list(F.struct(*scen.columns)).alias("__all"))


def _with_scenarios(points: DataFrame, scen: DataFrame) -> DataFrame:
    """Every operating point under every scenario: scenarios travel in blocks
    of about ``SCENARIO_BLOCK``, each point names the blocks, and an equi-join
    on the block brings them together. The blocks are broadcast only after
    their size was measured; nothing of them is in the plan or the driver."""
    n_blocks = max(1, -(-scen.count() // SCENARIO_BLOCK))
    named = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("__block"))
    joined = named.join(sized_broadcast(scenario_blocks(scen, n_blocks)), "__block")
    return (joined.select(*points.columns, F.explode("__all").alias("__s"))
            .select(*points.columns, *[F.col(f"__s.{c}").alias(c) for c in scen.columns]))


def _money(tp, fp):
    savings = tp * F.col("prevention_rate") * F.col("readmission_cost")
    costs = (tp + fp) * F.col("intervention_cost")
    net = savings - costs
    roi = F.when(costs > 0, net / costs * 100.0).otherwise(F.lit(0.0))
    return savings, costs, net, roi


def cost_benefit(conf: DataFrame, scen: DataFrame) -> DataFrame:
    """K1: confusion counts scaled to the annual volume; savings, spend, net,
    ROI % (0 without spend); prevented and flagged truncated to integers."""
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    j = _with_scenarios(conf, scen).withColumn("__scale", F.col("annual_volume") / n)
    tp = F.col("tp") * F.col("__scale")
    fp = F.col("fp") * F.col("__scale")
    savings, costs, net, roi = _money(tp, fp)
    keep = [c for c in conf.columns]
    return j.select(*keep, "scenario_id", savings.alias("savings"), costs.alias("costs"), net.alias("net_benefit"),
                    roi.alias("roi_pct"),
                    F.floor(tp * F.col("prevention_rate")).cast("long").alias("prevented"),
                    F.floor(tp + fp).cast("long").alias("flagged"))


def cost_curve(roc: DataFrame, scen: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """K2: net benefit and ROI at every ROC point (tp, fp cumulative counts)
    under every scenario; the group totals n_pos, n_neg ride on the ROC rows."""
    j = _with_scenarios(roc, scen)
    scale = F.col("annual_volume") / (F.col("n_pos") + F.col("n_neg"))
    tp = F.col("tp") * scale
    fp = F.col("fp") * scale
    savings, costs, net, roi = _money(tp, fp)
    return j.select(*by, "scenario_id", "threshold", "tpr", "fpr", net.alias("net_benefit"), roi.alias("roi_pct"))


def strategy_table(conf: DataFrame, scen: DataFrame) -> DataFrame:
    """K3: no screening, flag everyone, and the model, per scenario."""
    j = _with_scenarios(conf, scen)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    vol = F.col("annual_volume")
    pos_rate = (F.col("tp") + F.col("fn")) / n
    none = j.select("scenario_id", F.lit("none").alias("strategy"), F.lit(0.0).alias("flagged"),
                    F.lit(0.0).alias("caught"), F.lit(0.0).alias("costs"), F.lit(0.0).alias("savings"),
                    F.lit(0.0).alias("net_benefit"), F.lit(None).cast("double").alias("roi_pct"))
    e_caught = pos_rate * vol
    e_cost = vol * F.col("intervention_cost")
    e_sav = e_caught * F.col("prevention_rate") * F.col("readmission_cost")
    everyone = j.select("scenario_id", F.lit("everyone").alias("strategy"), vol.alias("flagged"),
                        e_caught.alias("caught"), e_cost.alias("costs"), e_sav.alias("savings"),
                        (e_sav - e_cost).alias("net_benefit"),
                        F.when(e_cost > 0, (e_sav - e_cost) / e_cost * 100.0).otherwise(F.lit(0.0)).alias("roi_pct"))
    scale = vol / n
    tp, fp = F.col("tp") * scale, F.col("fp") * scale
    savings, costs, net, roi = _money(tp, fp)
    model = j.select("scenario_id", F.lit("model").alias("strategy"), F.floor(tp + fp).cast("double").alias("flagged"),
                     tp.alias("caught"), costs.alias("costs"), savings.alias("savings"), net.alias("net_benefit"),
                     roi.alias("roi_pct"))
    return none.unionByName(everyone).unionByName(model)
