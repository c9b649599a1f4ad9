"""Properties of the split, prefix-sum and evaluation operators."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import evaluate as Ev
from riskloom.operators import prep as P
from riskloom.operators.prefix import global_rank, prefix_sum
from riskloom.plans import hospital as H

from common import SF_SMALL


def test_split_disjoint_and_complete(spark):
    feat = H.hospital_features(spark, SF_SMALL)
    n = feat.count()
    for exact in (False, True):
        s = P.stratified_split(feat, H.KEY, H.LABEL, 0.2, exact=exact)
        assert s.count() == n
        assert s.select(H.KEY).distinct().count() == n
        counts = {(r["is_test"], r[H.LABEL]): r["n"] for r in
                  s.groupBy("is_test", H.LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
        for c in (0, 1):
            tot = counts.get((True, c), 0) + counts.get((False, c), 0)
            share = counts.get((True, c), 0) / tot
            if exact:
                assert counts.get((True, c), 0) == round(0.2 * tot)
            else:
                assert 0.1 < share < 0.3


def test_exact_folds_balanced(spark):
    feat = H.hospital_features(spark, SF_SMALL)
    f = P.assign_folds(feat, H.KEY, H.LABEL, 5, exact=True)
    per = f.groupBy("fold", H.LABEL).agg(F.count(F.lit(1)).alias("n")).collect()
    for c in (0, 1):
        ns = [r["n"] for r in per if r[H.LABEL] == c]
        assert len(ns) == 5 and max(ns) - min(ns) <= 1


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sum_bucketed_equals_window(spark, descending):
    rnd = random.Random(7)
    # heavy ties: one score holds a third of all rows
    rows = [(i, rnd.choice(["a", "b", "c"]), 0.5 if i % 3 == 0 else round(rnd.random(), 2), rnd.randint(0, 5))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, s double, v long")
    got = prefix_sum(df, "s", ["v"], by=["g"], descending=descending, tiebreak=["id"], n_parts=16)
    order = [F.col("s").desc() if descending else F.col("s").asc(), F.col("id").asc()]
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("want", F.sum("v").over(w))
    bad = got.join(want, ["id", "g", "s", "v"]).filter(F.col("cum_v") != F.col("want")).count()
    assert bad == 0 and got.count() == 3000


def test_global_rank_is_permutation(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("s"))
    r = global_rank(df, "s", tiebreak=["id"], n_parts=8)
    got = sorted(x[0] for x in r.select("rank").collect())
    assert got == list(range(1, 2001))


def test_roc_monotone_and_auc_symmetry(spark):
    scored = H.scored_test(spark, SF_SMALL)
    roc = Ev.roc_points(scored, "label", "score", n_parts=8).orderBy(F.desc("threshold")).collect()
    tprs = [r["tpr"] for r in roc]
    fprs = [r["fpr"] for r in roc]
    assert tprs == sorted(tprs) and fprs == sorted(fprs)
    assert roc[0]["tpr"] == 0.0 and roc[-1]["tpr"] == 1.0 and roc[-1]["fpr"] == 1.0
    auc = Ev.roc_auc(scored, "label", "score").first()["auc"]
    neg = Ev.roc_auc(scored.withColumn("score", -F.col("score")), "label", "score").first()["auc"]
    assert auc + neg == pytest.approx(1.0, abs=1e-12)
    # trapezoid area under the points equals the tie-aware AUC
    area = sum((roc[i]["fpr"] - roc[i - 1]["fpr"]) * (roc[i]["tpr"] + roc[i - 1]["tpr"]) / 2
               for i in range(1, len(roc)))
    assert area == pytest.approx(auc, abs=1e-12)


def test_youden_matches_brute_force(spark):
    scored = H.scored_test(spark, SF_SMALL)
    roc = Ev.roc_points(scored, "label", "score").collect()
    best = max(roc, key=lambda r: (r["tpr"] - r["fpr"], r["threshold"]))
    got = Ev.youden_threshold(Ev.roc_points(scored, "label", "score")).first()
    assert got["threshold"] == best["threshold"]


def test_threshold_report_matches_confusion(spark):
    scored = H.scored_test(spark, SF_SMALL)
    rep = {r["threshold"]: r for r in Ev.threshold_report(scored, "label", "score", [0.5, 0.2]).collect()}
    for t in (0.5, 0.2):
        c = Ev.confusion(scored, "label", "score", t).first()
        assert (rep[t]["tn"], rep[t]["fp"], rep[t]["fn"], rep[t]["tp"]) == (c["tn"], c["fp"], c["fn"], c["tp"])


def test_heavy_tie_is_split_across_buckets(spark):
    from riskloom.operators.prefix import ranged

    # a third of all rows share one order value
    df = spark.range(30000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7.0))
                                   .otherwise((F.col("id") % 1000).cast("double")).alias("s"))
    sizes = [r["count"] for r in ranged(df, "s", tiebreak=["id"], n_parts=32).groupBy("__b").count().collect()]
    assert max(sizes) < 30000 / 3 / 4  # the 10k tied rows are spread over many buckets
    for desc in (False, True):
        got = prefix_sum(df.withColumn("v", F.lit(1).cast("long")), "s", ["v"], descending=desc, tiebreak=["id"],
                         n_parts=32)
        order = [F.col("s").desc() if desc else F.col("s").asc(), F.col("id").asc()]
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        want = df.withColumn("want", F.count(F.lit(1)).over(w))
        assert got.join(want, ["id", "s"]).filter(F.col("cum_v") != F.col("want")).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_null_order_and_string_ties(spark, descending):
    df = spark.range(3000).select(
        F.concat(F.lit("key-"), F.col("id").cast("string")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 5).alias("s"),
        F.when(F.col("id") % 4 != 0, F.col("id") % 2).alias("g"), F.lit(1).cast("long").alias("v"))
    got = prefix_sum(df, "s", ["v"], by=["g"], descending=descending, tiebreak=["k"], n_parts=13, totals="all_")
    order = [F.col("s").desc() if descending else F.col("s").asc(), F.col("k").asc()]
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r["k"]: (r["c"], r["n"]) for r in df.select(
        "k", F.sum("v").over(w).alias("c"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n")).collect()}
    assert {r["k"]: (r["cum_v"], r["all_v"]) for r in got.collect()} == want
