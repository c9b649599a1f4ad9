"""Plans that do not grow with their parameters: prefix offsets, scenarios."""

import time

from pyspark.sql import functions as F

from riskloom.operators import cost as K
from riskloom.operators.prefix import SPAN, global_rank, offsets, prefix_sum


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_offsets_of_twenty_thousand_buckets(spark):
    n = 20_000
    assert n > 10 * SPAN
    sums = spark.range(n).select(F.col("id").cast("int").alias("__b"), (F.col("id") % 7).alias("__t_v"))
    got = {r["__b"]: (r["__off_v"], r["__all_v"]) for r in offsets(sums, [], ["v"]).collect()}
    running = 0
    whole = sum(i % 7 for i in range(n))
    for i in range(n):
        assert got[i] == (running, whole)
        running += i % 7


def test_offsets_by_group_with_nulls(spark):
    sums = spark.createDataFrame([(g, b, b + 1) for g in ("x", None) for b in range(0, 3000, 3)],
                                 "g string, __b int, __t_v long")
    got = {(r["g"], r["__b"]): r["__off_v"] for r in offsets(sums, ["g"], ["v"]).collect()}
    for g in ("x", None):
        running = 0
        for b in range(0, 3000, 3):
            assert got[g, b] == running
            running += b + 1


def test_plan_of_a_rank_does_not_grow_with_its_partitions(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7 % 100).alias("v"))
    small, large = (_plan(global_rank(df, "v", tiebreak=["id"], n_parts=p)) for p in (4, 150))
    assert abs(len(large) - len(small)) < 200
    got = prefix_sum(df, "v", ["id"], tiebreak=["id"], n_parts=150).orderBy("v", "id").collect()
    running = 0
    for r in got:
        running += r["id"]
        assert r["cum_id"] == running


def test_a_hundred_thousand_scenarios(spark):
    n = 100_000
    scen = spark.range(n).select(F.col("id").cast("string").alias("scenario_id"), F.lit(1000.0).alias("annual_volume"),
                                 (F.col("id") + 1.0).alias("readmission_cost"), F.lit(10.0).alias("intervention_cost"),
                                 F.lit(0.5).alias("prevention_rate")).cache()
    scen.count()
    conf = spark.createDataFrame([(0.5, 50, 20, 10, 20), (0.3, 40, 30, 5, 25)], "threshold double, tn long, fp long, fn long, tp long")
    K.cost_benefit(conf, scen)  # warm
    t = time.perf_counter()
    out = K.cost_benefit(conf, scen)
    plan = _plan(out)
    assert time.perf_counter() - t < 2.0 and len(plan) < 20_000
    assert out.count() == 2 * n and out.select("scenario_id").distinct().count() == n
    r = out.filter("scenario_id = '99' and threshold = 0.5").first()
    assert r["savings"] == 20 * 10.0 * 0.5 * 100.0 and r["costs"] == 40 * 10.0 * 10.0
    scen.unpersist()


def test_no_scenarios_and_equal_scenarios(spark):
    conf = spark.createDataFrame([(0.5, 5, 2, 1, 2)], "threshold double, tn long, fp long, fn long, tp long")
    assert K.cost_benefit(conf, K.scenarios(spark, [])).count() == 0
    twice = [("s", 10.0, 1.0, 1.0, 0.5)] * 2
    assert K.cost_benefit(conf, K.scenarios(spark, twice)).count() == 2


def test_split_carries_only_the_columns_read_afterwards(spark, monkeypatch):
    """The exact split of a wide table moves the named columns alone and
    marks the same rows, also where keys repeat or are null."""
    from riskloom.operators import prefix
    from riskloom.operators import prep as P

    rows = [(None if i % 10 == 0 else i // 2, i % 3 == 0 and 1 or 0, float(i), f"long text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, a double, wide string")
    want = sorted((r["a"], r["is_test"]) for r in P.stratified_split(df, "id", "y").collect())
    seen, cut = [], prefix.cut_lineage
    monkeypatch.setattr(prefix, "cut_lineage", lambda d: (seen.append(d.columns), cut(d))[1])
    narrow = P.stratified_split(df, "id", "y", keep=["id", "y", "a"])
    assert "wide" not in narrow.columns
    assert sorted((r["a"], r["is_test"]) for r in narrow.collect()) == want
    P.prepare_features(df, "id", "y", ["a"])
    assert seen and not any("wide" in c for c in seen)
