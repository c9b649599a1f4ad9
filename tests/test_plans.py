"""Physical-plan properties: column pruning into the scans, no cartesian or
nested-loop joins on the hot paths, and bucketed (partitioned) windows."""

import re

from riskloom.operators import evaluate as Ev
from riskloom.operators import fairness as Fa
from riskloom.operators.prefix import prefix_sum
from riskloom.plans import catalog as Q
from riskloom.plans import hospital as H

from common import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return _plan(df)


def _scan_columns(plan: str) -> dict[str, set[str]]:
    out = {}
    for line in plan.splitlines():
        m = re.search(r"FileScan parquet \[([^\]]*)\].*?Location: [^\[]*\[[^\]]*/([a-z]+)\.parquet\]", line)
        if m:
            out.setdefault(m.group(2), set()).update(c.split("#")[0] for c in m.group(1).split(","))
    return out


def test_scans_read_only_needed_columns(spark):
    cols = _scan_columns(_plan(Q.flagship_rate_by_age(spark, SF_SMALL)))
    # the rate by age needs only the order key (age, label and the hospice
    # filter derive from it) and the line quantities
    assert cols["orders"] == {"o_orderkey"}
    assert cols["lineitem"] == {"l_orderkey", "l_quantity"}
    cols = _scan_columns(_plan(H.hospital_model_table(spark, SF_SMALL)))
    assert cols["orders"] == {"o_orderkey", "o_custkey"}


def test_filter_reaches_the_scans(spark):
    plan = _plan(Q.flagship_rate_by_age(spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("DataFilters: [NOT coalesce" in line for line in scans)


def test_no_cartesian_on_hot_paths(spark):
    scored = H.scored_test(spark, SF_SMALL)
    plans = [
        _plan(Q.flagship_rate_by_age(spark, SF_SMALL)),
        _plan(H.hospital_model_table(spark, SF_SMALL)),
        _plan(Fa.fairness_audit(scored, "label", "score", ["race", "age_group"], [0.5, 0.3])),
        _plan(Ev.roc_points(scored, "label", "score", n_parts=8)),
        _plan(Ev.threshold_report(scored, "label", "score", [0.5, 0.2])),
    ]
    for p in plans:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_prefix_sum_window_is_partitioned_by_bucket(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 97 as double) as s", "1L as v")
    plan = _final_plan(prefix_sum(df, "s", ["v"], n_parts=8))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # over rows: by bucket; the others see one row a bucket or a span of buckets
    rows = [w for w in windows if "sum(v#" in w]
    assert rows and all("__b" in w for w in rows) and all("__t_v" in w for w in windows if w not in rows)
