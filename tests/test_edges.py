"""Edge cases of the null model and of the reference's quirks (SURVEY Q3, Q4,
B7 ties, D10 edges, single-class AUC)."""

from pyspark.sql import functions as F

from riskloom.functions.clinical import (
    AGE_BIN_EDGES, AGE_BIN_LABELS, bin_right_closed, count_in, count_not_equal, diagnosis_group, row_nunique,
)
from riskloom.operators import clean as C
from riskloom.operators import evaluate as Ev


def test_diagnosis_groups(spark):
    codes = [None, "", " ? ", "?", "E888", "V57", "250.83", "250", "5d", "inf", "nan", "0", "-3", "1000",
             "1", "139", "139.9", "140", "999", "Unknown", " 428 ", "1e2", "abc"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    got = dict(df.select("code", diagnosis_group("code").alias("g")).collect())
    assert got[None] == "Unknown" and got[""] == "Unknown" and got[" ? "] == "Unknown" and got["?"] == "Unknown"
    assert got["E888"] == "External" and got["V57"] == "External"
    assert got["250.83"] == "Diabetes" and got["250"] == "Diabetes"
    assert got["5d"] == "Other" and got["inf"] == "Other" and got["nan"] == "Other"
    assert got["0"] == "Other" and got["-3"] == "Other" and got["1000"] == "Other"
    assert got["1"] == "Infectious" and got["139"] == "Infectious" and got["139.9"] == "Infectious"
    assert got["140"] == "Neoplasms" and got["999"] == "Injury"
    # Q3: a missing code filled with the text 'Unknown' first ends up as Other
    assert got["Unknown"] == "Other"
    assert got[" 428 "] == "Circulatory" and got["1e2"] == "Infectious" and got["abc"] == "Other"


def test_missing_drug_counts_as_active(spark):
    df = spark.createDataFrame([("No", None, "Up"), ("No", "No", "No")], "a string, b string, c string")
    got = df.select(count_not_equal(["a", "b", "c"], "No").alias("n"),
                    count_in(["a", "b", "c"], ["Up", "Down"]).alias("m")).collect()
    assert (got[0]["n"], got[0]["m"]) == (2, 1)  # Q4: the null counts as active
    assert (got[1]["n"], got[1]["m"]) == (0, 0)


def test_row_nunique(spark):
    df = spark.createDataFrame([("a", None, "a"), ("a", "b", "c"), (None, None, None)], "x string, y string, z string")
    assert [r[0] for r in df.select(row_nunique(["x", "y", "z"])).collect()] == [1, 3, 0]


def test_age_bins_right_closed(spark):
    vals = [None, 0.0, 5.0, 40.0, 40.5, 60.0, 75.0, 75.1, 100.0, 101.0]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    got = [r[0] for r in df.select(bin_right_closed("a", AGE_BIN_EDGES, AGE_BIN_LABELS)).collect()]
    assert got == ["nan", "nan", "<40", "<40", "40-60", "40-60", "60-75", "75+", "75+", "nan"]


def test_exclude_codes_keeps_nulls(spark):
    df = spark.createDataFrame([(11,), (None,), (1,)], "d int")
    assert sorted((r[0] is None, r[0]) for r in C.exclude_codes(df, "d", [11, 13]).collect()) == [(False, 1), (True, None)]


def test_top_k_ties_break_by_value(spark):
    rows = [("b",)] * 3 + [("a",)] * 3 + [("c",)] * 3 + [("d",)] * 5 + [(None,)] * 2
    df = spark.createDataFrame(rows, "v string")
    out = {r["v"]: r["n"] for r in C.lump_top_k(df, "v", 2).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert out == {"d": 5, "a": 3, "Other": 8}


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert Ev.roc_auc(df, "y", "s").first()["auc"] is None


def test_auc_ties_half_weight(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    # pairs: (0.5 vs 0.5) half, (0.5 vs 0.1) 1, (0.9 vs 0.5) 1, (0.9 vs 0.1) 1 -> 3.5 / 4
    assert Ev.roc_auc(df, "y", "s").first()["auc"] == 0.875
    assert Ev.roc_auc(df, "y", "s", n_parts=4).first()["auc"] == 0.875


def test_null_group_has_its_own_auc(spark):
    rows = [(None if i % 2 else "a", i % 3 == 0, (i * 37) % 101 / 101) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, y boolean, s double").withColumn("y", F.col("y").cast("int"))
    got = {r["g"]: r["auc"] for r in Ev.roc_auc(df, "y", "s", by=["g"], n_parts=5).collect()}
    alone = Ev.roc_auc(df.filter(F.col("g").isNull()), "y", "s").first()["auc"]
    assert got[None] == alone and alone is not None
    roc = Ev.roc_points(df, "y", "s", by=["g"]).filter(F.col("g").isNull())
    last = roc.agg(F.max("tpr").alias("t"), F.max("fpr").alias("f"), F.min("n_pos").alias("p")).first()
    assert (last["t"], last["f"]) == (1.0, 1.0) and last["p"] > 0


def test_exact_split_keeps_null_labels(spark):
    from riskloom.operators import prep as P

    df = spark.range(1000).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 2).alias("y"))
    out = P.stratified_split(df, "id", "y")
    assert out.count() == 1000
    shares = {r["y"]: (r["n"], r["t"]) for r in out.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert all(t == round(0.2 * n) for n, t in shares.values()) and None in shares


def test_overlapping_and_wide_ranges(spark):
    ranges = spark.createDataFrame([("a", 1, 10), ("b", 5, 20), ("c", 0, 10_000_000_000), ("none", 9, 3)],
                                   "label string, lo long, hi long")
    df = spark.createDataFrame([("7",), ("15.9",), ("5d",), ("9000000000",), ("-1",), (None,), ("7",)], "code string")
    got = sorted(((r["code"] or ""), r["g"]) for r in C.range_lookup_join(df, "code", ranges, "g").collect())
    assert got == [("", "Other"), ("-1", "Other"), ("15.9", "c"), ("5d", "Other"), ("7", "c"), ("7", "c"), ("9000000000", "c")]
    ordered = ranges.withColumn("pos", F.when(F.col("label") == "c", 9).otherwise(F.col("lo")))
    got = {r["code"]: r["g"] for r in C.range_lookup_join(df, "code", ordered, "g", order="pos").collect()}
    assert got["7"] == "a" and got["15.9"] == "b" and got["9000000000"] == "c"
