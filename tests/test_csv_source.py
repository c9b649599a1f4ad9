"""A1: the CSV scan with a declared schema and the extra NA tokens gives the
same table as the parquet-derived view with the tokens nulled."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.clean import normalise_nulls
from riskloom.sources.encounters import DEFAULT_NA_TOKENS, NA_TOKENS, load_encounters, read_encounters, reject_counts, rejected_encounters

from common import SF_SMALL


def test_csv_roundtrip(spark, tmp_path):
    raw = load_encounters(spark, SF_SMALL)
    path = str(tmp_path / "enc_csv")
    raw.write.option("header", True).csv(path)
    back = read_encounters(spark, path)
    want = normalise_nulls(raw, NA_TOKENS + DEFAULT_NA_TOKENS)
    assert back.schema.simpleString() == want.schema.simpleString()
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    assert back.filter(F.col("race").isNull()).count() == raw.filter(F.col("race") == "?").count()


def test_header_is_matched_by_name(spark, tmp_path):
    raw = load_encounters(spark, SF_SMALL)
    path = str(tmp_path / "shuffled")
    raw.select(F.lit("x").alias("extra"), *reversed(raw.columns)).write.option("header", True).csv(path)
    back = read_encounters(spark, path)
    assert back.columns == raw.columns and back.count() == raw.count()
    short = str(tmp_path / "short")
    raw.drop("race", "age").write.option("header", True).csv(short)
    with pytest.raises(ValueError, match="race, age"):
        read_encounters(spark, short)


def test_default_na_tokens(spark, tmp_path):
    raw = load_encounters(spark, SF_SMALL).limit(4)
    rows = [dict(r.asDict(), medical_specialty=v) for r, v in zip(raw.collect(), ["N/A", "nan", "NULL", "Surgery"], strict=True)]
    path = str(tmp_path / "na")
    spark.createDataFrame(rows, raw.schema).coalesce(1).write.option("header", True).csv(path)
    assert sorted(str(r["medical_specialty"]) for r in read_encounters(spark, path).collect()) == [
        "None", "None", "None", "Surgery"]


def test_records_that_do_not_fit_are_returned_apart(spark, tmp_path):
    raw = load_encounters(spark, SF_SMALL).limit(6)
    lines = [",".join(raw.columns)]
    for i, r in enumerate(raw.collect()):
        fields = ["" if v is None else str(v) for v in r]
        at = raw.columns.index("num_medications")
        if i == 1:
            fields = fields[:-3]
        if i == 2:
            fields.append("more")
        if i == 3:
            fields[at] = "12x"
        if i == 4:
            fields[at] = "?"  # an NA token is a null, no misfit
        if i == 5:
            fields[raw.columns.index("medical_specialty")] = '"Surgery, ""general"""'
        lines.append(",".join(fields))
    (tmp_path / "one.csv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "one.csv")
    kept = {r["encounter_id"]: r for r in read_encounters(spark, path).collect()}
    ids = [r["encounter_id"] for r in raw.collect()]
    assert set(kept) == {ids[0], ids[4], ids[5]}
    assert kept[ids[4]]["num_medications"] is None and kept[ids[5]]["medical_specialty"].startswith("Surgery, ")
    bad = rejected_encounters(spark, path)
    assert sorted((r["reason"], r["column"]) for r in bad.collect()) == [
        ("long", None), ("short", None), ("unparsable", "num_medications")]
    assert all(str(ids[1]) in r["record"] for r in bad.filter("reason = 'short'").collect())
    assert {r["reason"]: r["n"] for r in reject_counts(bad).collect()} == {"long": 1, "short": 1, "unparsable": 1}
