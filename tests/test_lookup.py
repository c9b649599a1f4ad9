"""Sectioned lookup source (A2) and decode."""

import os

from riskloom.operators import clean as C
from riskloom.sources.lookup import PACKAGED_ID_MAPPING, read_sectioned_lookup


def test_sections_are_kept_apart(spark, tmp_path):
    p = tmp_path / "ids.csv"
    p.write_text('a_id,description\n1,One\n2," Two "\n,\nb_id,description\n1,"Uno, dos"\nx,skip\n\n3,Tres\n')
    got = sorted(tuple(r) for r in read_sectioned_lookup(spark, str(p)).collect())
    # whitespace is trimmed before the quotes are stripped, so inner spaces stay
    assert got == [("a_id", 1, "One"), ("a_id", 2, " Two "), ("b_id", 1, "Uno, dos"), ("b_id", 3, "Tres")]


def test_packaged_lookup_has_three_sections(spark):
    df = read_sectioned_lookup(spark, PACKAGED_ID_MAPPING)
    counts = {r["section"]: r["count"] for r in df.groupBy("section").count().collect()}
    assert counts == {"admission_type_id": 8, "discharge_disposition_id": 30, "admission_source_id": 25}
    assert os.path.exists(PACKAGED_ID_MAPPING)


def test_decode_unmatched_is_unknown(spark):
    lookup = spark.createDataFrame([("t_id", 1, "One")], "section string, id int, description string")
    df = spark.createDataFrame([(1,), (2,), (None,)], "t_id int")
    got = sorted((r["t_id"] is None, r["t"]) for r in C.decode(df, lookup, {"t_id": "t"}).collect())
    assert got == [(False, "One"), (False, "Unknown"), (True, "Unknown")]
