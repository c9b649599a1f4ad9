"""Result sets: round trips in three formats, and one set or the other."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.sources.results import manifest, read_results, write_results

ROWS = [(1, "a", 0.1, True), (2, None, math.inf, None), (3, "", -math.inf, False), (4, "x, \"y\"", None, True),
        (5, " blank ", 1e-300, True)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, name string, value double, flag boolean")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_round_trip(spark, tmp_path, fmt):
    out = str(tmp_path / "set")
    df = table(spark)
    write_results({"t": df, "empty": df.limit(0), "only": df.select("id")}, out, fmt)
    back = read_results(spark, out)
    assert set(back) == {"t", "empty", "only"} and back["t"].schema == df.schema
    assert sorted(map(tuple, back["t"].collect())) == sorted(ROWS)
    assert back["empty"].count() == 0 and back["only"].columns == ["id"]
    assert {r["name"]: r["rows"] for r in manifest(spark, out).collect()} == {"t": 5, "empty": 0, "only": 5}


def test_nan_is_kept(spark, tmp_path):
    for fmt in ("csv", "json"):
        out = str(tmp_path / fmt)
        write_results({"t": spark.createDataFrame([(math.nan,)], "v double")}, out, fmt)
        assert math.isnan(read_results(spark, out)["t"].first()["v"])


def test_a_failed_write_leaves_the_old_set(spark, tmp_path):
    out = str(tmp_path / "set")
    write_results({"a": table(spark), "b": table(spark)}, out)
    bad = table(spark, ROWS[:1]).withColumn("name", F.expr("raise_error('no')"))
    with pytest.raises(Exception, match="no"):
        write_results({"a": table(spark, ROWS[:2]), "b": bad}, out)
    back = read_results(spark, out)
    assert back["a"].count() == 5 and back["b"].count() == 5
    write_results({"a": table(spark, ROWS[:2])}, out, "json")
    back = read_results(spark, out)
    assert set(back) == {"a"} and back["a"].count() == 2


def test_an_open_reader_keeps_its_set(spark, tmp_path):
    out = str(tmp_path / "set")
    write_results({"a": table(spark)}, out)
    old = read_results(spark, out)["a"]
    write_results({"a": table(spark, ROWS[:1])}, out)
    assert old.count() == 5 and read_results(spark, out)["a"].count() == 1


def test_missing_sets_and_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_results(spark, str(tmp_path / "none"))
    write_results({"a": table(spark)}, str(tmp_path / "set"))
    with pytest.raises(FileNotFoundError, match="b"):
        read_results(spark, str(tmp_path / "set"), ["b"])
