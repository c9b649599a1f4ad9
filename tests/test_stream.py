"""Screening on a stream gives exactly the batch screening result."""

from pyspark.sql import functions as F

from riskloom.operators import train as G
from riskloom.operators.features import FEATURES
from riskloom.plans import catalog_ml as M
from riskloom.plans import hospital as H
from riskloom.plans.catalog_score import SAVED
from riskloom.session import table_path
from riskloom.sources.encounters import load_encounters
from riskloom.streaming.screen import run_screen_stream, stream_features

from common import SF_SMALL


def test_stream_equals_batch(spark):
    m = M.model_bundle(spark, SF_SMALL, "logreg")
    scaler = M.data_bundle(spark, SF_SMALL)["scaler"]
    lineitem = spark.read.parquet(table_path(SF_SMALL, "lineitem"))
    streamed = run_screen_stream(spark, SF_SMALL, lineitem, m, scaler, FEATURES, 0.3)
    batch = G.screen(stream_features(load_encounters(spark, SF_SMALL)), m, scaler, FEATURES, 0.3, keep=["encounter_id"])
    a = {r["encounter_id"]: (round(r["prob"], 12), r["flagged"], r["band"]) for r in streamed.collect()}
    b = {r["encounter_id"]: (round(r["prob"], 12), r["flagged"], r["band"]) for r in batch.collect()}
    assert a == b and len(a) == H.hospital_features(spark, SF_SMALL).count()
    assert set(x[2] for x in a.values()) <= {"High", "Medium", "Low"}
    assert F is not None


def test_stream_features_equal_the_training_features(spark):
    """Missing codes are filled alike, so counts of groups agree row by row."""
    mine = stream_features(load_encounters(spark, SF_SMALL)).select("encounter_id", *FEATURES)
    theirs = H.hospital_features(spark, SF_SMALL).select("encounter_id", *FEATURES)
    assert mine.exceptAll(theirs).count() == 0 and theirs.exceptAll(mine).count() == 0


def test_a_later_file_meets_later_line_items(spark, tmp_path):
    """Orders that arrive after a restart are joined with line items that
    arrived after the start; rows of the first run do not come twice."""
    orders = spark.read.parquet(table_path(SF_SMALL, "orders"))
    items = spark.read.parquet(table_path(SF_SMALL, "lineitem"))
    early = F.col("o_orderkey") % 2 == 0
    folder, line = str(tmp_path / "orders"), str(tmp_path / "lineitem")
    args = (SAVED.probability(), SAVED.scaler, SAVED.features, SAVED.threshold)

    def run():
        return run_screen_stream(spark, folder, line, *args, file_glob="part*", sink=str(tmp_path / "sink"))

    orders.filter(early).coalesce(1).write.parquet(folder)
    items.filter(F.col("l_orderkey") % 2 == 0).write.parquet(line)
    first = run().count()
    assert first == run().count()  # nothing new: a rerun adds nothing
    orders.filter(~early).coalesce(1).write.mode("append").parquet(folder)
    items.filter(F.col("l_orderkey") % 2 == 1).write.mode("append").parquet(line)
    got = {r["encounter_id"]: round(r["prob"], 12) for r in run().collect()}
    whole = G.screen(stream_features(load_encounters(spark, SF_SMALL)), *args, keep=["encounter_id"])
    want = {r["encounter_id"]: round(r["prob"], 12) for r in whole.collect()}
    assert got == want and run().count() == len(want) > first
