"""Risk screening on a stream (SURVEY G9, the only stream-capable operator:
it is stateless).

New order files arrive in a folder. Each micro-batch reads the newest
snapshot of the line items, keeps those of its own orders, and is turned into
encounter features with the same stateless operators as the batch plan, then
aligned, scaled, scored, flagged and banded. A file that arrives later thus
meets the line items that have arrived by then. Results go to a parquet sink
in the shared checkpoint folder, one folder a batch, written over when a batch
is run again, with the stream checkpoint beside it: a restarted query resumes
where it stopped and no row comes twice.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.train import screen
from riskloom.plans.hospital import clean_rows, featurize
from riskloom.session import checkpoint_dir, cut_lineage, sized_broadcast
from riskloom.sources.encounters import encounters_from_orders, per_order_items


def stream_features(raw: DataFrame) -> DataFrame:
    """The batch plan's row-wise cleaning and features: all of it but the
    top-k lumping of a column that is no feature, so it needs no state."""
    return featurize(clean_rows(raw))


def screen_stream(spark: SparkSession, orders_dir: str, lineitem: str | DataFrame, model: PipelineModel | str,
                  scaler: dict, features: list[str], threshold: float, key: str = "encounter_id",
                  file_glob: str = "orders*.parquet", sink: str | None = None,
                  max_files_per_trigger: int | None = None):
    """Start the screening stream; returns (query, sink path). ``lineitem`` is
    the path of the line items, listed anew for each batch, or a fixed table.
    With ``availableNow`` a run processes what is there and stops."""
    orders_schema = spark.read.option("pathGlobFilter", file_glob).parquet(orders_dir).schema
    reader = spark.readStream.schema(orders_schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    base = sink or os.path.join(checkpoint_dir(spark), f"screen-{uuid.uuid4().hex}")
    out = os.path.join(base, "out")

    def batch(orders: DataFrame, batch_id: int) -> None:
        orders = cut_lineage(orders)
        items = orders.sparkSession.read.parquet(lineitem) if isinstance(lineitem, str) else lineitem
        own = sized_broadcast(orders.select(F.col("o_orderkey").alias("l_orderkey")).distinct())
        raw = encounters_from_orders(orders, per_order=per_order_items(items.join(own, "l_orderkey", "left_semi")))
        scored = screen(stream_features(raw), model, scaler, features, threshold, keep=[key])
        scored.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    query = (reader.parquet(orders_dir).writeStream.foreachBatch(batch)
             .option("checkpointLocation", os.path.join(base, "_checkpoint"))
             .trigger(availableNow=True).start())
    return query, out


def run_screen_stream(spark: SparkSession, orders_dir: str, lineitem: str | DataFrame, model: PipelineModel | str,
                      scaler: dict, features: list[str], threshold: float, key: str = "encounter_id",
                      file_glob: str = "orders*.parquet", sink: str | None = None,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over the files present and return the sink as a table."""
    q, out = screen_stream(spark, orders_dir, lineitem, model, scaler, features, threshold, key, file_glob, sink,
                           max_files_per_trigger)
    q.awaitTermination()
    return spark.read.parquet(out).select(key, "prob", "flagged", F.col("band"))
