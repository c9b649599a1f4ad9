"""The corpus pipeline: five stages over ``documents``, each an operator of
``riskloom.llm``, each written as Parquet and read again by the next.

quality rules -> line dedup -> near dedup -> source mixing -> packing

All stages but the last return the columns of ``documents``. A text that
loses lines gets its new ``n_chars``; a document whose lines all go leaves
with the next stage's input, as an empty text is no document to train on.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import lines, mixing, neardup, packing, quality
from riskloom.session import checkpoint_dir, ship_package, table_path

# No SQL: rolling-hash coverage, BagMinHash classes and token ids are beyond it.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    checkpoint_dir(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    _ready(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first that holds them;
    a document left without any word goes too."""
    _ready(spark)
    out = lines.replace_lines(docs)
    return out.filter(F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(lines.STRIP))) > 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    _ready(spark)
    return neardup.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the source schedule."""
    _ready(spark)
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place; the
    sequences follow the positions of the source schedule."""
    _ready(spark)
    return packing.pack(mixing.place(docs, tie=docs.columns), position="mix_position")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what lies between them is written to the shared folder."""
    _ready(spark)
    work = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        path = os.path.join(work, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
