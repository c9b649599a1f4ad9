"""Sectioned code lookups.

A lookup file holds several sections; a line ``<name>_id,description`` opens
a section and the following ``<int>,<text>`` lines belong to it. Lines with a
non-integer id (blank separators, comments) are skipped. Each file is read
whole (``wholetext``), so the section of a line is found inside its own file
without any global row order; many files are read in parallel.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACKAGED_ID_MAPPING = os.path.join(os.path.dirname(__file__), "data", "id_mapping.csv")
HEADER = r"^\s*([A-Za-z0-9_]+_id)\s*,\s*description\s*$"


def packaged_id_mapping(spark: SparkSession) -> str:
    """The packaged id lookup, copied to the shared folder (readable by every
    executor on a cluster)."""
    from riskloom.session import to_shared

    return to_shared(spark, PACKAGED_ID_MAPPING, "id_mapping.csv")


def read_sectioned_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Long lookup table (section, id, description) from one or many files."""
    files = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    header = F.regexp_extract("line", HEADER, 1)
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = lines.select(
        "line", F.when(header != "", header).alias("__h"),
        F.last(F.when(header != "", header), ignorenulls=True).over(w).alias("section"))
    id_part = F.trim(F.regexp_extract("line", r"^([^,]*),(.*)$", 1))
    text = F.regexp_replace(F.trim(F.regexp_extract("line", r"^([^,]*),(.*)$", 2)), r'^"+|"+$', "")
    return (tagged.filter(F.col("__h").isNull() & F.col("section").isNotNull() & F.col("line").contains(","))
            .select("section", id_part.try_cast("int").alias("id"), text.alias("description"))
            .filter(F.col("id").isNotNull()))
