"""Result tables out and back in as one atomic set.

``write_results`` writes every table into a folder of its own set and then a
manifest, one small file, which names the tables with their paths, schemas and
rows. ``read_results`` follows the newest manifest. A reader so sees a whole
set or the one before; a write that fails leaves the old set readable. Tables
are written by the executors as Parquet, CSV or JSON.

Fixed texts of doubles in CSV and JSON: ``Infinity``, ``-Infinity``, ``NaN``.
In CSV ``\\N`` is null and ``""`` is the empty text.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = {
    "parquet": {},
    "csv": {"header": "true", "positiveInf": "Infinity", "negativeInf": "-Infinity", "nanValue": "NaN", "escape": '"',
            "nullValue": "\\N",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "true"},
    "json": {"ignoreNullFields": "false"},
}
MANIFEST = "version long, name string, path string, format string, schema string, rows long"


def manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The tables of the newest whole set; no rows before the first."""
    try:
        every = spark.read.schema(MANIFEST).json(os.path.join(out_dir, "manifests", "*"))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST)
    last = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == F.lit(last))


def write_results(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """A4: write a set of tables; returns their paths."""
    options = FORMATS[fmt]
    spark = next(iter(tables.values())).sparkSession
    version = (manifest(spark, out_dir).agg(F.max("version")).first()[0] or 0) + 1
    name_of_set = f"{version}-{uuid.uuid4().hex}"
    rows = []
    for name, df in tables.items():
        path = os.path.join("sets", name_of_set, name)
        df.write.options(**options).format(fmt).save(os.path.join(out_dir, path))
        written = spark.read.schema(df.schema).options(**options).format(fmt).load(os.path.join(out_dir, path))
        rows.append((version, name, path, fmt, df.schema.json(), written.count()))
    # last of all: from here on readers see the new set
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(os.path.join(out_dir, "manifests", name_of_set))
    return {r[1]: os.path.join(out_dir, r[2]) for r in rows}


def read_results(spark: SparkSession, out_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """A3: the tables (all, or those named) of the newest set, with the
    schemas they were written with."""
    found = {r["name"]: r for r in manifest(spark, out_dir).collect()}  # one row a table
    lost = [n for n in names or [] if n not in found]
    if lost or not found:
        raise FileNotFoundError(f"{out_dir} holds no result table {', '.join(lost)}".rstrip())
    out = {}
    for name in names or found:
        r = found[name]
        out[name] = (spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).options(**FORMATS[r["format"]])
                     .format(r["format"]).load(os.path.join(out_dir, r["path"])))
    return out
