"""Encounter tables.

``encounters_from_orders`` derives the 50-column raw encounter table (one row
per order) from the driver's ``orders`` and ``lineitem`` tables. The column
expressions are plain SQL that Spark and DuckDB both accept, so the very same
text feeds our queries and the DuckDB oracle (``encounters_sql``).

``read_encounters`` is the CSV scan of a real encounter extract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import parallelism_floor, table_path

# --- fixed values: the 23 drug columns, in source order (hyphens -> '_') ---
DRUG_COLUMNS = [
    "metformin", "repaglinide", "nateglinide", "chlorpropamide",
    "glimepiride", "acetohexamide", "glipizide", "glyburide",
    "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose",
    "miglitol", "troglitazone", "tolazamide", "examide",
    "citoglipton", "insulin", "glyburide_metformin",
    "glipizide_metformin", "glimepiride_pioglitazone",
    "metformin_rosiglitazone", "metformin_pioglitazone",
]

# --- fixed values: extra NA tokens of the source extract ---
NA_TOKENS = ["?", "Unknown/Invalid", "None"]

# --- fixed values: tokens that a CSV extract's reader takes as missing by default ---
DEFAULT_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: the numeric columns that must be present for a row to be kept.
CRITICAL_NUMERIC = [
    "time_in_hospital", "num_lab_procedures", "num_procedures",
    "num_medications", "number_outpatient", "number_emergency",
    "number_inpatient", "number_diagnoses",
]

_BASE = [
    ("encounter_id", "k"),
    ("patient_nbr", "cust"),
    ("race", "case when (k*7919+13)%100<60 then 'Caucasian' when (k*7919+13)%100<80 then 'AfricanAmerican' "
             "when (k*7919+13)%100<88 then 'Hispanic' when (k*7919+13)%100<93 then 'Asian' "
             "when (k*7919+13)%100<97 then 'Other' else '?' end"),
    ("gender", "case when (k*104729+7)%100<50 then 'Female' when (k*104729+7)%100<99 then 'Male' "
               "else 'Unknown/Invalid' end"),
    ("age", "concat('[', cast(10*((k*31+qty)%10) as string), '-', cast(10*((k*31+qty)%10)+10 as string), ')')"),
    ("weight", "'?'"),
    ("admission_type_id", "cast(1+(k*13+5)%8 as int)"),
    ("discharge_disposition_id", "cast(1+(k*k+3*k)%31 as int)"),
    ("admission_source_id", "cast(1+(k*5+2)%26 as int)"),
    ("time_in_hospital", "cast(1+qty%14 as int)"),
    ("payer_code", "case when k%3=0 then 'MC' else '?' end"),
    ("medical_specialty", "case when (k*17)%40<19 then '?' else concat('spec_', cast(((k*17)%40)*((k*17)%40)%23 as string)) end"),
    ("num_lab_procedures", "cast(1+(k*61+qty)%132 as int)"),
    ("num_procedures", "cast((k*43+nl)%7 as int)"),
    ("num_medications", "cast(1+(qty*3+k)%81 as int)"),
    ("number_outpatient", "cast(case when (k*59+1)%10<8 then 0 else (k*59+1)%5 end as int)"),
    ("number_emergency", "cast(case when (k*67+3)%10<9 then 0 else (k*67+3)%4 end as int)"),
    ("number_inpatient", "cast(case when (k*48271+11)%1000<150 then 2+(k*48271+11)%5 "
                         "when (k*48271+11)%1000<400 then 1 else 0 end as int)"),
    ("diag_1", "case k%9 when 0 then concat('250.', cast(k%84 as string)) when 1 then 'V57' when 2 then 'E888' "
               "when 3 then '?' else cast(1+(k*37)%999 as string) end"),
    ("diag_2", "case k%11 when 0 then '250' when 1 then 'V45' when 2 then '5d' "
               "else concat(cast(1+(k*53)%999 as string), '.5') end"),
    ("diag_3", "case k%13 when 0 then '?' when 1 then '0' else cast(1+(k*71)%999 as string) end"),
    ("number_diagnoses", "cast(1+nl as int)"),
    ("max_glu_serum", "case (k*3+1)%20 when 0 then 'Norm' when 1 then '>200' when 2 then '>300' else 'None' end"),
    ("A1Cresult", "case (k*7+2)%10 when 0 then 'Norm' when 1 then '>7' when 2 then '>8' else 'None' end"),
]

_TAIL = [
    ("change", "case when k%2=0 then 'Ch' else 'No' end"),
    ("diabetesMed", "case when (k*19)%4<3 then 'Yes' else 'No' end"),
    ("readmitted", "case when (k*31+5)%100 < 5 + case when (k*48271+11)%1000<150 then 30 "
                   "when (k*48271+11)%1000<400 then 6 else 0 end then '<30' when k%3=0 then '>30' else 'NO' end"),
]


def _drug_expr(i: int, name: str) -> str:
    m = 4 if name == "insulin" else 20
    return (f"case (k*({101 + 2 * i})+{i})%{m} when 0 then 'Steady' when 1 then 'Up' "
            f"when 2 then 'Down' else 'No' end")


def encounter_columns() -> list[tuple[str, str]]:
    """(name, SQL expression) of the 50 raw encounter columns, in order."""
    drugs = [(d, _drug_expr(i, d)) for i, d in enumerate(DRUG_COLUMNS)]
    return _BASE + drugs + _TAIL


def encounters_sql(orders: str = "orders", lineitem: str = "lineitem") -> str:
    """SQL (Spark and DuckDB) of the raw encounter view over the given tables."""
    cols = ",\n  ".join(f"{e} AS {n}" for n, e in encounter_columns())
    return (
        "SELECT\n  " + cols + "\nFROM (\n"
        "  SELECT o.o_orderkey AS k, o.o_custkey AS cust,\n"
        "         CAST(coalesce(li.nl, 0) AS int) AS nl,\n"
        "         CAST(coalesce(li.qty, 0) AS bigint) AS qty\n"
        f"  FROM {orders} o LEFT JOIN (\n"
        "    SELECT l_orderkey, count(*) AS nl, CAST(sum(l_quantity) AS bigint) AS qty\n"
        f"    FROM {lineitem} GROUP BY l_orderkey) li\n"
        "  ON o.o_orderkey = li.l_orderkey) src"
    )


def per_order_items(lineitem: DataFrame) -> DataFrame:
    """One row per order: line count and total quantity (a partial,
    map-side aggregate before the shuffle on the order key)."""
    return (lineitem.groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("nl"), F.sum("l_quantity").cast("bigint").alias("qty")))


def encounters_from_orders(orders: DataFrame, lineitem: DataFrame | None = None,
                           per_order: DataFrame | None = None) -> DataFrame:
    """Raw encounter table, one row per order (left join: orders without
    line items get nl = qty = 0). Pass ``per_order`` to reuse a computed
    line-item aggregate (e.g. the static side of a stream-static join)."""
    if per_order is None:
        per_order = per_order_items(lineitem)
    src = (orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"))
           .join(per_order, F.col("k") == F.col("l_orderkey"), "left")
           .select("k", "cust",
                   F.coalesce("nl", F.lit(0)).cast("int").alias("nl"),
                   F.coalesce("qty", F.lit(0)).cast("bigint").alias("qty")))
    return src.selectExpr(*[f"{e} AS {n}" for n, e in encounter_columns()])


def load_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = parallelism_floor(spark.read.parquet(table_path(sf_dir, "orders")), "o_orderkey")
    lineitem = spark.read.parquet(table_path(sf_dir, "lineitem"))
    return encounters_from_orders(orders, lineitem)


def encounter_schema() -> T.StructType:
    """Declared schema of a raw encounter extract (no inference at scale)."""
    ints = {"admission_type_id", "discharge_disposition_id", "admission_source_id",
            "time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications",
            "number_outpatient", "number_emergency", "number_inpatient", "number_diagnoses"}
    fields = []
    for name, _ in encounter_columns():
        if name in ("encounter_id", "patient_nbr"):
            t = T.LongType()
        elif name in ints:
            t = T.IntegerType()
        else:
            t = T.StringType()
        fields.append(T.StructField(name, t, True))
    return T.StructType(fields)


CORRUPT = "_corrupt_record"


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """The CSV with every record's text where it does not fit the schema, and
    the number of fields of the header."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header")
    own = {f.name: f for f in schema.fields}
    as_read = [own.get(c, T.StructField(c, T.StringType())) for c in header]
    df = (spark.read.schema(T.StructType([*as_read, T.StructField(CORRUPT, T.StringType())]))
          .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .option("columnPruning", False)  # a pruned reader does not count a record's fields
          .option("escape", '"').option("multiLine", False).csv(path))
    return df, len(header)


def read_encounters(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    na_tokens: list[str] | None = None) -> DataFrame:
    """A1: CSV scan with header and a declared schema. Columns are matched to
    the header by name, in any order: a missing one is an error, further ones
    are left out. The extra NA tokens, on top of the default ones, become
    nulls in the string columns (Spark's reader takes a single nullValue).
    Records that do not fit the header or the types are left out here and
    returned by ``rejected_encounters``; an NA token in a numeric column is a
    null there and no misfit."""
    from riskloom.operators.clean import normalise_nulls

    schema = schema or encounter_schema()
    tokens = [*DEFAULT_NA_TOKENS, *(NA_TOKENS if na_tokens is None else na_tokens)]
    df, fields = _scan(spark, path, _texts(schema))
    fits = normalise_nulls(df.filter(_misfit(schema, fields, tokens).isNull()).select(*schema.names), tokens)
    return fits.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def rejected_encounters(spark: SparkSession, path: str, schema: T.StructType | None = None,
                        na_tokens: list[str] | None = None) -> DataFrame:
    """A1: (reason, column, record): the records that ``read_encounters``
    leaves out. ``short`` and ``long`` have another number of fields than the
    header, ``unparsable`` a number that is none (its first column is named)."""
    schema = schema or encounter_schema()
    tokens = [*DEFAULT_NA_TOKENS, *(NA_TOKENS if na_tokens is None else na_tokens)]
    df, fields = _scan(spark, path, _texts(schema))
    reason = _misfit(schema, fields, tokens)
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*df.columns[:-1])))
    return (df.select(reason.alias("_why"), record.alias("record")).filter(F.col("_why").isNotNull())
            .select("_why.*", "record"))


def reject_counts(rejected: DataFrame) -> DataFrame:
    """Rejected records by reason and column."""
    return rejected.groupBy("reason", "column").agg(F.count(F.lit(1)).alias("n"))


def _texts(schema: T.StructType) -> T.StructType:
    """All columns as text: numbers are parsed after the NA tokens."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])


def _misfit(schema: T.StructType, fields: int, tokens: list[str]) -> Column:
    """(reason, column) of a record that does not fit, else null."""
    bare = F.regexp_replace(F.col(CORRUPT), '"([^"]|"")*"', "")
    found = F.size(F.split(bare, ",", -1))
    why = F.when(F.col(CORRUPT).isNotNull(), F.struct(
        F.when(found < fields, "short").when(found > fields, "long").otherwise("unparsable").alias("reason"),
        F.lit(None).cast("string").alias("column")))
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            text = F.trim(F.col(f.name))
            bad = text.isNotNull() & ~text.isin("", *tokens) & F.col(f.name).try_cast(f.dataType).isNull()
            why = F.coalesce(why, F.when(bad, F.struct(F.lit("unparsable").alias("reason"),
                                                       F.lit(f.name).alias("column"))))
    return why
