"""Registered queries for sources and sinks (A2-A4), the id decode (C1),
the range-table lookup (C4), vector assembly (F6), the phi histogram (J7)
and screening on a stream (G9)."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.functions.clinical import ICD9_GROUPS, NUMBER_PATTERN
from riskloom.operators import clean as C
from riskloom.operators import evaluate as Ev
from riskloom.operators import explain as J
from riskloom.operators import train as G
from riskloom.operators.features import FEATURES
from riskloom.operators.prep import assemble
from riskloom.plans import catalog_ml as M
from riskloom.plans import hospital as H
from riskloom.plans.catalog_eval import _report_sql, YOUDEN_SQL, ev_sql, roc_sql
from riskloom.plans.catalog_score import SAVED, SAVED_SQL
from riskloom.plans.oracle import split_cte, with_views
from riskloom.plans.registry import register
from riskloom.session import checkpoint_dir, table_path
from riskloom.sources.encounters import (
    DEFAULT_NA_TOKENS, NA_TOKENS, encounter_schema, load_encounters, read_encounters, reject_counts,
    rejected_encounters,
)
from riskloom.sources.lookup import (
    HEADER, PACKAGED_ID_MAPPING, packaged_id_mapping, read_sectioned_lookup,
)
from riskloom.sources.results import read_results, write_results
from riskloom.streaming.screen import run_screen_stream

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# DuckDB reads and sections the packaged file itself.
LOOKUP_SQL = rf"""lk_lines AS (
  SELECT generate_subscripts(s, 1) AS pos, unnest(s) AS line
  FROM (SELECT string_split(replace(content, chr(13), ''), chr(10)) AS s FROM read_text({_q(PACKAGED_ID_MAPPING)}))),
lk_heads AS (SELECT pos, line, nullif(regexp_extract(line, '{HEADER}', 1), '') AS h FROM lk_lines),
lk_open AS (SELECT line, h, last_value(h IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS section FROM lk_heads),
lk AS (SELECT section, TRY_CAST(trim(split_part(line, ',', 1)) AS INTEGER) AS id,
              trim(trim(substr(line, strpos(line, ',') + 1)), '"') AS description
       FROM lk_open WHERE h IS NULL AND section IS NOT NULL AND contains(line, ',')
         AND TRY_CAST(trim(split_part(line, ',', 1)) AS INTEGER) IS NOT NULL)"""


@register("a2_sectioned_lookup", with_views("""
SELECT lk.section, lk.id, lk.description, CAST(coalesce(n, 0) AS BIGINT) AS n_encounters
FROM lk LEFT JOIN (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS section, {c} AS id, count(*) AS n FROM enc GROUP BY 2" for c in H.ID_COLUMNS) + """) c
  ON c.section = lk.section AND c.id = lk.id""", extra=LOOKUP_SQL))
def a2_sectioned_lookup(spark, sf_dir):
    """A2: the three id sections as one long table, each entry with the number
    of encounters that carry it."""
    lookup = read_sectioned_lookup(spark, packaged_id_mapping(spark))
    enc = load_encounters(spark, sf_dir).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("section"), F.col(c).alias("id")) for c in H.ID_COLUMNS])).alias("x"))
    counts = enc.groupBy(F.col("x.section").alias("section"), F.col("x.id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_encounters"))
    return (lookup.join(counts, ["section", "id"], "left")
            .select("section", "id", "description", F.coalesce("n_encounters", F.lit(0)).alias("n_encounters")))


_STRING_COLUMNS = [f.name for f in encounter_schema().fields if f.dataType.simpleString() == "string"]
_NA_SQL = ", ".join(_q(t) for t in [*DEFAULT_NA_TOKENS, *NA_TOKENS])


@register("a1_csv_scan", with_views("SELECT * REPLACE (" + ", ".join(
    f'CASE WHEN "{c}" NOT IN ({_NA_SQL}) THEN "{c}" END AS "{c}"' for c in _STRING_COLUMNS) + ") FROM enc"))
def a1_csv_scan(spark, sf_dir):
    """A1: the encounters written as CSV to the shared folder (columns in
    another order, one more than needed) and scanned back."""
    raw = load_encounters(spark, sf_dir)
    path = os.path.join(checkpoint_dir(spark), f"encounters-{uuid.uuid4().hex}.csv")
    (raw.select(*reversed(raw.columns), F.lit("x").alias("further")).write.option("header", True).csv(path))
    return read_encounters(spark, path)


# ids whose records are spoilt: the rest of the id by 10 -> what becomes of the record
_SPOILT = {3: "short", 4: "long", 5: "unparsable"}


def _spoilt_csv(spark, sf_dir) -> str:
    """The encounters as CSV text in which some records have two fields too
    few, one too many, or a word for a number; every file has the header."""
    raw = load_encounters(spark, sf_dir)
    header = ",".join(raw.columns)
    rest = F.col("encounter_id") % 10
    whole = F.to_csv(F.struct(*[F.when(rest == 5, F.lit("many")).otherwise(F.col(c).cast("string")).alias(c)
                                if c == "num_procedures" else F.col(c) for c in raw.columns]))
    cut = F.to_csv(F.struct(*raw.columns[:-2]))
    line = F.when(rest == 3, cut).when(rest == 4, F.concat(whole, F.lit(",x"))).otherwise(whole)

    def with_header(frames):
        yield pd.DataFrame({"value": [header]})
        yield from frames

    path = os.path.join(checkpoint_dir(spark), f"spoilt-{uuid.uuid4().hex}.csv")
    raw.select(line.alias("value")).mapInPandas(with_header, "value string").write.text(path)
    return path


@register("a1_bad_records", with_views("""
SELECT CASE encounter_id % 10 WHEN 3 THEN 'short' WHEN 4 THEN 'long' WHEN 5 THEN 'unparsable' ELSE 'kept' END AS reason,
       CASE WHEN encounter_id % 10 = 5 THEN 'num_procedures' END AS "column", count(*) AS n,
       CASE WHEN encounter_id % 10 NOT IN (3, 4, 5) THEN CAST(sum(encounter_id) AS BIGINT) END AS id_sum
FROM enc GROUP BY 1, 2, encounter_id % 10 NOT IN (3, 4, 5)"""))
def a1_bad_records(spark, sf_dir):
    """A1 over a file with records that do not fit: the kept rows, and the
    rejected ones by reason and column."""
    path = _spoilt_csv(spark, sf_dir)
    kept = read_encounters(spark, path).agg(
        F.lit("kept").alias("reason"), F.lit(None).cast("string").alias("column"), F.count(F.lit(1)).alias("n"),
        F.sum("encounter_id").alias("id_sum"))
    bad = reject_counts(rejected_encounters(spark, path)).withColumn("id_sum", F.lit(None).cast("long"))
    return kept.unionByName(bad)


def _decode_sql() -> str:
    parts = []
    for src, dst in H.ID_COLUMNS.items():
        parts.append(f"coalesce((SELECT min(description) FROM lk WHERE section = '{src}' AND lk.id = e.{src}), "
                     f"'Unknown') AS {dst}")
    return ("SELECT e.encounter_id, e.admission_type_id, e.discharge_disposition_id, e.admission_source_id, "
            + ", ".join(parts) + " FROM enc e")


@register("c1_decode_ids", with_views(_decode_sql(), extra=LOOKUP_SQL))
def c1_decode_ids(spark, sf_dir):
    """Three id columns decoded through the lookup; unmatched -> Unknown."""
    lookup = read_sectioned_lookup(spark, packaged_id_mapping(spark))
    raw = C.normalise_nulls(load_encounters(spark, sf_dir), NA_TOKENS)
    out = C.decode(raw, lookup, H.ID_COLUMNS)
    return out.select("encounter_id", *H.ID_COLUMNS.keys(), *H.ID_COLUMNS.values())


# The ICD-9 ranges in their order, and two wide ones behind them that overlap.
_RANGES = [(i, g, lo, hi) for i, (g, lo, hi) in enumerate(ICD9_GROUPS)] + [
    (100, "Wide_Low", 0, 500_000), (101, "Wide_All", -5, 2_000_000)]
RANGES_SQL = ("rg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(g)}, {lo}, {hi})" for i, g, lo, hi in _RANGES)
              + ") v(pos, label, lo, hi))")


def _range_sql(col: str, out: str) -> str:
    number = (f"CASE WHEN regexp_full_match(trim({col}), '{NUMBER_PATTERN}') "
              f"THEN CAST(trunc(CAST(trim({col}) AS DOUBLE)) AS BIGINT) END")
    return f"""
SELECT encounter_id, {col}, coalesce((SELECT min_by(label, pos) FROM rg WHERE n BETWEEN rg.lo AND rg.hi), 'Other') AS {out}
FROM (SELECT encounter_id, {col}, {number} AS n FROM enc)"""


@register("c4_range_lookup_join", with_views(_range_sql("diag_3", "diag_3_range"), extra=RANGES_SQL))
def c4_range_lookup_join(spark, sf_dir):
    """C4 against a range table with overlaps: integer part of diag_3 -> label
    of the first range, else Other."""
    return _range_join(spark, sf_dir, "diag_3")


@register("c4_range_lookup_join_diag_2", with_views(_range_sql("diag_2", "diag_2_range"), extra=RANGES_SQL))
def c4_range_lookup_join_diag_2(spark, sf_dir):
    """The same on diag_2, which holds codes such as ``5d`` that are no number."""
    return _range_join(spark, sf_dir, "diag_2")


def _range_join(spark, sf_dir, col):
    ranges = spark.createDataFrame(_RANGES, "pos int, label string, lo int, hi int")
    raw = load_encounters(spark, sf_dir).select("encounter_id", col)
    return C.range_lookup_join(raw, col, ranges, f"{col}_range", order="pos")


@register("a4_results_roundtrip", ev_sql(
    _report_sql("0.5") + " UNION ALL " + _report_sql("(SELECT threshold FROM yd)"),
    extra=roc_sql("scored", []) + ",\n" + YOUDEN_SQL))
def a4_results_roundtrip(spark, sf_dir):
    """A4 then A3: write the threshold report (and the ROC table) to a
    results folder in the shared checkpoint folder and read it back."""
    scored = H.scored_test(spark, sf_dir)
    roc = Ev.roc_points(scored, "label", "score")
    best = Ev.youden_threshold(roc).first()["threshold"]
    report = Ev.threshold_report(scored, "label", "score", [0.5, float(best)])
    out = os.path.join(checkpoint_dir(spark), f"results-{uuid.uuid4().hex}")
    write_results({"threshold_report": report, "roc_points": roc}, out)
    return read_results(spark, out, ["threshold_report"])["threshold_report"]


def _roc_through(spark, sf_dir, fmt: str):
    """The ROC table (its first threshold is +inf) through a result set."""
    out = os.path.join(checkpoint_dir(spark), f"results-{uuid.uuid4().hex}")
    roc = Ev.roc_points(H.scored_test(spark, sf_dir), "label", "score")
    write_results({"roc_points": roc, "summary": roc.agg(F.count(F.lit(1)).alias("n"))}, out, fmt)
    return read_results(spark, out, ["roc_points"])["roc_points"]


@register("a3_results_csv", ev_sql("SELECT * FROM roc", extra=roc_sql("scored", [])))
def a3_results_csv(spark, sf_dir):
    return _roc_through(spark, sf_dir, "csv")


@register("a3_results_json", ev_sql("SELECT * FROM roc", extra=roc_sql("scored", [])))
def a3_results_json(spark, sf_dir):
    return _roc_through(spark, sf_dir, "json")


@register("f6_assemble", with_views(
    "SELECT encounter_id, [" + ", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES) + "] AS features FROM feat",
    "feat"))
def f6_assemble(spark, sf_dir):
    """the 24 features as one vector next to the key (shown as array)."""
    df = assemble(H.hospital_features(spark, sf_dir), FEATURES, keep=[H.KEY])
    return df.select(H.KEY, vector_to_array("features").alias("features"))


@register("j7_phi_histogram", M.lin_sql("""
SELECT b.bin, r.lo + b.bin * (r.hi - r.lo) / 30.0 AS bin_lo, r.lo + (b.bin + 1) * (r.hi - r.lo) / 30.0 AS bin_hi,
       CAST(coalesce(h.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b
CROSS JOIN r
LEFT JOIN (SELECT CAST(least(floor((phi - r.lo) / ((r.hi - r.lo) / 30.0)), 29) AS INTEGER) AS bin, count(*) AS n
           FROM shap, r WHERE feature = 'num_lab_procedures' AND phi >= r.lo AND phi <= r.hi GROUP BY 1) h ON b.bin = h.bin
""").replace("\nSELECT b.bin", ",\nr AS (SELECT min(phi) AS lo, CASE WHEN max(phi) > min(phi) THEN max(phi) "
             "ELSE min(phi) + 1.0 END AS hi FROM shap WHERE feature = 'num_lab_procedures')\nSELECT b.bin", 1))
def j7_phi_histogram(spark, sf_dir):
    """30-bin histogram of one feature's phi. Integer features give phi on
    a lattice; a feature whose value range (131) shares no factor with the
    bin count keeps lattice points off the interior bin edges, so the check
    does not hinge on the last bit of the weights."""
    return J.phi_histogram(M._linear_shap(spark, sf_dir), "num_lab_procedures", 30)


@register("g9_screen_stream")
def g9_screen_stream(spark, sf_dir):
    """G9 on Structured Streaming: order files -> stream-static join with the
    line-item aggregate -> stateless features -> align/scale/score/band,
    appended to a parquet sink (availableNow trigger)."""
    m = M.model_bundle(spark, sf_dir, "logreg")
    d = M.data_bundle(spark, sf_dir)
    return run_screen_stream(spark, sf_dir, table_path(sf_dir, "lineitem"), m, d["scaler"], FEATURES, 0.5)


@register("g9_screen_stream_saved", with_views(
    f"SELECT encounter_id, prob, prob >= {SAVED.threshold}::DOUBLE AS flagged, "
    f"CASE WHEN prob >= {SAVED.threshold}::DOUBLE THEN 'High' WHEN prob >= {0.6 * SAVED.threshold!r}::DOUBLE THEN 'Medium' "
    "ELSE 'Low' END AS band FROM saved", "feat", extra=SAVED_SQL.replace("FROM te)", "FROM feat)")))
def g9_screen_stream_saved(spark, sf_dir):
    """G9 on the stream by value: the saved model over every arriving order."""
    return run_screen_stream(spark, sf_dir, table_path(sf_dir, "lineitem"), SAVED.probability(), SAVED.scaler,
                             SAVED.features, SAVED.threshold)


@register("g9_bands", ev_sql("""
SELECT encounter_id, score AS prob, score >= 0.3 AS flagged,
       CASE WHEN score >= 0.3 THEN 'High' WHEN score >= 0.6::DOUBLE * 0.3::DOUBLE THEN 'Medium' ELSE 'Low' END AS band FROM scored"""))
def g9_bands(spark, sf_dir):
    """The flag and the risk band of G9 on the deterministic score."""
    rows = H.scored_test(spark, sf_dir).select("encounter_id", F.col("score").alias("prob"))
    return G.band(rows, 0.3, keep=["encounter_id"])


@register("a5_bundle_roundtrip", with_views(
    "SELECT count(*) AS n_rows, count(*) AS n_same FROM te", "feat", extra=split_cte()))
def a5_bundle_roundtrip(spark, sf_dir):
    """A5: model, scaler and feature list saved as one bundle, loaded back and
    used to screen the raw test rows; rows on which the saved and the fitted
    one agree."""
    d = M.data_bundle(spark, sf_dir)
    m = M.model_bundle(spark, sf_dir, "logreg")
    path = os.path.join(checkpoint_dir(spark), f"bundle-{uuid.uuid4().hex}")
    G.save_bundle(spark, m, d["scaler"], FEATURES, path)
    model, scaler, features = G.load_bundle(spark, path)
    raw = H.hospital_features(spark, sf_dir).join(d["test"].select(H.KEY), H.KEY, "left_semi")
    a = G.screen(raw, m, d["scaler"], FEATURES, 0.4, keep=[H.KEY])
    b = G.screen(raw, model, scaler, features, 0.4, keep=[H.KEY]).select(
        H.KEY, F.col("prob").alias("p2"), F.col("band").alias("b2"))
    same = (F.abs(F.col("prob") - F.col("p2")) < 1e-12) & (F.col("band") == F.col("b2"))
    return a.join(b, H.KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(same.cast("long")).alias("n_same"))
