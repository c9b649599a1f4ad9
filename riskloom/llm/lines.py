"""Line dedup: explode normalised lines, hash, count distinct documents per
hash, drop the lines over the threshold and reassemble by position.

Only DataFrame functions. Cases: a null or empty text is one empty line; a
null ``doc_id`` is no document, so its lines neither count nor go; rows that
repeat a ``doc_id`` are the same document and each row is returned; columns
of the input that clash with names used here are not touched, as only the id
and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.graph import spread_join
from riskloom.session import cut_lineage

MIN_KEY_CHARS = 10
MIN_DOCS = 2
# Fixed: white space stripped from a line, and the letters that are lowered.
STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lowered. ``lower`` does the
    same as ``translate`` on a line of ASCII bytes, and faster."""
    bare = F.btrim(line, F.lit(STRIP))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _row_key(doc: str, text: str) -> list[Column]:
    """Identity of a row: rows may repeat a doc_id with another text."""
    return [F.col(doc).alias("_doc"), F.xxhash64(F.col(text)).alias("_ver")]


def key_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text",
             min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(_doc, _ver, _pos, _hash): a 128-bit hash of each key that is long
    enough; the text itself goes no further."""
    rows = (docs.filter(F.col(doc).isNotNull())
            .select(*_row_key(doc, text), F.posexplode(split_lines(F.col(text))).alias("_pos", "_line"))
            .select("_doc", "_ver", "_pos", line_key(F.col("_line")).alias("_key")))
    return (rows.filter(F.length("_key") >= min_chars)
            .select("_doc", "_ver", "_pos", F.unhex(F.md5(F.col("_key").cast("binary"))).alias("_hash")))


def repeated_keys(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_hash, _first): keys of at least ``min_docs`` documents and the
    smallest document that holds each. With two documents the least and the
    greatest id differ, which needs one shuffle; a larger threshold counts
    distinct pairs first, so that a hot line is spread over its documents."""
    if min_docs <= 2:
        seen = keys.groupBy("_hash").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"))
        return seen.filter(F.col("_first") < F.col("_last")).select("_hash", "_first")
    pairs = keys.select("_hash", "_doc").distinct()
    seen = pairs.groupBy("_hash").agg(F.min("_doc").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return seen.filter(F.col("_n") >= min_docs).select("_hash", "_first")


def dropped_positions(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                      min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_doc, _ver, _gone): sorted positions of the lines that each row loses.

    The keys are cut once (28 bytes a line) as they are read several times.
    Rows of hot lines stay in place and meet a broadcast of those few lines.
    """
    keys = cut_lineage(key_rows(docs, doc, text, min_chars))
    gone = (spread_join(keys, cut_lineage(repeated_keys(keys, min_docs)), "_hash")
            .filter(F.col("_doc") != F.col("_first")))
    return gone.groupBy("_doc", "_ver").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))


def kept_lines(lines: Column, gone: Column) -> Column:
    """The lines outside the sorted positions ``gone``: the runs between two
    dropped lines are sliced, so the work is linear in the lines."""
    before = F.concat(F.array(F.lit(-1)), gone)
    after = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, n_lines, n_dropped, kept): one row per input row."""
    gone = dropped_positions(docs, doc, text, min_chars, min_docs)
    base = docs.select(*_row_key(doc, text), F.col(text).alias("_text"))
    lines = split_lines(F.col("_text"))
    none = F.array().cast("array<int>")
    return (base.join(gone, ["_doc", "_ver"], "left")
            .withColumn("_gone", F.coalesce("_gone", none))
            .select(F.col("_doc").alias(doc),
                    F.size(lines).cast("long").alias("n_lines"),
                    F.size("_gone").cast("long").alias("n_dropped"),
                    F.when(F.size("_gone") == 0, F.coalesce("_text", F.lit("")))
                    .otherwise(F.array_join(kept_lines(lines, F.col("_gone")), "\n")).alias("kept")))


def replace_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                  chars: str | None = "n_chars", **params) -> DataFrame:
    """``docs`` with its texts reduced to the kept lines, all columns kept
    (``chars``, when the table has it, follows the new text). Rows whose
    lines all go stay with an empty text; a null text stays null."""
    gone = dropped_positions(docs, doc, text, **params)
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *_row_key(doc, text))
    old = F.col("_row").getField(text)
    new = F.when(F.col("_gone").isNull(), old).otherwise(
        F.array_join(kept_lines(split_lines(old), F.col("_gone")), "\n"))
    out = rows.join(gone, ["_doc", "_ver"], "left").select("_row", "_gone", new.alias("_new"))
    changed = {text: F.col("_new")}
    if chars and chars in docs.columns:
        changed[chars] = (F.when(F.col("_gone").isNull(), F.col("_row").getField(chars))
                          .otherwise(F.length("_new").cast(docs.schema[chars].dataType)))
    return out.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
