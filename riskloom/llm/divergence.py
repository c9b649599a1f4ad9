"""Source divergence audit by count cells.

For each language the terms that enough of its documents hold are kept.
Each (language, source) group and the language as a whole give every kept
term a smoothed share ``p``; ``f(p, q) = floor((p - q)^2 / q)`` measures how
far a share lies from another one. Two reports come out, both exact:

* ``term``: the terms a group uses most above its language. Terms with the
  same (count in the group, count in the language) are one cell; ``f`` is
  evaluated per cell, cells of equal value are merged, and the values are
  ranked by the cumulative number of terms before them. Only the values that
  reach the first ranks are expanded into terms, in UTF-8 order.
* ``pair``: the sum of ``f`` over all kept terms between two sources of a
  language. Terms that both hold are summed per cell of the two counts;
  terms that one or none holds follow from the cells of single groups, so a
  term is never expanded for sources that do not hold it.

How it runs: tasks count the words of their texts in bounded tables (a
combiner, flushed at ``TABLE_TERMS`` entries) and one shuffle sums them. A
kept term is one row with its counts by source, so its length is bounded by
the sources of the language, as the rows of a group's pair report are; cells come
from it without another shuffle of the terms. Rankings keep the first ranks
in each task before the shuffle, so a hot group or a large class of ties
never meets in one task.

Cases: a row is a document, also when its doc_id is null or repeated; null
``text``, ``lang`` and ``source`` are ''; a group without terms and a
language without kept terms still give their pairs (value 0 without kept
terms); a source alone in its language has no pairs; only the three columns
are read, so others may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.textkit import slices
from riskloom.session import cut_lineage, sized_broadcast

MIN_DOCS = 3
TOP_TERMS = 200
# Fixed: shares are integers out of this many parts.
PARTS = 1_000_000_000

# Entries of a task's table before it is sent on, and bytes of a text that
# are split at once.
TABLE_TERMS = 400_000
PIECE_BYTES = 1 << 20

# Fixed: a term is a run of ASCII letters and of any non-ASCII characters.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_COUNTED = "lang string, source string, term string, n long, docs long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``PIECE_BYTES``, cut outside terms."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = _BREAK.search(text, at + PIECE_BYTES)
        if cut is None:
            break
        yield text[at: cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _rows(group: tuple[str, str], counts: Counter, docs: Counter) -> pa.RecordBatch:
    """The table of one group as a batch."""
    n = len(counts)
    return pa.record_batch(
        [pa.repeat(pa.scalar(name, pa.string()), n) for name in group]
        + [pa.array(counts.keys(), pa.binary(), size=n).cast(pa.string()),
           pa.array(counts.values(), pa.int64(), size=n),
           pa.array(map(docs.__getitem__, counts), pa.int64(), size=n)],
        names=["lang", "source", "term", "n", "docs"])


def _count(batches) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of a task's texts, in
    parts; a document is never split between two parts."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for batch in batches:
        for part, texts in slices(batch):
            groups = zip(part.column(0).to_pylist(), part.column(1).to_pylist())
            for group, text in zip(groups, texts.cast(pa.large_binary()).to_pylist()):
                seen = set()
                for piece in _pieces(text):
                    terms = _TERM.findall(piece.translate(_LOWER))
                    counts[group].update(terms)
                    seen.update(terms)
                docs[group].update(seen)
            if sum(map(len, counts.values())) >= TABLE_TERMS:
                yield from (_rows(g, counts[g], docs[g]) for g in counts)
                counts, docs = defaultdict(Counter), defaultdict(Counter)
    yield from (_rows(g, counts[g], docs[g]) for g in counts if counts[g])


def _named(docs: DataFrame, lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
            for c, name in ((lang, "lang"), (source, "source"))]


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n_lang, by_source): one row a kept term, with its
    occurrences in the language and in each source that holds it."""
    counted = (docs.select(*_named(docs, lang, source), F.col(text).alias("text")).mapInArrow(_count, _COUNTED)
               .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return (counted.groupBy("lang", "term")
            .agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("_docs"),
                 F.collect_list(F.struct("source", "n")).alias("by_source"))
            .filter(F.col("_docs") >= min_docs).drop("_docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(PARTS * (count + 1) / (total + terms))``, exact for counts
    beyond 64 bits once multiplied."""
    scaled = (count + 1).cast("decimal(19,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return (F.call_function("div", scaled, (total + terms).cast("decimal(20,0)")) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; shares are at most PARTS + 1, so the square
    fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_sizes(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, size, size_lang, terms): every occurring group, with the
    occurrences of kept terms there and in the language, and the number of
    kept terms of the language. One row a group."""
    groups = docs.select(*_named(docs, lang, source)).distinct()
    whole = kept.groupBy("lang").agg(F.sum("n_lang").alias("size_lang"), F.count(F.lit(1)).alias("terms"))
    own = (kept.select("lang", F.explode("by_source").alias("_s"))
           .groupBy("lang", F.col("_s.source").alias("source")).agg(F.sum("_s.n").alias("size")))
    return (groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
            .na.fill(0, ["size", "size_lang", "terms"]))


def rank_terms(kept: DataFrame, sizes: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): per group the first ``top`` of its
    terms whose share is above the language's."""
    rows = kept.select("lang", "term", "n_lang", F.explode("by_source").alias("_s")).select(
        "lang", F.col("_s.source").alias("source"), "term", F.col("_s.n").alias("n"), "n_lang")
    p = share(F.col("n"), F.col("size"), F.col("terms"))
    q = share(F.col("n_lang"), F.col("size_lang"), F.col("terms"))
    cells = cut_lineage(
        rows.groupBy("lang", "source", "n", "n_lang").agg(F.count(F.lit(1)).alias("_m"))
        .join(sized_broadcast(sizes), ["lang", "source"])
        .select("lang", "source", "n", "n_lang", "_m", p.alias("_p"), q.alias("_q"))
        .filter(F.col("_p") > F.col("_q"))
        .select("lang", "source", "n", "n_lang", "_m", gap(F.col("_p"), F.col("_q")).alias("value")))
    down = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    values = (cells.groupBy("lang", "source", "value").agg(F.sum("_m").alias("_m"))
              .withColumn("_i", F.row_number().over(down)).filter(F.col("_i") <= top)
              .withColumn("_before", F.sum("_m").over(down.rowsBetween(Window.unboundedPreceding, -1)))
              .na.fill(0, ["_before"]).filter(F.col("_before") < top)
              .select("lang", "source", "value", "_before"))
    chosen = cut_lineage(cells.drop("_m").join(values, ["lang", "source", "value"]))
    equal = Window.partitionBy("lang", "source", "value").orderBy("item")
    return (rows.join(sized_broadcast(chosen), ["lang", "source", "n", "n_lang"])
            .select("lang", "source", F.col("term").alias("item"), "value", "_before")
            .withColumn("_i", F.row_number().over(equal)).filter(F.col("_i") <= top)
            .withColumn("rank", (F.col("_before") + F.col("_i")).cast("int")).filter(F.col("rank") <= top)
            .select("lang", "source", "item", "value", "rank"))


def rank_pairs(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language.

    With ``f00`` the gap between two terms that neither holds, the sum over
    all terms is ``terms * f00``, plus what each term held by one side
    changes, plus a correction for each term that both hold.
    """
    zero = share(F.lit(0), F.col("size"), F.col("terms"))
    groups = cut_lineage(sizes.withColumn("p0", F.when(F.col("terms") > 0, zero)).drop("size_lang"))
    some = groups.filter(F.col("terms") > 0)

    # terms that both sources hold, by their two counts; each pair once
    one = kept.select("lang", F.explode("by_source").alias("_a"), "by_source")
    two = one.select("lang", F.col("_a.source").alias("a"), F.col("_a.n").alias("na"),
                     F.explode(F.filter("by_source", lambda x: x.source > F.col("_a.source"))).alias("_b"))
    cells = (two.groupBy("lang", "a", F.col("_b.source").alias("b"), "na", F.col("_b.n").alias("nb"))
             .agg(F.count(F.lit(1)).alias("_m")))

    def side(name: str) -> DataFrame:
        return sized_broadcast(some.select(
            "lang", F.col("source").alias(name), F.col("size").alias(f"_size_{name}"),
            F.col("terms").alias(f"_terms_{name}"), F.col("p0").alias(f"_p0_{name}")))

    cells = cells.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).select(
        "lang", "a", "b", "_m", F.col("_p0_a").alias("a0"), F.col("_p0_b").alias("b0"),
        share(F.col("na"), F.col("_size_a"), F.col("_terms_a")).alias("pa"),
        share(F.col("nb"), F.col("_size_b"), F.col("_terms_b")).alias("pb"))

    def extra(p: str, p0: str, q: str, q0: str) -> Column:
        p, p0, q, q0 = map(F.col, (p, p0, q, q0))
        return F.sum(F.col("_m") * (gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)))

    both = cells.groupBy("lang", "a", "b").agg(extra("pa", "a0", "pb", "b0").alias("_ab"),
                                               extra("pb", "b0", "pa", "a0").alias("_ba"))
    both = both.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("_ab").alias("both")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("_ba").alias("both")))).alias("_r"))
    both = both.select("lang", "_r.*")

    # terms of one group against each share that an absent term has in the
    # language: few distinct shares, whatever the number of sources
    single = (kept.select("lang", F.explode("by_source").alias("_s"))
              .groupBy("lang", F.col("_s.source").alias("source"), F.col("_s.n").alias("n"))
              .agg(F.count(F.lit(1)).alias("_m"))
              .join(sized_broadcast(some), ["lang", "source"])
              .select("lang", "source", "_m", "p0", share(F.col("n"), F.col("size"), F.col("terms")).alias("p")))
    absent = sized_broadcast(some.select("lang", F.col("p0").alias("z")).distinct())
    p, p0, z, m = F.col("p"), F.col("p0"), F.col("z"), F.col("_m")
    sides = cut_lineage(single.join(absent, "lang").groupBy("lang", "source", "z").agg(
        F.sum(m * (gap(p, z) - gap(p0, z))).alias("_from"), F.sum(m * (gap(z, p) - gap(z, p0))).alias("_to")))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").filter(F.col("source") != F.col("item"))
    own = sides.select("lang", "source", F.col("z").alias("q0"), "_from")
    its = sides.select("lang", F.col("source").alias("item"), F.col("z").alias("p0"), "_to")
    value = (F.col("terms") * gap(F.col("p0"), F.col("q0")) + F.coalesce("_from", F.lit(0))
             + F.coalesce("_to", F.lit(0)) + F.coalesce("both", F.lit(0)))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return (pairs.join(own, ["lang", "source", "q0"], "left").join(its, ["lang", "item", "p0"], "left")
            .join(both, ["lang", "source", "item"], "left")
            .select("lang", "source", "item", F.coalesce(value, F.lit(0)).cast("long").alias("value"))
            .withColumn("rank", F.row_number().over(order).cast("int")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): both reports."""
    kept = cut_lineage(kept_terms(docs, text, lang, source, min_docs))
    sizes = cut_lineage(group_sizes(docs, kept, lang, source))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (rank_pairs(kept, sizes).withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(rank_terms(kept, sizes, top).withColumn("part", F.lit("term")).select(*columns)))
