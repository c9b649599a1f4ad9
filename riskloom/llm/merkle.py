"""Merkle manifest of a dataset, its proofs exchanged as a butterfly.

Every row is a leaf: the hash of its columns, each written as ``-`` (null) or
as its UTF-8 byte count, ``:`` and its value. The leaves of a source, by
ascending id, are hashed up in runs of ``fanout`` consecutive nodes until one
is left, the source's subroot; the subroots in order of the source are hashed
up in the same way to the root. A row's proof is the rest of its run on every
level, left and right of it.

How it runs. The exact place of each leaf comes from a distributed rank. A
partition of the tree is an aligned block of ``fanout ** levels`` leaves, one
row that hashes its own levels. Then the partitions exchange in rounds: in
round r those that differ in one digit of their number only, at most
``fanout``, swap their subtree hashes, and each of them computes the parent
for itself. All members of a subtree so hold the same ancestor, hashed
redundantly, and after the last round every partition has all upper
proofs; nothing is sent down again. Where the last subtree of a run is
narrower than the others, its members answer for the missing partners as
well. The same rounds go on over the sources, whose members are all their
partitions. A round shuffles one short row a partition.

Cases: a null source is a source of its own, before all others; null ids come
first in their source; rows that repeat an id are ordered by their leaf hash,
and each has a proof; a single leaf is its own subroot and a single source
its own root, with an empty proof; empty and very long texts are hashed
whole; an empty table has no rows (and no root). Columns that are not named
are not read, so they may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.lines import LOWER, UPPER
from riskloom.operators.prefix import global_rank, join_null_safe, prefix_sum
from riskloom.session import cut_lineage, sized_broadcast

FANOUT = 16
LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Hash of a row: length-prefixed values, so no two rows run together."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts]))


def _nodes(row: Column, fanout: int) -> Column:
    """One level up: the hash of every run of ``fanout`` hashes."""
    runs = F.floor((F.size(row) - 1) / fanout).cast("int")
    return F.transform(F.sequence(F.lit(0), runs), lambda i: digest(
        F.array_join(F.slice(row, i * fanout + 1, fanout), "")))


def _beside(row: Column, place: Column, fanout: int) -> Column:
    """The siblings of node ``place`` (from 0) in its run, as joined hashes."""
    digit = place % fanout
    return F.struct(F.array_join(F.slice(row, place - digit + 1, digit), "").alias("l"),
                    F.array_join(F.slice(row, place + 2, fanout - 1 - digit), "").alias("r"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s.l, h, s.r)))


def proof_text(path: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s.l, s.r)), "")


def _swap(rows: DataFrame, active: Column, node: Column, digit: Column, offset: Column, size: Column,
          widest: Column, fanout: int, keep: Sequence[str]) -> DataFrame:
    """One round. ``rows`` (digest, path and ``keep``) are members of subtrees;
    the subtree of a row is child ``digit`` of ``node``, the row is member
    ``offset`` of its ``size`` members, and the widest child of the node has
    ``widest``. Members at the same offset swap their hashes; a narrower child
    answers for the offsets it lacks. Rows that are not ``active`` pass."""
    member = F.struct(*keep, "digest", "path")
    sent = rows.select(
        active.alias("_on"), F.when(active, digit).otherwise(0).cast("int").alias("_digit"), offset.alias("_k"),
        F.when(active, node).otherwise(F.struct(*[F.col(k).cast("long").alias(f"n{i}") for i, k in
                                                  enumerate(("_s", "_chunk", "_s"))])).alias("_node"),
        F.when(active, F.sequence(offset, widest - 1, size)).otherwise(F.array(offset)).alias("_offsets"),
        member.alias("_row"))
    sent = sent.select("_on", "_digit", "_k", "_node", "_row", F.explode("_offsets").alias("_o"))
    entry = F.struct(F.col("_digit").alias("digit"), F.col("_row.digest").alias("h"),
                     F.when(F.col("_o") == F.col("_k"), F.col("_row")).alias("own"), F.col("_on").alias("on"))
    met = sent.groupBy("_on", "_node", "_o").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    met = met.select(F.transform("_all", lambda e: e.h).alias("_h"),
                     F.explode(F.filter("_all", lambda e: e.own.isNotNull())).alias("_e"))
    on, own = F.col("_e.on"), F.col("_e.own")
    beside = _beside(F.col("_h"), F.col("_e.digit"), fanout)
    return met.select(*[own.getField(k).alias(k) for k in keep],
                      F.when(on, digest(F.array_join("_h", ""))).otherwise(own.getField("digest")).alias("digest"),
                      F.when(on, F.concat(own.getField("path"), F.array(beside)))
                      .otherwise(own.getField("path")).alias("path"))


def _rounds(nodes: int, fanout: int) -> int:
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // fanout), n + 1
    return n


def _source_levels(sources: DataFrame, rounds: int, fanout: int) -> DataFrame:
    """For each source and level of the tree over the sources: the chunks
    before its node there, the node's chunks and those of its widest sibling."""
    out = sources
    for t in range(rounds):
        at = F.floor(F.col("_s") / fanout ** t).cast("long")
        nodes = sources.groupBy(at.alias("_n")).agg(F.min("_before").alias(f"_first{t}"),
                                                    F.sum("_chunks").alias(f"_size{t}"))
        up = F.floor(F.col("_n") / fanout).cast("long")
        wide = nodes.groupBy(up.alias("_p")).agg(F.max(f"_size{t}").alias(f"_wide{t}"))
        level = nodes.withColumn("_p", up).join(wide, "_p").drop("_p")
        out = out.withColumn("_n", at).join(level, "_n").drop("_n")
    return out


def exchange(chunks: DataFrame, sources: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(_s, _chunk, subroot, root, path): the proofs above each chunk, from
    (source, _chunk, digest) and the sources' (source, _s, _chunks, _before)."""
    size = sources.agg(F.max("_chunks").alias("c"), F.max("_s").alias("s")).first()
    below, above = _rounds(size["c"] or 1, fanout), _rounds((size["s"] or 0) + 1, fanout)
    rows = join_null_safe(chunks.select("source", "_chunk", "digest"), sized_broadcast(sources), ["source"], "inner")
    rows = rows.select("_s", "_chunk", "_chunks", "digest", F.array().cast(_PATH).alias("path"))

    def key(*parts: Column) -> Column:
        return F.struct(*[p.cast("long").alias(f"n{i}") for i, p in enumerate(parts)])

    for r in range(below):
        wide = fanout ** r
        own = F.floor(F.col("_chunk") / wide).cast("long")
        up = F.floor(F.col("_chunk") / (wide * fanout)).cast("long")
        rows = _swap(rows, F.col("_chunks") > wide, key(F.col("_s"), up, F.lit(r)), own % fanout,
                     F.col("_chunk") - own * wide, F.least(F.lit(wide), F.col("_chunks") - own * wide),
                     F.least(F.lit(wide), F.col("_chunks") - up * wide * fanout), fanout, ["_s", "_chunk", "_chunks"])
    rows = rows.withColumn("subroot", F.col("digest"))
    if above:
        levels = _source_levels(sources, above, fanout).drop("source", "_chunks")
        rows = rows.join(sized_broadcast(cut_lineage(levels)), "_s")
        keep = [c for c in rows.columns if c not in ("digest", "path")]
        for t in range(above):
            own = F.floor(F.col("_s") / fanout ** t).cast("long")
            up = F.floor(F.col("_s") / fanout ** (t + 1)).cast("long")
            rows = _swap(rows, F.lit(True), key(F.lit(-1), up, F.lit(t)), own % fanout,
                         F.col("_before") + F.col("_chunk") - F.col(f"_first{t}"), F.col(f"_size{t}"),
                         F.col(f"_wide{t}"), fanout, keep)
    return rows.select("_s", "_chunk", "subroot", F.col("digest").alias("root"), "path")


def manifest(docs: DataFrame, doc: str = "doc_id", source: str = "source", columns: Sequence[str] = COLUMNS,
             probe: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc, source, leaf, probe, subroot, root, path): every row with the
    proof of its leaf. ``probe`` is another leaf hash of the row that shall be
    held against the proof (null: the leaf itself)."""
    block = fanout ** levels
    leaves = docs.select(F.col(doc).alias("_doc"), F.col(source).cast("string").alias("source"),
                         leaf_hash([F.col(c) for c in columns]).alias("leaf"),
                         (F.lit(None).cast("string") if probe is None else probe).alias("probe"))
    placed = global_rank(leaves, "_doc", by=["source"], tiebreak=["leaf"], out="_at", size="_n")
    at = F.col("_at") - 1
    chunks = (placed.groupBy("source", F.floor(at / block).cast("long").alias("_chunk"))
              .agg(F.first("_n").alias("_n"),
                   F.array_sort(F.collect_list(F.struct(at.alias("at"), "_doc", "leaf", "probe"))).alias("_rows")))
    many = F.col("_n") > block
    chunks = chunks.withColumn("_h0", F.transform("_rows", lambda x: x.leaf))
    for k in range(1, levels + 1):
        below = F.col(f"_h{k - 1}")
        chunks = chunks.withColumn(f"_h{k}", F.when(many | (F.size(below) > 1), _nodes(below, fanout)).otherwise(below))
    chunks = cut_lineage(chunks.withColumn("digest", F.col(f"_h{levels}")[0]).drop(f"_h{levels}"))

    count = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("_chunks")).withColumn("_one", F.lit(1).cast("long"))
    sources = cut_lineage(
        prefix_sum(count, "source", ["_chunks", "_one"], prefix="_to_", inclusive=False)
        .select("source", "_chunks", F.col("_to__one").alias("_s"), F.col("_to__chunks").alias("_before")))
    upper = exchange(chunks, sources, fanout)
    upper = upper.join(sized_broadcast(sources.select("source", "_s")), "_s").drop("_s")
    full = join_null_safe(chunks, cut_lineage(upper), ["source", "_chunk"], "inner")

    # a row a run of leaves: its leaves, and the proof above them that they share
    def above(i: Column) -> Column:
        path = [F.when(many | (F.size(f"_h{k}") > 1), F.array(_beside(
            F.col(f"_h{k}"), F.floor(i / fanout ** (k - 1)).cast("int"), fanout))).otherwise(F.array().cast(_PATH))
            for k in range(1, levels)]
        return F.concat(*path, F.col("path")) if path else F.col("path")

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / fanout).cast("int")),
                       lambda i: F.struct(F.slice("_rows", i * fanout + 1, fanout).alias("rows"), above(i).alias("path")))
    grouped = full.select("source", "subroot", "root", (F.col("_n") > 1).alias("_run"), F.explode(runs).alias("_g"))
    grouped = grouped.select("source", "subroot", "root", "_run", F.col("_g.path").alias("_up"),
                             F.transform("_g.rows", lambda x: x.leaf).alias("_h"),
                             F.posexplode("_g.rows").alias("_i", "_x"))
    first = F.when(F.col("_run"), F.array(_beside(F.col("_h"), F.col("_i"), fanout))).otherwise(F.array().cast(_PATH))
    return grouped.select(F.col("_x._doc").alias(doc), "source", F.col("_x.leaf").alias("leaf"),
                          F.col("_x.probe").alias("probe"), "subroot", "root", F.concat(first, F.col("_up")).alias("path"))


def tampered_leaf(columns: Sequence[str] = COLUMNS, text: str = "text", doc: str = "doc_id", every: int = 5) -> Column:
    """The leaf of a row whose text has its A-Z lower-cased, for rows where
    ``every`` divides the CRC-32 of the id; null for the others."""
    body = F.col(text)
    plain = F.octet_length(body) == F.length(body)
    low = F.when(plain, F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))
    chosen = F.crc32(F.col(doc).cast("string").cast("binary")) % every == 0
    return F.when(chosen, leaf_hash([low if c == text else F.col(c) for c in columns]))


def audit(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The manifest of ``docs`` and the check of a copy with tampered texts."""
    found = manifest(docs, doc, probe=tampered_leaf(doc=doc))
    folded = fold(F.coalesce("probe", "leaf"), F.col("path"))
    return (found.select(doc, "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"),
                         folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
