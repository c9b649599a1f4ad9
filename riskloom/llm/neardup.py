"""Near copies by BagMinHash: weighted Jaccard of the multisets of five-word
shingles, at 0.8 or more.

A shingle that occurs w times is an element of weight w. Weights are
discretised at the integers and the levels are grouped by doubling ranges
(0,1], (1,2], (2,4], ...; every range of a shingle has its own Poisson
process, whose points carry a time, a component and a level. A point counts
when its level is not above the weight. The least time per component is the
signature: two texts agree in a component with probability equal to their
weighted Jaccard similarity. Points are drawn in rounds, and only while a
text may still need them.

Signatures are cut into bands. In a bucket the members are compared with a
leader, the one that meets most others; what stays in different components
is then compared in full, behind a test of the signatures' low bits. All
pairs are verified on the texts' whole shingle multisets, and links join
documents into classes. In large buckets the verification is part of the join
condition, so that only links leave it, never the pairs of a group. Texts with the same words form one node, so groups of copies
cost one row each and their members are never paired.

Cases: a text without words (null, empty, blank) is a class of its own; a
text of fewer than five words is one shingle; a null id takes its group's
class (null when it is alone); rows that repeat an id or a text are returned
one by one; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as T
from riskloom.llm.graph import components, spread_join
from riskloom.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
SIZE = 128             # components of a signature; a power of two
BANDS, ROWS = 25, 5    # 0.8 ** 5: a pair at the threshold is missed 5 times in 100,000
# Low bits kept of each component, and the components of 128 that may differ
# in them: at 0.8 the mean is 24 with a deviation of 4.4; four above.
PLANES, MAX_DIFFER = 4, 41
LARGE = 64             # members of a bucket beyond which pairs are verified inside the join
CELL = 128             # members of a large bucket that one cell of that join holds
PAIRS_PER_SALT = 20_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA3B195354A39B70D))


# --------------------------------------------------------------- signatures

def content_hashes(words: T.Words) -> np.ndarray:
    """(texts, 2) hashes of the word sequence of each text."""
    n = len(words.bounds) - 1
    out = np.zeros((n, 2), np.uint64)
    if not len(words.hashes):
        return out
    local = np.arange(len(words.hashes)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
    for k, odd in enumerate(_ODD):
        terms = T.mix64(words.hashes * odd + local.astype(np.uint64) * _GOLD)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        out[:, k] = T.mix64(total[words.bounds[1:]] - total[words.bounds[:-1]])
    return out


def shingles(words: T.Words, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle occurrence, by text. A text of fewer than
    ``SHINGLE`` words has one, of all its words."""
    h = T.mix64(T.ngram_hashes(words, SHINGLE))
    ok = T.ngram_valid(words, SHINGLE)
    docs, keys = words.docs[ok], h[ok]
    count = np.diff(words.bounds)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    docs = np.concatenate([docs, short])
    keys = np.concatenate([keys, content[short, 0]])
    return docs, keys


def weighted(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with their counts, in text order."""
    order = np.lexsort((keys, docs)) if len(docs) else np.zeros(0, np.int64)
    docs, keys = docs[order], keys[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return docs[at], keys[at], np.diff(np.concatenate([at, [len(docs)]]))


def bag_minhash(docs: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int,
                size: int = SIZE) -> np.ndarray:
    """(n, size) signature of each text's weighted shingles (inf without)."""
    least = np.full(n * size, np.inf)
    top = np.zeros(len(keys), np.int64)
    over = weights > 1
    top[over] = np.ceil(np.log2(weights[over])).astype(np.int64)
    parts = [(docs, keys, weights, np.zeros(len(keys), np.int64))]
    for level in range(1, int(top.max(initial=0)) + 1):
        at = top >= level
        parts.append((docs[at], keys[at], weights[at], np.full(int(at.sum()), level)))
    doc, key, weight, level = (np.concatenate(x) for x in zip(*parts, strict=True))
    span = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.int64)
    state = T.mix64(key + level.astype(np.uint64) * _ODD[0])
    time = np.zeros(len(doc))
    while len(doc):
        state = state + _GOLD
        draw = T.mix64(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / span
        part = (draw & np.uint64(size - 1)).astype(np.int64)
        wide = span > 1
        use = slice(None)
        if wide.any():
            pick = T.mix64(draw ^ _ODD[1])
            at = span + 1 + (pick % span.astype(np.uint64)).astype(np.int64)
            use = ~wide | (at <= weight)
        np.minimum.at(least, doc[use] * size + part[use], time[use])
        worst = least.reshape(n, size).max(axis=1)
        on = time <= worst[doc]
        doc, weight, span, state, time = doc[on], weight[on], span[on], state[on], time[on]
    return least.reshape(n, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    values = T.mix64(np.ascontiguousarray(signature).view(np.uint64))
    out = np.zeros((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = T.mix64(h * _GOLD + values[:, b * rows + r])
        out[:, b] = h
    return out


def low_bits(signature: np.ndarray) -> np.ndarray:
    """(texts, 2 * PLANES): the low bits of 128 components, by plane."""
    values = T.mix64(np.ascontiguousarray(signature[:, :128]).view(np.uint64) ^ _ODD[0])
    planes = [np.packbits(((values >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=1) for p in range(PLANES)]
    return np.concatenate(planes, axis=1).view(np.uint64)


def _binary(pairs: np.ndarray, present: np.ndarray) -> pa.Array:
    values = [x.tobytes() if ok else None for x, ok in zip(pairs, present, strict=True)]
    return pa.array(values, pa.binary())


def signatures(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ver, node, bits, buckets); ``node`` is a 128-bit hash
    of the words, null for a text without words; ``ver`` tells rows apart
    that repeat an id with another text."""
    inner = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text)).alias("ver"),
                        F.col(text).alias("_text"))
    schema = (f"doc_id {docs.schema[doc].dataType.simpleString()}, ver long, node binary, "
              "bits array<long>, buckets array<long>")

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        words = T.words_of(texts, lower=True)
        content = content_hashes(words)
        present = np.diff(words.bounds) > 0
        found = bag_minhash(*weighted(*shingles(words, content)), len(texts))
        keys = band_keys(found).view(np.int64)
        bits = low_bits(found).view(np.int64)
        rows = np.arange(len(texts) + 1, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(rows * x.shape[1]), pa.array(x.reshape(-1)))
                 for x in (bits, keys)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary(content, present), *lists],
                                          ["doc_id", "ver", "node", "bits", "buckets"])

    return T.map_texts(inner, run, schema, "_text")


# ------------------------------------------------------------- verification

def profiles(docs: DataFrame, wanted: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, items): the shingles of each wanted node as a set, the k-th
    occurrence of a shingle being an item of its own, so that set overlap is
    multiset overlap. ``wanted`` is (doc_id, node)."""
    inner = (docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_text"))
             .join(wanted.withColumnRenamed("node", "_node"), "doc_id").select("_node", "_text"))

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        words = T.words_of(texts, lower=True)
        content = content_hashes(words)
        owner, keys = shingles(words, content)
        order = np.lexsort((keys, owner)) if len(owner) else np.zeros(0, np.int64)
        owner, keys = owner[order], keys[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
        at = np.flatnonzero(new)
        nth = np.arange(len(owner)) - np.repeat(at, np.diff(np.concatenate([at, [len(owner)]])))
        items = np.where(nth > 0, T.mix64(keys + nth.astype(np.uint64) * _ODD[1]), keys)
        ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [part.column(0), _binary(content, np.diff(words.bounds) > 0),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(items.view(np.int64)))],
            ["_node", "node", "items"])

    rows = T.map_texts(inner, run, "_node binary, node binary, items array<long>", "_text")
    # an id may repeat with another text; a node has one profile
    return rows.filter("_node = node").select("node", "items").dropDuplicates(["node"])


def similar(items: Column, others: Column, threshold: float) -> Column:
    both = F.size(F.array_intersect(items, others))
    return both >= threshold * (F.size(items) + F.size(others) - both)


def verified(pairs: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose shingle multisets reach the threshold. A leader
    ``a`` of many pairs is dealt into salts; its profile goes once to each."""
    pairs = cut_lineage(pairs.distinct())
    salts = max(16, -(-pairs.count() // PAIRS_PER_SALT))
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    left = (salted.select("a", "_salt").distinct()
            .join(known.select(F.col("node").alias("a"), F.col("items").alias("_x")), "a"))
    right = salted.join(known.select(F.col("node").alias("b"), F.col("items").alias("_y")), "b")
    return (right.join(left, ["a", "_salt"])
            .filter(similar(F.col("_x"), F.col("_y"), threshold)).select("a", "b"))


# ------------------------------------------------------------------ classes

def _close(x: Column, y: Column) -> Column:
    """The signatures' low bits allow the threshold."""
    differ = F.lit(0)
    for half in range(2):
        bits = F.lit(0).cast("long")
        for p in range(PLANES):
            bits = bits.bitwiseOR(x[2 * p + half].bitwiseXOR(y[2 * p + half]))
        differ = differ + F.bit_count(bits)
    return differ <= MAX_DIFFER


def links(docs: DataFrame, sigs: DataFrame, doc: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified edges (a, b) between nodes and the (node, root) they imply."""
    nodes = (sigs.filter(F.col("node").isNotNull()).groupBy("node")
             .agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("buckets").alias("buckets")))
    nodes = cut_lineage(nodes)
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut_lineage(rows.join(sizes, "bucket"))
    # how often a node meets others: the centre of a group leads its buckets;
    # a node that never meets another is done
    degree = shared.groupBy("node").agg(F.sum("n").alias("_d"))
    meeting = cut_lineage(nodes.join(degree, "node"))
    known = cut_lineage(profiles(docs, meeting.filter(F.col("rep").isNotNull())
                                 .select(F.col("rep").alias("doc_id"), "node"), doc, text))
    ranked = cut_lineage(shared.join(meeting.select("node", "bits", "_d"), "node"))
    best = (ranked.groupBy("bucket").agg(F.max(F.struct("_d", "node", "bits")).alias("_top"))
            .select("bucket", F.col("_top.node").alias("a"), F.col("_top.bits").alias("_lead")))
    met = cut_lineage(spread_join(ranked, best, "bucket", count="n")
                      .select("bucket", "n", "node", "a",
                              ((F.col("node") != F.col("a")) & _close(F.col("bits"), F.col("_lead"))).alias("_near")))
    edges = cut_lineage(verified(met.filter("_near").select("a", F.col("node").alias("b")), known, threshold))
    roots = components(edges)
    more = cut_lineage(_apart(met, meeting, known, edges, roots, threshold))
    edges = edges.unionByName(more)
    if more.take(1):
        # what the new edges join are whole components
        first, second = (roots.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")) for x in "ab")
        ends = (more.join(first, "a", "left").join(second, "b", "left")
                .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct())
        higher = components(ends).withColumnRenamed("root", "_top")
        lone = higher.select("node", F.col("_top").alias("root")).join(roots, "node", "left_anti")
        roots = cut_lineage(roots.join(higher.withColumnRenamed("node", "root"), "root", "left")
                            .select("node", F.coalesce("_top", "root").alias("root")).unionByName(lone))
    return edges, roots


def _apart(met: DataFrame, meeting: DataFrame, known: DataFrame, edges: DataFrame, roots: DataFrame,
           threshold: float) -> DataFrame:
    """Verified edges between members of a bucket that the leaders left in
    different components: each member outside the leader's component against
    all others, every pair in the first bucket that it shares."""
    # a node is in as many buckets as there are bands, so no node is hot; as
    # leaders they may be, one row a bucket
    lead = (met.select("bucket", "a").distinct()
            .join(roots.select(F.col("node").alias("a"), F.col("root").alias("_main")), "a", "left"))
    placed = (met.select("bucket", "n", "node").join(roots, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    placed = cut_lineage(placed.join(lead, "bucket")
                         .select("bucket", "n", "node", "root", (F.col("root") != F.coalesce("_main", "a")).alias("_rest")))
    still = placed.filter("_rest").select("bucket").distinct()
    still = placed.join(still, "bucket", "left_semi").join(meeting.select("node", "bits", "buckets"), "node")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    first = F.array_min(F.array_intersect(x("buckets"), y("buckets"))) == x("bucket")
    open_pair = (x("root") != y("root")) & (~y("_rest") | (x("node") < y("node")))
    may = F.when(open_pair & _close(x("bits"), y("bits")), first).otherwise(F.lit(False))

    def pairs(some: DataFrame, others: DataFrame, met_in: Column, condition: Column) -> DataFrame:
        return some.alias("x").join(others.alias("y"), met_in & condition).select(y("node").alias("a"), x("node").alias("b"))

    same = x("bucket") == y("bucket")
    small = still.filter(F.col("n") <= LARGE)
    few = pairs(small.filter("_rest"), small, same, may)
    large = cut_lineage(still.filter(F.col("n") > LARGE).join(known, "node"))
    some, others = in_cells(large)
    similar_pair = F.when(may, similar(x("items"), y("items"), threshold)).otherwise(F.lit(False))
    many = pairs(some, others, same & (x("_cell") == y("_cell")), similar_pair)
    return verified(few, known, threshold).unionByName(many)


def in_cells(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of large buckets that still look for others, and all
    members, dealt so that each of the former meets each of the latter once:
    a member lies in one cell of its bucket, of about ``CELL`` members, and who
    looks visits them all. Cells are even, so both sides are partitioned by
    them for good: a bucket that is hot on both sides would be split on both by
    the adaptive join, into the product of the splits."""
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = F.ceil(F.col("n") / CELL)
    others = large.withColumn("_cell", F.pmod(F.xxhash64("node", "bucket"), cells))
    some = large.filter("_rest").withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)))
    return tuple(side.repartition(parts, "bucket", "_cell") for side in (some, others))


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """(doc, ver, class_id, root): one row per input row; the class is its
    smallest document id, the root names its component."""
    sigs = cut_lineage(signatures(docs, doc, text))
    _, roots = links(docs, sigs, doc, text, threshold)
    members = sigs.select("doc_id", "ver", "node")
    reps = cut_lineage(members.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"))
                       .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = reps.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_node = cut_lineage(reps.select("node", "root").join(least, "root"))
    # nodes of many copies are hot keys here
    return (spread_join(members, by_node, "node", "left")
            .select(F.col("doc_id").alias(doc), "ver",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    "root"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, of its smallest id (null ids only
    when a class has no other); equal rows without words count as one."""
    found = classes(docs, doc, text, threshold)
    chosen = (found.filter(F.col(doc).eqNullSafe(F.col("class_id")))
              .withColumn("_own", F.when(F.col("root").isNull(), F.col("ver")))
              .groupBy(F.col(doc).alias("_doc"), "root", "_own").agg(F.min("ver").alias("_ver"))
              .select("_doc", "_ver").distinct())
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc).alias("_id"),
                       F.xxhash64(F.col(text)).alias("_v"))
    kept = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_v") == F.col("_ver")))
    return kept.dropDuplicates(["_doc", "_ver"]).select("_row.*")
