"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows: each run of ``window`` consecutive words,
or the whole item where it is shorter. A window is a set of placed shingles
(five words each, or all of a shorter window), and it occurs in a document
exactly where a stretch of its size contains them all in their places.

1. Rarity: one pass over all documents counts the benchmark's shingles there.
   A window with a shingle that never occurs cannot occur and is dropped.
2. Prefix: containment of the whole window makes a single shingle a
   sufficient prefix; each window is filed under its rarest one.
3. Join: a second pass looks the documents' shingles up in those prefixes. A
   match fixes where the window would start (positional bound) and it must
   end inside the document (length bound).
4. Verification: the words at that place must equal the window's words, by
   their lengths and bytes, not only by hash.

The passes are map-only: texts never move. What goes to the tasks are the
benchmark's shingles and the live windows, measured first and split into
blocks of at most ``BLOCK_BYTES``; the blocks of a larger benchmark follow
each other, and the spans they find in a document are merged by a shuffle
that carries spans only.

Cases: null and empty texts have no words; items without a word or without
an id give no windows; equal items and rows that repeat an id count once by
id; a null doc_id is a row like any other and repeated rows are all returned;
an empty benchmark leaves every document clean, an empty table gives an empty
result; only ids and texts are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.textkit import map_texts, mix64, ngram_hashes, ngram_valid, words_of
from riskloom.session import cut_lineage

WINDOW = 10
SHINGLE = 5
# What one pass over the documents may hold of the benchmark, in bytes.
BLOCK_BYTES = 64 << 20

# Fixed: digits, lower-case ASCII letters and all characters beyond ASCII.
MEMBER = np.zeros(256, bool)
MEMBER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_FOUND = "n_words long, spans array<struct<start:long,length:long>>, items array<string>"


def _words(texts):
    return words_of(texts, lower=True, member=MEMBER)


def _shingles(words, size: int) -> np.ndarray:
    """Hash of the shingle of ``size`` words at each word; shingles of
    different sizes differ."""
    return mix64(ngram_hashes(words, size) ^ np.uint64(size))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                 window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, words, size, shingles): the windows of every item, the words
    joined by blanks."""

    def cut(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        words = _words(texts)
        ids = part.column(0).to_pylist()
        data, rows = words.buf.tobytes(), []
        by_size = {k: _shingles(words, k).view(np.int64) for k in range(1, shingle + 1)}
        for d, name in enumerate(ids):
            lo, hi = int(words.bounds[d]), int(words.bounds[d + 1])
            size = min(window, hi - lo)
            if not size:
                continue
            spans = [data[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[lo:hi], words.ends[lo:hi])]
            width = min(shingle, size)
            hashes = by_size[width]
            for at in range(hi - lo - size + 1):
                rows.append((name, " ".join(spans[at: at + size]), size,
                             hashes[lo + at: lo + at + size - width + 1].tolist()))
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.record_batch([pa.array(c, t) for c, t in zip(
            columns, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())))],
            names=["item", "words", "size", "shingles"])

    named = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return map_texts(named.filter(F.col("item").isNotNull()), cut,
                     "item string, words string, size int, shingles array<long>")


class Lookup:
    """Places of hashes in a sorted array: a table by the low bits answers
    most misses, a binary search the rest. Only the keys travel; a worker
    builds the table when it first looks something up."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.table = keys, None

    def __getstate__(self):
        return {"keys": self.keys, "table": None}

    def _build(self) -> None:
        bits = max(10, int(len(self.keys) * 16).bit_length())
        self.mask = np.uint64((1 << min(bits, 27)) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, places in the keys) of all matches."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.table is None:
            self._build()
        at = np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])
        place = np.searchsorted(self.keys, hashes[at])
        hit = self.keys[np.minimum(place, len(self.keys) - 1)] == hashes[at]
        return at[hit], place[hit]


def _matches(words, sizes: list[int], lookup: Lookup) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for size in sizes:
        valid = ngram_valid(words, size)
        at, place = lookup.find(_shingles(words, size))
        inside = valid[at]
        yield at[inside], place[inside]


def shingle_counts(docs: DataFrame, keys: np.ndarray, sizes: list[int], text: str = "text") -> DataFrame:
    """(shingle, n): occurrences of the sorted ``keys`` in all documents; each
    task sums its own first."""
    held = docs.sparkSession.sparkContext.broadcast(Lookup(keys))

    def count(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        lookup = held.value
        places = [p for _, p in _matches(_words(texts), sizes, lookup)]
        found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *places]), return_counts=True)
        return pa.record_batch([pa.array(lookup.keys[found].view(np.int64)), pa.array(n.astype(np.int64))],
                               names=["shingle", "n"])

    return (map_texts(docs.select(F.col(text).alias("text")), count, "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")))


@dataclass
class Windows:
    """The live windows of a block, sorted by prefix, as flat arrays."""

    lookup: Lookup         # distinct prefix hashes, sorted
    first: np.ndarray      # windows of prefix i: first[i]:first[i + 1]
    offset: np.ndarray     # place of the prefix inside the window, in words
    size: np.ndarray       # words of the window
    widths: np.ndarray     # bytes of each word of all windows, in a row
    width_at: np.ndarray
    text: bytes            # the words' bytes without blanks
    text_at: np.ndarray
    items: list[str]
    item_of: np.ndarray    # places in ``items`` of all windows, in a row
    item_at: np.ndarray

    @classmethod
    def build(cls, rows: pa.Table) -> Windows:
        """From (words, size, prefix, offset, items)."""
        prefix = rows["prefix"].to_numpy().view(np.uint64)
        order = np.argsort(prefix, kind="stable")
        prefixes, first = np.unique(prefix[order], return_index=True)
        split = [w.encode().split(b" ") for w in rows["words"].take(order).to_pylist()]
        widths = [np.array([len(w) for w in ws], np.int64) for ws in split]
        joined = [b"".join(ws) for ws in split]
        named = rows["items"].take(order).to_pylist()
        items = sorted({i for group in named for i in group})
        number = {name: i for i, name in enumerate(items)}

        def edges(lengths) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype(np.int64)

        return cls(Lookup(prefixes), np.append(first, len(order)), rows["offset"].to_numpy()[order].astype(np.int64),
                   rows["size"].to_numpy()[order].astype(np.int64), np.concatenate([np.zeros(0, np.int64), *widths]),
                   edges([len(w) for w in widths]), b"".join(joined), edges([len(t) for t in joined]), items,
                   np.array([number[i] for group in named for i in group], np.int64), edges([len(g) for g in named]))


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first:last, the number of the range and each value."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def occurrences(words, windows: Windows, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(first word, window) of every verified occurrence in a slice of texts,
    and the number of candidates that met the bounds."""
    spans = words.ends - words.starts
    inside = np.concatenate([[0], np.cumsum(spans)])
    data = words.buf[MEMBER[words.buf]].tobytes()
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo, hi = (np.repeat(b, np.diff(words.bounds)) for b in (words.bounds[:-1], words.bounds[1:]))
    candidates = 0
    for at, place in _matches(words, sizes, windows.lookup):
        of, window = _expand(windows.first[place], windows.first[place + 1])
        at = at[of]
        start = at - windows.offset[window]
        bounded = (start >= lo[at]) & (start + windows.size[window] <= hi[at])
        start, window = start[bounded], window[bounded]
        candidates += len(start)
        # equal byte lengths of all words, then equal bytes
        of, word = _expand(start, start + windows.size[window])
        _, mine = _expand(windows.width_at[window], windows.width_at[window + 1])
        same = np.ones(len(start), bool)
        same[of[spans[word] != windows.widths[mine]]] = False
        start, window = start[same], window[same]
        a, b = inside[start], inside[start + windows.size[window]]
        c, d = windows.text_at[window], windows.text_at[window + 1]
        equal = np.fromiter((data[i:j] == windows.text[k:m] for i, j, k, m in zip(a, b, c, d)), bool, len(start))
        found_at.append(start[equal])
        found.append(window[equal])
    return np.concatenate(found_at), np.concatenate(found), candidates


def _spans(words, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of the maximal covered runs; none leaves its text."""
    n = len(words.starts)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    covered = np.cumsum(step[:n]) > 0
    edge = np.zeros(n + 1, bool)
    edge[words.bounds] = True
    first = covered.copy()
    first[1:] &= ~covered[:-1] | edge[1:n]
    last = covered.copy()
    last[:-1] &= ~covered[1:] | edge[1:n]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1 - begins


def _lists(values: pa.Array, per_row: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), values)


def _find(docs: DataFrame, block: Windows, sizes: list[int]) -> DataFrame:
    """(_doc, _ver, n_words, spans, items): one row a document row."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def find(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        windows = held.value
        words = _words(texts)
        rows = len(words.bounds) - 1
        start, window, _ = occurrences(words, windows, sizes)
        begins, length = _spans(words, start, windows.size[window])
        row_of = np.searchsorted(words.bounds, begins, side="right") - 1
        doc = np.searchsorted(words.bounds, start, side="right") - 1
        pairs = np.unique(doc * len(windows.size) + window) if len(start) else np.zeros(0, np.int64)
        doc, window = np.divmod(pairs, max(1, len(windows.size)))
        of, at = _expand(windows.item_at[window], windows.item_at[window + 1])
        named = np.unique(doc[of] * max(1, len(windows.items)) + windows.item_of[at])
        doc, item = np.divmod(named, max(1, len(windows.items)))
        spans = pa.StructArray.from_arrays([pa.array(begins - words.bounds[row_of]), pa.array(length)],
                                           names=["start", "length"])
        return pa.record_batch(
            [part.column(0), part.column(1), pa.array(np.diff(words.bounds).astype(np.int64)),
             _lists(spans, np.bincount(row_of, minlength=rows)),
             _lists(pa.array(windows.items, pa.string()).take(pa.array(item)), np.bincount(doc, minlength=rows))],
            names=["_doc", "_ver", "n_words", "spans", "items"])

    kind = docs.schema["_doc"].dataType.simpleString()
    return map_texts(docs, find, f"_doc {kind}, _ver long, {_FOUND}", text="_text")


def merged(start: np.ndarray, length: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of several rows with those that overlap or touch as one: (first
    word, words, spans a row)."""
    row = np.repeat(np.arange(len(per_row)), per_row)
    room = int((start + length).max(initial=0)) + 2
    order = np.argsort(start + row * room, kind="stable")
    row = row[order]
    begin, end = start[order] + row * room, (start + length)[order] + row * room
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = reach[np.append(at[1:], len(begin)) - 1] if len(at) else reach
    return begin[at] - row[at] * room, last - begin[at], np.bincount(row[at], minlength=len(per_row))


def _merge_blocks(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2)
        flat = spans.flatten()
        start, length = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        begin, words, n = merged(start, length, np.diff(spans.offsets.to_numpy()))
        out = pa.StructArray.from_arrays([pa.array(begin), pa.array(words)], names=["start", "length"])
        yield pa.record_batch([batch.column(0), batch.column(1), _lists(out, n), batch.column(3)],
                              names=["_doc", "n_words", "spans", "items"])


def _blocks(rows: DataFrame, width: Column, by: str, block_bytes: int) -> list[DataFrame]:
    """``rows`` in parts of about ``block_bytes`` each, by a hash."""
    total = rows.agg(F.sum(width).alias("b")).first()["b"] or 0
    n = max(1, -(-int(total) // block_bytes))
    if n == 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64(by), F.lit(n)) == i) for i in range(n)]


def live_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(words, size, items, prefix, offset): the distinct windows all of whose
    shingles occur in the documents, each with its rarest shingle."""
    windows = cut_lineage(item_windows(benchmark, item, item_text, window, shingle)
                          .groupBy("words", "size", "shingles").agg(F.collect_set("item").alias("items")))
    keys = cut_lineage(windows.select(F.explode("shingles").alias("shingle")).distinct())
    sizes = _shingle_sizes(windows, shingle)
    counts = None
    for block in _blocks(keys, F.lit(8), "shingle", block_bytes):
        held = np.sort(block.toArrow()["shingle"].to_numpy().view(np.uint64))
        found = shingle_counts(docs, held, sizes, text)
        counts = found if counts is None else counts.unionByName(found)
    counts = cut_lineage(counts)
    placed = windows.select("words", F.posexplode("shingles").alias("offset", "shingle")).join(counts, "shingle")
    rarest = placed.groupBy("words").agg(F.count(F.lit(1)).alias("_n"),
                                         F.min(F.struct("n", "shingle", "offset")).alias("_r"))
    return cut_lineage(windows.join(rarest, "words").filter(F.col("_n") == F.size("shingles"))
                       .select("words", "size", "items", F.col("_r.shingle").alias("prefix"),
                               F.col("_r.offset").alias("offset")))


def _shingle_sizes(windows: DataFrame, shingle: int) -> list[int]:
    found = windows.select(F.least("size", F.lit(shingle)).alias("k")).distinct().collect()
    return sorted(r["k"] for r in found)


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, n_words, spans, items): for every document row its words, the
    stretches of words inside occurrences of benchmark windows, and the items
    those windows belong to, sorted."""
    live = live_windows(docs, benchmark, text, item, item_text, window, shingle, block_bytes)
    rows = docs.select(F.col(doc).alias("_doc"), F.xxhash64(F.col(text)).alias("_ver"), F.col(text).alias("_text"))
    sizes = _shingle_sizes(live, shingle)
    width = F.length("words") * 2 + F.size("items") * 16 + 64
    blocks = _blocks(live, width, "words", block_bytes)
    found = [_find(rows, Windows.build(b.select("words", "size", "prefix", "offset", "items").toArrow()), sizes)
             for b in blocks]
    if len(found) == 1:
        return found[0].select(F.col("_doc").alias(doc), "n_words", "spans", "items")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # equal rows find equal spans, so sets keep a group of copies small
    grouped = every.groupBy("_doc", "_ver").agg(
        F.max("n_words").alias("n_words"), F.collect_set("spans").alias("spans"),
        F.collect_set("items").alias("items"), (F.count(F.lit(1)) / len(found)).cast("int").alias("_copies"))
    one = grouped.select("_doc", "n_words", F.flatten("spans").alias("spans"),
                        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), "_copies")
    kind = one.schema["_doc"].dataType.simpleString()
    return (one.select("_doc", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .drop("col").mapInArrow(_merge_blocks, f"_doc {kind}, {_FOUND}")
            .select(F.col("_doc").alias(doc), "n_words", "spans", "items"))


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The counts and the hash of the items that the registered query returns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s.length)
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select(doc, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))
