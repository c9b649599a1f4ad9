"""Best-fit packing by patterns: enumerate patterns of a few lengths, fit how
often each repeats to the length histogram by non-negative least squares,
round, and pack what is left by best fit.

Only the histogram of piece lengths (at most ``max_tokens`` rows) comes to
the driver. The plan made from it says where the n-th piece of each length
goes; pieces are ranked within their length in parallel. Which of two pieces
of one length takes which place does not matter for the fill; a fixed order
decides, or the ``position`` of the documents: then earlier documents take the
earlier places of their length, and sequences are numbered by the least
position they hold. Cases: a null or empty text is the end token alone; a longer
text is cut at ``max_tokens``; repeated rows are packed one by one; a null id
is returned as null; an empty table gives an empty result; only the id and
the text are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as T
from riskloom.llm import tokens
from riskloom.operators.prefix import global_rank
from riskloom.session import cut_lineage

MAX_TOKENS = 4096
END_ID = 1
UNITS = 64             # resolution of the patterns
PATTERN_DOCS = 3       # documents in a pattern at most
RANGE_ROWS = 100_000   # pieces ranked together

PIECE_SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, doc: str = "doc_id", text: str = "text",
              tokenizer: str | None = None, max_tokens: int = MAX_TOKENS,
              position: str | None = None) -> DataFrame:
    """The pieces of every document: one row each, without the ids; with the
    document's place in ``_pos`` if ``position`` names its column."""
    with open(tokenizer or tokens.default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[doc].dataType.simpleString()
    end = np.asarray([END_ID], "<u4").tobytes()
    extra = int(position is not None)

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        table = tokens.word_ids(spec.value)
        row, piece, start, length, crc = [], [], [], [], []
        for i, value in enumerate(texts.to_pylist()):
            ids = table.encode(value) + end
            n = len(ids) // 4
            for k, at in enumerate(range(0, n, max_tokens)):
                upto = min(at + max_tokens, n)
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(upto - at)
                crc.append(zlib.crc32(ids[4 * at: 4 * upto]))
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(at), pa.array(piece, pa.int32()),
             pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
             *[part.column(1).take(at)] * extra],
            ["doc_id", "piece", "start", "length", "ids_crc32", *["_pos"] * extra])

    placed = [F.col(position).cast("long").alias("_pos")] if extra else []
    inner = docs.select(F.col(doc).alias("doc_id"), *placed, F.col(text).alias("_text"))
    return T.map_texts(inner, run, PIECE_SCHEMA.format(id=id_type) + ", _pos long" * extra, "_text")


# ------------------------------------------------------------------ the plan

def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b|, x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 3 * n):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        if passive.all() or gain.max() <= tol:
            break
        passive[int(gain.argmax())] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min() > 0:
                x = s
                break
            bad = passive & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(units: int = UNITS, docs: int = PATTERN_DOCS) -> list[tuple[int, ...]]:
    """Falling sizes of at most ``docs`` documents that fill ``units``."""
    found: list[tuple[int, ...]] = []

    def grow(left: int, most: int, so_far: tuple[int, ...]) -> None:
        if left == 0:
            found.append(so_far)
        elif len(so_far) < docs:
            for size in range(min(left, most), 0, -1):
                grow(left - size, size, (*so_far, size))

    grow(units, units, ())
    return found


class Pool:
    """How many pieces of each length are left, and the rank of the next."""

    def __init__(self, histogram: dict[int, int], most: int):
        self.left = np.zeros(most + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.used = np.zeros(most + 1, np.int64)

    def largest(self, low: int, high: int) -> int:
        """The largest length in [low, high] that is left, else 0."""
        hit = np.flatnonzero(self.left[low: high + 1])
        return low + int(hit[-1]) if len(hit) else 0

    def take(self, length: int, n: int) -> int:
        rank = int(self.used[length])
        self.used[length] += n
        self.left[length] -= n
        return rank


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS,
         units: int = UNITS, docs: int = PATTERN_DOCS) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): pieces of
    that length from that rank on go to so many sequences in a row, at that
    offset. The number of rows follows the lengths, not the pieces."""
    units = min(units, max_tokens)
    grain = max_tokens / units
    unit_of = lambda length: int(np.ceil(length / grain))
    lows = [0] + [int(np.floor((u - 1) * grain)) + 1 for u in range(1, units + 1)]
    highs = [0] + [int(np.floor(u * grain)) for u in range(1, units + 1)]
    pool = Pool(histogram, max_tokens)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def fill(count: int, room: int, sizes: tuple[int, ...], first: int) -> None:
        """Fill ``count`` equal sequences: the pattern's next size while one
        is left, then whatever fits best. Groups split where pieces run out."""
        stack = [(count, room, sizes, first)]
        while stack:
            n, left, want, at = stack.pop()
            while left > 0:
                # the last size of a pattern is met by the best exact fit
                low = lows[want[0]] if len(want) > 1 else 1
                high = min(left, highs[want[0]]) if len(want) > 1 else left
                length = pool.largest(low, high) or pool.largest(1, left)
                if not length:
                    break
                m = min(n, int(pool.left[length]))
                if m < n:
                    stack.append((n - m, left, want, at + m))
                    n = m
                rows.append((length, pool.take(length, m), m, at, max_tokens - left))
                left -= length
                want = want[1:]

    counts = np.zeros(units)
    for length, n in histogram.items():
        counts[unit_of(length) - 1] += n
    shapes = patterns(units, docs)
    a = np.zeros((units, len(shapes)))
    for j, shape in enumerate(shapes):
        for size in shape:
            a[size - 1, j] += 1
    # a piece left over costs what it holds: short ones fit in gaps anyway
    weight = np.arange(1, units + 1) / units
    repeats = np.rint(nnls(a * weight[:, None], counts * weight)).astype(np.int64)
    for j in sorted(range(len(shapes)), key=lambda j: shapes[j], reverse=True):
        shape, n = shapes[j], int(repeats[j])
        while n > 0:
            head = pool.largest(lows[shape[0]], highs[shape[0]])
            if not head:
                break
            m = min(n, int(pool.left[head]))
            rows.append((head, pool.take(head, m), m, sequences, 0))
            fill(m, max_tokens - head, shape[1:], sequences)
            sequences += m
            n -= m
    while head := pool.largest(1, max_tokens):
        each = max_tokens // head
        n = int(pool.left[head])
        m = max(1, n // each)  # sequences that this length alone would open
        rows.append((head, pool.take(head, m), m, sequences, 0))
        fill(m, max_tokens - head, (), sequences)
        sequences += m
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


# ------------------------------------------------------------------- the job

def _ranges(df: DataFrame, rows: int) -> int:
    """Ranges for an exact order of ``rows`` rows: they grow with the rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def number_by_position(packed: DataFrame, sequences: int) -> DataFrame:
    """``packed`` with its ``sequences`` numbered by the least ``_pos`` in
    each. The least positions crowd at the start of the schedule, so their
    ranges are cut by the rows and not by the positions."""
    least = (packed.groupBy("sequence_id").agg(F.min(F.struct("_pos", "piece")).alias("_least"))
             .select("sequence_id", F.col("_least._pos").alias("_pos"), F.col("_least.piece").alias("_piece")))
    number = (global_rank(least, "_pos", tiebreak=["_piece", "sequence_id"], out="_number",
                          n_parts=_ranges(packed, sequences))
              .select("sequence_id", (F.col("_number") - 1).alias("_number")))
    names = [F.col("_number").alias(c) if c == "sequence_id" else F.col(c) for c in packed.columns if c != "_pos"]
    return packed.join(number, "sequence_id").select(*names)


def rank_in_length(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` (``rows`` of them) with ``_rank`` (from 0) within the
    length, by ``_pos`` where there is one, else by document. Ranges of
    (length, order) are ranked apart, so a length of any size is split."""
    first = "_pos" if "_pos" in pieces.columns else "doc_id"
    tie = [c for c in ("piece", "doc_id", "ids_crc32") if c != first]
    ranked = global_rank(pieces, first, by=["length"], tiebreak=tie, out="_rank", n_parts=_ranges(pieces, rows))
    return ranked.withColumn("_rank", F.col("_rank") - 1)


def pack(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None,
         max_tokens: int = MAX_TOKENS, position: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. ``position`` names a column of places (0, 1, 2, ...)
    that the sequences follow. The pieces are written once to the checkpoint
    folder, so texts are tokenised a single time."""
    spark = docs.sparkSession
    cut = cut_lineage(pieces_of(docs, doc, text, tokenizer, max_tokens, position))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    found = plan(histogram, max_tokens)
    layout = spark.sparkContext.broadcast(found)
    ranked = rank_in_length(cut, sum(histogram.values()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["_pos"] * (position is not None)]

    def place(batches):
        table = layout.value
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            row = table[at]
            cols = [batch.column(n) for n in names]
            cols += [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    schema = PIECE_SCHEMA.format(id=cut.schema["doc_id"].dataType.simpleString()) + ", _pos long" * (position is not None)
    out = ranked.mapInArrow(place, schema + ", sequence_id long, offset long")
    if position:
        out = number_by_position(cut_lineage(out), int((found[:, 3] + found[:, 2]).max(initial=0)))
    return out.withColumnRenamed("doc_id", doc)


def fullness(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> tuple[int, int]:
    """(sequences of the plan, least number that the tokens need)."""
    layout = plan(histogram, max_tokens)
    used = int((layout[:, 3] + layout[:, 2]).max(initial=0))
    return used, -(-sum(k * v for k, v in histogram.items()) // max_tokens)


def gaps(layout: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Pieces (offset, length) of each sequence; for tests on small plans."""
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length, _, count, first, offset in layout.tolist():
        for s in range(first, first + count):
            out[s].append((offset, length))
    return {s: sorted(v) for s, v in out.items()}
