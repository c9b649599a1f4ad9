"""Vectorised text helpers that run inside Arrow tasks.

Texts come as Arrow string arrays. They are worked on in slices of at most
``SLICE_BYTES`` (a single longer text is a slice of its own), so the memory
of a task follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20

# White space of words and lines: [\x20\x09-\x0D]
WHITESPACE = " \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in WHITESPACE]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Words longer than this are hashed one by one.
_LONG_WORD = 48
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a slice of texts, in order.

    ``bounds[d]:bounds[d + 1]`` are the words of text ``d``; ``starts`` and
    ``ends`` are byte positions in ``buf``; ``hashes`` are 64-bit word hashes.
    """

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def strings(column) -> pa.Array:
    """One plain string array, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each, from 0."""
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]: offsets[-1]], offsets - offsets[0]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same in every process."""
    n = len(starts)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    size = ends - starts
    order = np.argsort(-np.minimum(size, _LONG_WORD + 1).astype(np.int16), kind="stable")
    first, count = starts[order], size[order]
    long = int(np.searchsorted(-count, -_LONG_WORD, side="left"))
    h = np.zeros(n, np.uint64)
    alive = n
    for k in range(int(min(_LONG_WORD, count[0]))):
        alive = int(np.searchsorted(-count[:alive], -k, side="left"))
        if alive == 0:
            break
        h[:alive] = h[:alive] * _BASE + (buf[first[:alive] + k].astype(np.uint64) + np.uint64(1))
    h = mix64(h ^ count.astype(np.uint64))
    for i in range(long):
        h[i] = xxhash.xxh64_intdigest(buf[first[i]: first[i] + count[i]].tobytes())
    out[order] = h
    return out


def words_of(texts: pa.Array, lower: bool = False, hashes: bool = True, member: np.ndarray | None = None) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; ``lower`` lower-cases A-Z
    first. ``member`` is another table of the 256 bytes that make up words;
    it takes all or none of the bytes beyond ASCII."""
    buf, offsets = byte_view(texts)
    if lower:
        buf = _LOWER[buf]
    inside = (~_IS_SPACE if member is None else member)[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts_mask = inside.copy()
    starts_mask[1:] &= ~inside[:-1] | edge[1:-1]
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(starts_mask)
    ends = np.flatnonzero(ends_mask) + 1
    bounds = np.searchsorted(starts, offsets)
    h = hash_spans(buf, starts, ends) if hashes else np.zeros(0, np.uint64)
    return Words(buf, offsets, starts, ends, bounds, h)


def ngram_hashes(words: Words, n: int, lower_level: np.ndarray | None = None) -> np.ndarray:
    """Rolling hash of the n-gram that starts at each word (meaningless where
    it would leave its text, see ``ngram_valid``). ``lower_level`` is the
    array for n-1; it is extended by one word."""
    if lower_level is None:
        h = words.hashes.copy()
        for k in range(1, n):
            h = _extend(h, words.hashes, k)
        return h
    return _extend(lower_level, words.hashes, n - 1)


def _extend(h: np.ndarray, single: np.ndarray, k: int) -> np.ndarray:
    out = h * _BASE
    if k < len(out):
        out[: len(out) - k] += single[k:]
    return out


def ngram_valid(words: Words, n: int) -> np.ndarray:
    """Word positions whose n-gram stays inside its text."""
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
    return np.arange(len(words.starts)) + n <= ends


def slices(batch: pa.RecordBatch, text: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch whose texts together hold at most ``max_bytes``, each
    with its texts. Only a part is ever copied."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(column):
        upto = int(np.searchsorted(total, total[at] + max_bytes, side="right")) - 1
        upto = min(max(upto, at + 1), len(column))
        yield batch.slice(at, upto - at), strings(column.slice(at, upto - at))
        at = upto


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch | None],
              schema: str, text: str = "text") -> DataFrame:
    """Apply ``fn(slice, texts)`` to every slice of every Arrow batch."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text):
                out = fn(part, texts)
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def string_column(values) -> pa.Array:
    return pa.array(values, pa.string())
