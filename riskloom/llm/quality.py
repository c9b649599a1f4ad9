"""Quality rules by repetition coverage: rolling hashes of several n-gram
lengths in numpy measure the characters inside duplicated n-grams and lines.

Runs once over the rows, in Arrow batches and without a shuffle; the work of
a text never leaves its row. Equality of n-grams is equality of 64-bit
hashes inside one text. Cases: a null or empty text has no words and fails
the base rule; repeated rows are judged one by one; a null id is returned as
null; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as T

MIN_WORDS = 50
WINDOW = 3
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

# Fixed values, the published bounds for web texts: largest share of a text's
# word characters inside duplicated n-grams (by length), of its characters
# inside duplicated lines, and of its lines that repeat an earlier one.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHAR_LIMIT = 0.20
LINE_LIMIT = 0.30
# They are meant for long texts. One sentence said twice is no fault of a
# short one, so up to SENTENCE_CHARS (a sentence of 40 words) may repeat while
# they are at most SHORT_LIMIT of the text, and one line may. From 2,000
# word characters on only the published bounds are left.
SENTENCE_CHARS = 200
SHORT_LIMIT = 0.20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = (", ".join(f"{m} long" for m in METRICS)
          + ", n_lines long, dup_line_chars long, n_chars_text long, "
          + ", ".join(f"cover_{n} double" for n in NGRAM_LIMITS))


def _repeats(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs twice or more, and the ones among them that
    are not the first of their key. ``at`` are ascending positions."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return at[:0], at[:0]
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = twice[place] == keys
    place, at = place[hit], at[hit]
    order = np.argsort(place, kind="stable")
    later = np.zeros(len(at), bool)
    later[order[1:]] = place[order[1:]] == place[order[:-1]]
    return at, at[later]


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the n-grams that start at ``at``."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _line_stats(text: str) -> tuple[int, int, int]:
    """Lines with a word; those equal to an earlier line; their characters."""
    if "\n" not in text:
        return (1 if text.strip(T.WHITESPACE) else 0), 0, 0
    seen: set[str] = set()
    full = again = chars = 0
    for line in text.split("\n"):
        if line.strip(T.WHITESPACE):
            full += 1
            if line in seen:
                again += 1
                chars += len(line)
            else:
                seen.add(line)
    return full, again, chars


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All metrics of a slice of texts, one value per text."""
    words = T.words_of(texts)
    n_docs, size = len(texts), len(words.starts)
    lead = (words.buf & 0xC0) != 0x80
    total_lead = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    chars = total_lead[words.ends] - total_lead[words.starts]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.buf], dtype=np.int64)])
    off = words.offsets
    lines = np.array([_line_stats(t) for t in texts.to_pylist()], np.int64).reshape(n_docs, 3)
    out = {"n_words": np.diff(words.bounds).astype(np.int64),
           "word_chars": _per_text(chars, words.bounds),
           "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
           "n_dup_lines": lines[:, 1], "n_lines": lines[:, 0], "dup_line_chars": lines[:, 2],
           "n_chars_text": total_lead[off[1:]] - total_lead[off[:-1]]}
    # a hash of the text's number keeps n-grams of different texts apart
    salt = T.mix64(words.docs.astype(np.uint64) + np.uint64(1))
    h = None
    for n in sorted({WINDOW, *NGRAM_LIMITS}):
        h = T.ngram_hashes(words, n) if n == WINDOW else _grow(words, h, last, n)
        last = n
        at = np.flatnonzero(T.ngram_valid(words, n))
        both, later = _repeats(T.mix64(h[at]) ^ salt[at], at)
        if n == WINDOW:
            out["n_repeat_words"] = _per_text(_covered(both, n, size), words.bounds)
        if n in NGRAM_LIMITS:
            inside = _per_text(np.where(_covered(later, n, size), chars, 0), words.bounds)
            out[f"cover_{n}"] = inside / np.maximum(out["word_chars"], 1)
    return out


def _grow(words: T.Words, h: np.ndarray, have: int, want: int) -> np.ndarray:
    for n in range(have + 1, want + 1):
        h = T.ngram_hashes(words, n, h)
    return h


def repetition_metrics(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                       keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the id) and all metrics of each row."""
    keep = [doc] if keep is None else keep
    # positions, not names: the kept columns may carry any name
    inner = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
                        F.col(text).alias("_text"))
    types = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join(f"_k{i} {t}" for i, t in enumerate(types)) + ", " + SCHEMA

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        found = measure(texts)
        cols = [part.column(i) for i in range(len(keep))] + [pa.array(found[n]) for n in names]
        return pa.RecordBatch.from_arrays(cols, [f"_k{i}" for i in range(len(keep))] + names)

    return T.map_texts(inner, run, schema, "_text")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def coverage_ok():
    """The verdict on coverage: every bound holds."""
    ok = ((F.col("dup_line_chars") <= LINE_CHAR_LIMIT * F.col("n_chars_text"))
          & (F.col("n_dup_lines") <= F.greatest(F.col("n_lines") * F.lit(LINE_LIMIT), F.lit(1.0))))
    sentence = F.least(F.lit(SENTENCE_CHARS) / F.greatest(F.col("word_chars"), F.lit(1)), F.lit(SHORT_LIMIT))
    for n, limit in NGRAM_LIMITS.items():
        ok = ok & (F.col(f"cover_{n}") <= F.greatest(sentence, F.lit(limit)))
    return ok


def judge(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Metrics, ``base_failed`` and ``kept`` of every row."""
    rows = repetition_metrics(docs, doc, text)
    return (rows.withColumnRenamed("_k0", doc)
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & coverage_ok()))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns kept, in one pass."""
    keep = docs.columns
    rows = repetition_metrics(docs, text=text, keep=keep).filter(~base_failed() & coverage_ok())
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
