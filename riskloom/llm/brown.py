"""Brown class-based bigram model: exchange clustering assigns words to
classes; class transitions and word emissions give smoothed probabilities.

Counts of all words come from every training text. The ``SEED`` most frequent
words are clustered by the exchange algorithm on their bigram counts, where
all other words are one class and the end of a text another; only that
bounded matrix comes to the driver. Then each other training word joins the
class that raises the likelihood of its bigrams most, from its counts before
and after the seed's classes, and the bigrams of classes are counted anew over
all words. Counts and classes of the ``HEAD`` most frequent words travel to
the tasks; those of the rest, which no key dominates, meet the texts' words in
a join.

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

with transitions smoothed by ``ALPHA``. Words that no training text holds are
one class of their own. A text's score is the log10 probability of its words
and its end, after an end.

``clustered`` bounds the clustering to so many words instead; all others then
stay one class, with emissions smoothed by 0.5 and room for one unknown word.

Words are known by 64-bit hashes, the same in every process. Cases: a null or
empty text is its end token; rows that repeat an id are scored one by one; a
null id counts as ''; with no training text every word is unknown and the
distributions are uniform; only id and text are read. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as T
from riskloom.session import cut_lineage

FOLDS, HELD_OUT = 5, 1
CLASSES = 64
SEED = 2_000
HEAD = 65_536
SWEEPS = 8
ALPHA = 0.1
END = np.uint64(0)


def fold(doc: Column) -> Column:
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % FOLDS


# ------------------------------------------------------------------- counts

def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, c) of all tokens, ends included, counted per slice first."""

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        h, n = np.unique(T.words_of(texts, lower=True).hashes, return_counts=True)
        h, n = np.append(h, END), np.append(n, len(texts))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "c"])

    rows = T.map_texts(docs.select(F.col(text).alias("_text")), run, "h long, c long", "_text")
    return rows.groupBy("h").agg(F.sum("c").alias("c"))


def token_ids(words: T.Words, known: np.ndarray, ids: np.ndarray, other: int) -> np.ndarray:
    """The id of each word (``known`` is sorted), ``other`` where unknown."""
    if not len(known):
        return np.full(len(words.hashes), other)
    at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
    return np.where(known[at] == words.hashes, ids[at], other)


def bigrams(bounds: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, next, text) ids of all tokens: an end before the first word
    and after the last."""
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(count)), count + 1)
    first = bounds[:-1] + np.arange(len(count))          # place of each text's first token
    nxt = np.full(len(doc), end)
    prev = np.full(len(doc), end)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)
    nxt[place] = ids
    inner = np.ones(len(doc), bool)
    inner[first] = False
    prev[inner] = nxt[np.flatnonzero(inner) - 1]
    return prev, nxt, doc


def bigram_counts(docs: DataFrame, text: str, known: np.ndarray) -> np.ndarray:
    """Counts (previous, next) of the clustered words, the others as one, and
    the end: a matrix of (len(known) + 2) squared."""
    size = len(known) + 2
    ids = np.arange(len(known))

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        words = T.words_of(texts, lower=True)
        prev, nxt, _ = bigrams(words.bounds, token_ids(words, known, ids, size - 2), size - 1)
        code, n = np.unique(prev * size + nxt, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

    rows = (T.map_texts(docs.select(F.col(text).alias("_text")), run, "code long, n long", "_text")
            .groupBy("code").agg(F.sum("n").alias("n")))
    out = np.zeros(size * size)
    found = rows.toArrow()      # at most (SEED + 2) squared rows
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


# --------------------------------------------------------------- clustering

def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, frequency: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word. ``counts`` has the words and, as the last two
    rows, the other words and the end, which stay classes of their own. Each
    word in turn, by falling frequency, moves to the class that raises the
    likelihood of the bigrams most; sweeps end when none moves."""
    n = len(counts) - 2
    classes = max(1, min(classes, n))
    order = np.argsort(-frequency, kind="stable")
    cls = np.empty(n + 2, np.int64)
    cls[order] = np.arange(n) % classes
    cls[n:] = classes, classes + 1
    k = classes + 2
    table = np.zeros((k, k))
    np.add.at(table, (cls[:, None], cls[None, :]), counts)
    own = counts.diagonal()
    for _ in range(sweeps):
        moved = 0
        for w in order:
            here = cls[w]
            right = np.bincount(cls, weights=counts[w], minlength=k)
            left = np.bincount(cls, weights=counts[:, w], minlength=k)
            right[here] -= own[w]
            left[here] -= own[w]
            table[here, :] -= right
            table[:, here] -= left
            table[here, here] -= own[w]
            # gain of joining class c, for all c at once
            rows = _xlogx(table + right[None, :]) - _xlogx(table)
            cols = _xlogx(table + left[:, None]) - _xlogx(table)
            gain = rows.sum(1) - rows.diagonal() + cols.sum(0) - cols.diagonal()
            both = table.diagonal() + right + left + own[w]
            gain += _xlogx(both) - _xlogx(table.diagonal())
            # all classes keep their bigrams with the word, wherever it goes
            out, into = table.sum(1) + left, table.sum(0) + right
            gain -= _xlogx(out + right.sum() + own[w]) - _xlogx(out)
            gain -= _xlogx(into + left.sum() + own[w]) - _xlogx(into)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[here] + 1e-9:
                best = here
            moved += best != here
            cls[w] = best
            table[best, :] += right
            table[:, best] += left
            table[best, best] += own[w]
        if not moved:
            break
    return cls


@dataclass
class Model:
    head: np.ndarray           # sorted hashes of the most frequent tokens
    head_count: np.ndarray
    words: np.ndarray          # sorted hashes of the clustered words
    classes: np.ndarray        # class of each, then of the others and of the end
    emission: np.ndarray       # log10 P(word | class) of each clustered word
    transition: np.ndarray     # log10 P(class | class)
    tokens: int                # training tokens, N
    distinct: int              # distinct training tokens, V
    other_room: float          # log10 of the other words' emission total

    @property
    def base_room(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))


def most_frequent(counts: DataFrame, head: int) -> list[np.ndarray]:
    """The columns of the ``head`` rows of largest c. A histogram of the counts
    first says which rows may be among them, so that few are merged."""
    size = F.floor(F.log2("c") * 8)
    left, least = head, -1
    for r in counts.groupBy(size.alias("b")).count().orderBy(F.desc("b")).collect():     # eight sizes for each power of two
        if left <= 0:
            break
        left, least = left - r["count"], r["b"]
    top = counts.filter(size >= least).orderBy(F.desc("c"), "h").limit(head).toArrow()
    columns = [top.column(x).to_numpy() for x in counts.columns]
    return [columns[0].view(np.uint64), *columns[1:]]


def cluster(learn: DataFrame, text: str, h: np.ndarray, c: np.ndarray, classes: int,
            clustered: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first ``clustered`` words of (h, c), sorted, their counts, their
    classes (then those of the others and of the end) and the class bigrams."""
    is_word = h != END
    words, freq = h[is_word][:clustered], c[is_word][:clustered].astype(float)
    order = np.argsort(words)
    words, freq = words[order], freq[order]
    pairs = bigram_counts(learn, text, words)
    cls = exchange(pairs, freq, classes)
    k = int(cls.max()) + 1
    table = np.zeros((k, k))
    np.add.at(table, (cls[:, None], cls[None, :]), pairs)
    return words, freq, cls, table


def log_moves(table: np.ndarray) -> np.ndarray:
    """log10 P(class | class)."""
    return np.log10((table + ALPHA) / (table.sum(1, keepdims=True) + ALPHA * len(table)))


def train(docs: DataFrame, doc: str = "doc_id", text: str = "text", classes: int = CLASSES,
          clustered: int = SEED, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The bounded model, and the full (h, c) table of the training tokens."""
    learn = docs.filter(fold(F.col(doc)) != HELD_OUT)
    counts = cut_lineage(word_counts(learn, text))
    size = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    h, c = most_frequent(counts, head)
    words, freq, cls, table = cluster(learn, text, h, c, classes, clustered)
    k = len(table)
    move = log_moves(table)
    is_word = h != END
    total = np.bincount(cls[: len(words)], weights=freq, minlength=k)
    emission = np.log10(freq / np.maximum(total[cls[: len(words)]], 1))
    ends = int(c[~is_word].sum())
    tokens, distinct = int(size["n"] or 0), int(size["v"])
    others = tokens - ends - int(freq.sum())
    kinds = distinct - len(words) - (1 if ends else 0)
    order = np.argsort(h)
    return Model(h[order], c[order], words, cls, emission, move, tokens, distinct,
                 float(np.log10(others + 0.5 * (kinds + 1)))), counts


# ------------------------------------------------------------------ scoring

def measure(texts: pa.Array, m: Model) -> dict[str, np.ndarray]:
    """Per text: what the model's own tables give, and the words whose counts
    are not in the head (text, hash, count)."""
    words = T.words_of(texts, lower=True)
    n = len(texts)
    size = len(m.words)
    ids = token_ids(words, m.words, np.arange(size), size)
    prev, nxt, doc = bigrams(words.bounds, ids, size + 1)
    model = m.transition[m.classes[prev], m.classes[nxt]]
    known = nxt < size
    model[known] += m.emission[nxt[known]]
    model[nxt == size] -= m.other_room
    spot = token_ids(words, m.head, np.arange(len(m.head)), -1)
    tail = spot < 0
    owner = words.docs
    logs = np.append(np.log10(m.head_count + 0.5), 0.0)[spot]
    end_at = np.flatnonzero(m.head == END)
    end_count = int(m.head_count[end_at[0]]) if len(end_at) else 0
    per = lambda d, v: np.bincount(d, weights=v, minlength=n)
    # emissions of other words whose counts are in the head
    logged = np.where(ids == size, logs, 0.0)
    key = T.mix64(words.hashes[tail]) if tail.any() else np.zeros(0, np.uint64)
    order = np.lexsort((key, owner[tail]))
    d, h = owner[tail][order], words.hashes[tail][order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return {"n_tokens": np.diff(words.bounds) + 1,
            "known": per(owner, ~tail).astype(np.int64) + (end_count > 0),
            "base": per(owner, logs) + np.log10(end_count + 0.5),
            "model": per(doc, model) + per(owner, logged),
            "tail_ends": np.searchsorted(d[at], np.arange(n + 1)),
            "tail_hash": h[at], "tail_count": np.diff(np.concatenate([at, [len(d)]]))}


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", clustered: int | None = None, **sizes) -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row; all training words have classes unless ``clustered`` bounds them."""
    if clustered is None:
        return score_all(docs, doc, text, **sizes)
    model, counts = train(docs, doc, text, clustered=clustered, **sizes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[doc].dataType.simpleString()
    names = ["doc_id", "held_out", "ver", "n_tokens", "known", "base", "model", "tail_h", "tail_n"]

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        got = measure(texts, shared.value)
        ends = pa.array(got["tail_ends"].astype(np.int32))
        cols = [part.column(0), part.column(1), part.column(2), pa.array(got["n_tokens"].astype(np.int64)),
                pa.array(got["known"]), pa.array(got["base"]), pa.array(got["model"]),
                pa.ListArray.from_arrays(ends, pa.array(got["tail_hash"].view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(got["tail_count"].astype(np.int32)))]
        return pa.RecordBatch.from_arrays(cols, names)

    inner = docs.select(F.col(doc).alias("doc_id"), (fold(F.col(doc)) == HELD_OUT).alias("held_out"),
                        F.xxhash64(F.col(text)).alias("ver"), F.col(text).alias("_text"))
    rows = cut_lineage(T.map_texts(inner, run, (
        f"doc_id {id_type}, held_out boolean, ver long, n_tokens long, known long, base double, model double, "
        "tail_h array<long>, tail_n array<int>"), "_text"))
    tails = (rows.select("doc_id", "ver", F.posexplode(F.arrays_zip("tail_h", "tail_n")).alias("_at", "_t"))
             .select("doc_id", "ver", "_at", F.col("_t.tail_h").alias("h"), F.col("_t.tail_n").alias("n")))
    met = tails.join(counts, "h", "left").select("doc_id", "ver", "_at", "n", F.coalesce("c", F.lit(0)).alias("c"))
    # rows that repeat an id and its text repeat their words: take the mean
    times = F.sum(F.when(F.col("_at") == 0, 1).otherwise(0))
    sums = met.groupBy("doc_id", "ver").agg(
        (F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)) / times).cast("long").alias("t_known"),
        (F.sum(F.col("n") * F.log10(F.col("c") + F.lit(0.5))) / times).alias("t_log"))
    sums = sums.select(F.col("doc_id").alias("_d"), F.col("ver").alias("_v"), "t_known", "t_log")
    out = (rows.drop("tail_h", "tail_n")
           .join(sums, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("ver") == F.col("_v")), "left"))
    t_log = F.coalesce("t_log", F.lit(0.0))
    return out.select(
        F.col("doc_id").alias(doc), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + t_log - F.col("n_tokens") * F.lit(model.base_room)).alias("base_score"),
        (F.col("model") + t_log).alias("score"))


# ------------------------------------------------------- classes of all words

def word_contexts(docs: DataFrame, text: str, known: np.ndarray, cls: np.ndarray, k: int) -> DataFrame:
    """(h, code, n): how often a word that is not in ``known`` stands between
    two classes, ``code`` = class before * k + class after."""

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        words = T.words_of(texts, lower=True)
        ids = token_ids(words, known, cls[: len(known)], k - 2)
        prev, nxt, _ = bigrams(words.bounds, ids, k - 1)
        place = np.arange(len(ids)) + words.docs          # a word's own token
        rest = np.flatnonzero(ids == k - 2)
        code = prev[place[rest]] * k + nxt[place[rest] + 1]
        h = words.hashes[rest]
        order = np.lexsort((code, h))
        h, code = h[order], code[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (code[1:] != code[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(h)))
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(code[at].astype(np.int32)),
                                           pa.array(n.astype(np.int64))], ["h", "code", "n"])

    return T.map_texts(docs.select(F.col(text).alias("_text")), run, "h long, code int, n long", "_text")


_WORDS_AT_ONCE = 4096


def joining(word: np.ndarray, code: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class that each of the words 0, 1, .. joins, from its contexts (at
    least one each, words in order): the one that raises the likelihood of the
    bigrams most; the first of those that tie."""
    k = len(table)
    free = k - 2
    m = int(word[-1]) + 1
    cell = _xlogx(table)
    after = np.bincount(word * k + code % k, weights=n, minlength=m * k).reshape(m, k)
    before = np.bincount(word * k + code // k, weights=n, minlength=m * k).reshape(m, k)
    gain = np.zeros((m, free))
    for met, of, held in ((after, table[:free].T, cell[:free].T), (before, table[:, :free], cell[:, :free])):
        w, j = np.nonzero(met)
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain += np.add.reduceat(_xlogx(of[j] + met[w, j][:, None]) - held[j], first, axis=0)
    # before and after its own class it is one cell, not two
    w, j = np.nonzero((after[:, :free] > 0) & (before[:, :free] > 0))
    a, b, d = after[w, j], before[w, j], table.diagonal()[j]
    gain[w, j] += _xlogx(d + a + b) - _xlogx(d + a) - _xlogx(d + b) + _xlogx(d)
    times, at = np.unique(after.sum(1), return_inverse=True)
    for total in (table.sum(1)[:free], table.sum(0)[:free]):
        gain -= (_xlogx(total + times[:, None]) - _xlogx(total))[at]
    return np.argmax(np.round(gain, 9), axis=1)


def join_classes(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """(h, c, cls) of every word of ``contexts``."""
    k = len(table)
    shared = contexts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        seed = shared.value
        once = joining(np.arange(k * k), np.arange(k * k), np.ones(k * k), seed)   # a word seen a single time
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]

        def classes_of(h, code, n):
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            c = np.add.reduceat(n, first)
            cls = once[code[first]]
            for lo in range(0, len(first), _WORDS_AT_ONCE):
                many = np.flatnonzero(c[lo: lo + _WORDS_AT_ONCE] > 1)
                if len(many):
                    span = slice(first[lo], first[lo + _WORDS_AT_ONCE] if lo + _WORDS_AT_ONCE < len(first) else len(h))
                    place = np.full(_WORDS_AT_ONCE, -1)
                    place[many] = np.arange(len(many))
                    own = place[word[span] - lo]
                    pick = own >= 0
                    cls[lo + many] = joining(own[pick], code[span][pick], n[span][pick], seed)
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(c), pa.array(cls.astype(np.int32))],
                                              ["h", "c", "cls"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(held)]
            whole = int(np.searchsorted(held[0], held[0][-1], side="left"))   # the last word may go on
            if whole:
                yield classes_of(*[a[:whole] for a in held])
                held = [a[whole:] for a in held]
        if len(held[0]):
            yield classes_of(*held)

    # no word beyond the seed is more than 1 / SEED of the tokens, so no key dominates
    rows = contexts.repartition("h").groupBy("h", "code").agg(F.sum("n").alias("n")).sortWithinPartitions("h", "code")
    return rows.mapInArrow(run, "h long, c long, cls int")


@dataclass
class Head:
    hashes: np.ndarray         # sorted, of the most frequent words
    counts: np.ndarray
    classes: np.ndarray
    ends: int                  # training texts
    size: int                  # number of classes, with the unknown words and the end


def read_classes(texts: pa.Array, m: Head) -> dict[str, np.ndarray]:
    """Per text: the classes of its words; ``m.size`` and the place in the
    text's list of rarer words where the head does not hold them."""
    words = T.words_of(texts, lower=True)
    n = len(texts)
    owner = words.docs
    spot = token_ids(words, m.hashes, np.arange(len(m.hashes)), -1)
    tail = spot < 0
    seq = np.append(m.classes, m.size)[spot]
    d, h = owner[tail], words.hashes[tail]
    order = np.lexsort((h, d))
    new = np.ones(len(order), bool)
    new[1:] = (d[order][1:] != d[order][:-1]) | (h[order][1:] != h[order][:-1])
    at = order[new]
    ends = np.searchsorted(d[at], np.arange(n + 1))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    per = lambda v: np.bincount(owner, weights=v, minlength=n)
    return {"n_tokens": np.diff(words.bounds) + 1, "known": per(~tail).astype(np.int64) + (m.ends > 0),
            "base": per(np.append(np.log10(m.counts + 0.5), 0.0)[spot]) + np.log10(m.ends + 0.5),
            "logs": per(np.append(np.log10(np.maximum(m.counts, 1)), 0.0)[spot]),
            "bounds": words.bounds, "seq": seq, "tail_ends": ends, "tail_hash": h[at],
            "tail_bounds": np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))]),
            "tail_at": place - ends[d]}


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each text's part of ``values`` as bytes."""
    offsets = (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a column of bytes, and the bounds of each."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(off, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]].copy().view(kind), (offsets - offsets[0]) // size


_KEPT = ["doc_id", "held_out", "n_tokens"]


def class_sequences(docs: DataFrame, doc: str, text: str, found: DataFrame, head: Head) -> DataFrame:
    """(doc_id, held_out, n_tokens, known, base, logs, seq) of every row: the
    known words, the sums of log10 (c + 0.5) of all and of log10 c of the known
    words, and the classes of the words; ``found`` has (h, c, cls) of those
    that the head does not hold."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    id_type = docs.schema[doc].dataType.simpleString()
    k = head.size
    kind = np.uint8 if k < 256 else np.int32

    def read(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        got = read_classes(texts, shared.value)
        ends = pa.array(got["tail_ends"].astype(np.int32))
        return pa.RecordBatch.from_arrays([
            part.column(0), part.column(1), pa.array(got["n_tokens"].astype(np.int64)), pa.array(got["known"]),
            pa.array(got["base"]), pa.array(got["logs"]), _binary(got["seq"].astype(kind), got["bounds"]),
            pa.ListArray.from_arrays(ends, pa.array(got["tail_hash"].view(np.int64))),
            _binary(got["tail_at"].astype(np.int32), got["tail_bounds"])],
            [*_KEPT, "known", "base", "logs", "seq", "tail_h", "tail_at"])

    inner = docs.select(F.col(doc).alias("doc_id"), (fold(F.col(doc)) == HELD_OUT).alias("held_out"), F.col(text).alias("_text"))
    plain = f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, logs double, seq binary"
    rows = cut_lineage(T.map_texts(inner, read, f"{plain}, tail_h array<long>, tail_at binary", "_text")
                       .withColumn("_row", F.monotonically_increasing_id()))
    tails = rows.select("_row", F.posexplode("tail_h").alias("at", "h"))
    met = (tails.join(found, "h", "left")
           .groupBy("_row").agg(F.collect_list(F.struct(
               "at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("cls", F.lit(k - 2)).alias("cls"))).alias("met")))

    def fill(batches):
        for batch in batches:
            seq, bounds = _values(batch.column(6), kind)
            at, at_bounds = _values(batch.column(7), np.int32)
            met = batch.column(8)
            size = np.asarray(met.value_lengths().fill_null(0)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            items = met.flatten()
            row = np.repeat(np.arange(batch.num_rows), size)
            order = np.lexsort((items.field("at").to_numpy(), row))
            c, cls = items.field("c").to_numpy()[order], items.field("cls").to_numpy()[order]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at_bounds))
            spot = first[owner] + at
            seq[seq == k] = cls[spot]
            per = lambda v: np.bincount(owner, weights=v[spot], minlength=batch.num_rows)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(batch.column(3).to_numpy() + per(c > 0).astype(np.int64)),
                pa.array(batch.column(4).to_numpy() + per(np.log10(c + 0.5))),
                pa.array(batch.column(5).to_numpy() + per(np.log10(np.maximum(c, 1)))),
                _binary(seq, bounds)], [*_KEPT, "known", "base", "logs", "seq"])

    joined = rows.join(met, "_row", "left").select(*_KEPT, "known", "base", "logs", "seq", "tail_at", "met")
    return cut_lineage(joined.mapInArrow(fill, plain))


def class_bigrams(rows: DataFrame, k: int) -> np.ndarray:
    """Counts (class before, class after) of all tokens of the rows' ``seq``."""
    kind = np.uint8 if k < 256 else np.int32

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            seq, bounds = _values(batch.column(0), kind)
            prev, nxt, _ = bigrams(bounds, seq.astype(np.int64), k - 1)
            total += np.bincount(prev * k + nxt, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    found = rows.select("seq").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()     # at most k * k rows
    return out.reshape(k, k)


def score_all(docs: DataFrame, doc: str = "doc_id", text: str = "text", classes: int = CLASSES, head: int = HEAD,
              seed: int = SEED) -> DataFrame:
    """``score`` with a class for every training word."""
    learn = docs.filter(fold(F.col(doc)) != HELD_OUT)
    counts = cut_lineage(word_counts(learn, text))
    size = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                      F.sum(F.when(F.col("h") == 0, F.col("c"))).alias("ends")).collect()[0]
    tokens, distinct, ends = int(size["n"] or 0), int(size["v"]), int(size["ends"] or 0)
    h, c = most_frequent(counts, seed + 1)
    words, freq, cls, table = cluster(learn, text, h, c, classes, seed)
    k = len(table)
    found = cut_lineage(join_classes(word_contexts(learn, text, words, cls, k), table))
    more = most_frequent(found, max(head - len(words), 0))
    hashes, times, kinds = (np.concatenate(x) for x in zip((words, freq, cls[: len(words)]), more, strict=True))
    order = np.argsort(hashes)
    held = Head(hashes[order], times[order], kinds[order], ends, k)
    rows = class_sequences(docs, doc, text, found, held)
    table = class_bigrams(rows.filter(~F.col("held_out")), k)
    move, room = log_moves(table), np.log10(np.maximum(table.sum(0), 1))
    room[k - 2:] = 0      # an unknown word and an end are alone in their classes
    kind = np.uint8 if k < 256 else np.int32

    def run(batches):
        for batch in batches:
            seq, bounds = _values(batch.column(5), kind)
            prev, nxt, owner = bigrams(bounds, seq.astype(np.int64), k - 1)
            model = np.bincount(owner, weights=move[prev, nxt] - room[nxt], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(batch.column(6).to_numpy() + model)],
                                             [*_KEPT, "known", "base", "model"])

    id_type = docs.schema[doc].dataType.simpleString()
    out = rows.select(*_KEPT, "known", "base", "seq", "logs").mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, model double")
    base_room = float(np.log10(tokens + 0.5 * (distinct + 1)))
    return out.select(
        F.col("doc_id").alias(doc), "held_out", "n_tokens", F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(base_room)).alias("base_score"), F.col("model").alias("score"))
