"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the lower-cased words and their first four bytes, so a stem counts
whatever its ending. Every term of an example is in its vector: its weight is
TF-IDF times a supervised factor between ``FLOOR`` and one that grows with the
chi-square of the term against the label, so a term that tells little counts
little, but none is left out. A text's terms that no example holds count in
its length. The examples lie in a block-max inverted index (see ``Index``):
every text with a word is searched, blocks whose bound cannot reach its 25th
neighbour are skipped, the others are scored in full, in single precision with
a bound on its error, and all that may be neighbours again in double, so the
neighbours are exact.
The 25 nearest vote by the inverse of their distance, and examples that tie at
the last place share it, so ids decide nothing; the votes, smoothed by the base
rate, are the score, and the nearest examples are its evidence.

The classifier is fitted on a bounded sample: at most ``EXAMPLES`` labelled
rows per label, the smallest by a hash of the id. Votes are weighed back to
the label counts of all labelled rows. Every document is scored on its whole
text.

Cases: a null or empty text has no terms and takes the rate of the examples
without terms; a text that shares no term with any example takes the base
rate; without any labelled row every score is 0; rows that repeat an id are
scored one by one; an id labelled twice is toxic if any of its labels is; a
null id is held out if crc32('') says so. Only id, text and the label are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as T
from riskloom.session import cut_lineage

EXAMPLES = 8_000       # labelled rows per label in the fit, at most
CHI2 = 30.0            # chi-square at which a term has half of its TF-IDF weight
FLOOR = 0.02           # factor of a term that tells nothing
PREFIX = (4,)          # bytes of a word's beginnings that are terms as well
NEIGHBOURS = 25
DENSE = 0.08           # share of the examples from which a term is scored by the matrix product
QUERIES = 64           # texts in a matrix product
BLOCK = 256            # examples of a block
POSTINGS = 1 << 19     # postings worked on at once while an index is made
COMPONENTS = 5         # leading components that lay the examples out
NEAR = 0.05            # distance that is added to each, so equal vectors do not vote alone
SMOOTH = 0.5           # votes that the base rate adds
FOLDS = 5

# Letters lowered, every other ASCII sign a blank.
_STEP = np.uint64(0xD6E8FEB86659FD93)
_EDGE = T.mix64(np.arange(1, 33, dtype=np.uint64))
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32


def held_out(doc: Column) -> Column:
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


# -------------------------------------------------------------------- terms

@dataclass
class TermRows:
    """Distinct (text, word) of a slice with counts, by text, and the terms
    of each distinct word: ``terms[at[w]:at[w + 1]]``."""

    texts: int
    doc: np.ndarray
    word: np.ndarray
    count: np.ndarray
    terms: np.ndarray
    at: np.ndarray

    def expand(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, key) with counts, by text and key, where ``keys``
        stands for the terms; negative keys are left out."""
        n = np.diff(self.at)[self.word]
        entry = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[self.word], n)
        key, doc, count = keys[place], self.doc[entry], self.count[entry]
        if len(key) and key.min() < 0:
            on = key >= 0
            key, doc, count = key[on], doc[on], count[on]
        width = int(key.max(initial=0)) + 1
        joint = doc * width + key
        order = np.argsort(joint, kind="stable")
        joint = joint[order]
        new = np.ones(len(joint), bool)
        new[1:] = joint[1:] != joint[:-1]
        first = np.flatnonzero(new)
        total = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
        return joint[first] // width, joint[first] % width, total


def term_rows(texts: pa.Array) -> TermRows:
    """The words of each text, and for each distinct word of the slice its own
    hash and those of its beginnings."""
    raw, offsets = T.byte_view(texts)
    buf = _BYTES[raw]
    inside = buf != 32
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    whole = T.hash_spans(buf, starts, ends)
    names, where, word = np.unique(whole, return_index=True, return_inverse=True)
    joint, count = np.unique(owner * max(len(names), 1) + word.reshape(-1), return_counts=True)
    doc, word = np.divmod(joint, max(len(names), 1))
    starts, size = starts[where], (ends - starts)[where]
    of, terms = [np.arange(len(names))], [T.mix64(names)]
    h, on = np.zeros(len(names), np.uint64), np.arange(len(names))
    for k in range(max(PREFIX, default=0)):
        on = on[size[on] > k]
        if not len(on):
            break
        h[on] = h[on] * _STEP + buf[starts[on] + k].astype(np.uint64) + np.uint64(1)
        if k + 1 in PREFIX:
            of.append(on)
            terms.append(T.mix64(h[on] ^ _EDGE[k]))
    of, terms = np.concatenate(of), np.concatenate(terms)
    order = np.argsort(of, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(names)))]).astype(np.int64)
    return TermRows(len(texts), doc, word, count, terms[order], at)


# ---------------------------------------------------------------------- fit

def examples(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str,
             per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, _text) of the sample, and the label counts of all rows to
    learn from. At most ``2 * per_label`` ids are broadcast."""
    known = (labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull() & ~held_out(F.col(doc)))
             .groupBy(F.col(doc).alias("doc_id")).agg(F.max((F.col(label) != 0).cast("int")).alias("y")))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64(F.lit("examples"), F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(*order).limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id")
    return rows, totals


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first:last, the number of the range and each value."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _spans(at: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of whole lists, of at most ``POSTINGS`` postings or one list: the
    span of their postings, and the list of each."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + POSTINGS, side="right")) - 1)
        yield slice(int(at[i]), int(at[j])), np.repeat(np.arange(i, j), np.diff(at[i:j + 1]))
        i = j


class Index:
    """Block-max inverted index over the unit vectors of the examples.

    Terms that stand in the same examples with the same counts share one
    posting list (a word and most of its beginnings do): a list holds
    count / length of its examples, a term its weight. The examples are laid
    out by their leading components, so that a block of ``BLOCK`` holds texts
    of one kind, and each list has its largest value in every block. Lists of
    many examples are columns of a matrix of counts, the others cells by block. An example
    without any term is no neighbour, it counts in the rate of texts without
    terms."""

    def __init__(self, terms: np.ndarray, group: np.ndarray, toxic: np.ndarray, clean: np.ndarray, at: np.ndarray,
                 example: np.ndarray, count: np.ndarray, docs: list, labels: np.ndarray, totals: dict[int, int]):
        """``terms`` sorted, each with its list and its examples by label;
        list g is ``at[g]:at[g + 1]`` of ``example`` and ``count``; ``docs``
        and ``labels`` of the examples; label counts of all labelled rows."""
        self.terms, self.group = terms, group.astype(np.int32)
        sample = {y: int((labels == y).sum()) for y in (0, 1)}
        share = {y: totals.get(y, 0) / max(sample[y], 1) for y in (0, 1)}
        self.weight = (np.log((len(labels) + 1) / (toxic + clean + 1)) + 1) * telling(toxic, clean, sample[1], sample[0])
        self.outside = (np.log(len(labels) + 1) + 1) * FLOOR
        square = np.bincount(self.group, weights=self.weight ** 2, minlength=len(at) - 1)
        norm = np.zeros(len(labels))
        for span, lists in _spans(at):
            norm += np.bincount(example[span], weights=count[span].astype(float) ** 2 * square[lists], minlength=len(labels))
        known = norm > 0
        none = [share[y] * float((~known & (labels == y)).sum()) for y in (0, 1)]
        weight = totals.get(0, 0) + totals.get(1, 0)
        self.base = totals.get(1, 0) / weight if weight else 0.0
        self.empty = (none[1] + SMOOTH * self.base) / (none[0] + none[1] + SMOOTH)
        often = np.diff(at) >= max(2, DENSE * known.sum())
        order = _layout(at, example, count, square, norm, often)
        self.docs = [docs[i] for i in order]
        self.toxic = np.where(labels == 1, share[1], 0.0)[order]
        self.clean = np.where(labels == 1, 0.0, share[0])[order]
        n, place = len(order), np.zeros(len(labels), np.int64)
        place[order] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        self.often, self.at, self.length = often, at.astype(np.int64), 1 / np.sqrt(norm[order])
        # postings by (list, place) in the smallest types, which is what travels
        self.place = np.empty(len(example), np.min_scalar_type(max(n, 1)))
        self.count = np.empty(len(example), np.min_scalar_type(int(count.max(initial=0))))
        for span, lists in _spans(at):
            where = place[example[span]]
            by = np.lexsort((where, lists))
            self.place[span], self.count[span] = where[by], count[span][by]
        self.dense = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in self.SHIPPED} | {"dense": None}

    SHIPPED = frozenset("terms group weight outside base empty docs toxic clean blocks often at length place count".split())

    def build(self) -> None:
        """The matrix, the cells and the block maxima, made in linear time
        where they are first used."""
        n = len(self.docs)
        # column of the matrix, or -1; postings of the others by (list, block, place)
        self.row = np.where(self.often, np.cumsum(self.often) - 1, -1).astype(np.int32)
        self.dense = np.zeros((n, int(self.often.sum())), np.float32)
        rest = int(np.diff(self.at)[~self.often].sum())
        self.vec, self.val, filled = np.empty(rest, np.int32), np.empty(rest), 0
        cells = []
        for span, lists in _spans(self.at):
            place, count, on = self.place[span].astype(np.int32), self.count[span], self.often[lists]
            self.dense[place[on], self.row[lists[on]]] = count[on]
            lists, place, count = lists[~on], place[~on], count[~on]
            self.vec[filled:filled + len(place)] = place
            self.val[filled:filled + len(place)] = count * self.length[place] if n else 0.0
            cell = lists * max(self.blocks, 1) + place // BLOCK
            new = np.ones(len(cell), bool)
            new[1:] = cell[1:] != cell[:-1]
            first = np.flatnonzero(new)
            cells.append((first + filled, cell[first]))
            filled += len(place)
        first, cell = (np.concatenate([x[i] for x in cells] or [np.zeros(0, np.int64)]) for i in (0, 1))
        self.dense_max = np.zeros((self.dense.shape[1], self.blocks))
        for b in range(self.blocks):
            span = slice(b * BLOCK, (b + 1) * BLOCK)
            self.dense_max[:, b] = (self.dense[span] * self.length[span, None]).max(axis=0, initial=0)
        # sums of rows of positive products in single precision are this near, relatively
        self.slack = (self.dense.shape[1] + 8) * 2.0 ** -24
        self.cell_at = np.append(first, rest).astype(np.int64)
        self.cell_block = (cell % max(self.blocks, 1)).astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.val, first) if len(first) else np.zeros(0)
        self.list_at = np.searchsorted(cell // max(self.blocks, 1), np.arange(len(self.at)))
        self.list_first = self.cell_at[self.list_at]
        self.list_size = np.diff(self.list_first)

    def coefficients(self, idx: np.ndarray, tf: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
        """(lists, their factors) of a text of unit length, counted with the
        terms that the index does not hold."""
        w = tf * self.weight[idx]
        w = w / np.sqrt((w * w).sum() + other * self.outside ** 2) * self.weight[idx]
        lists, at = np.unique(self.group[idx], return_inverse=True)
        return lists, np.bincount(at.reshape(-1), weights=w, minlength=len(lists))

    def cosines(self, queries: list[tuple], k: int = NEIGHBOURS, touched: list | None = None) -> np.ndarray:
        """Cosines of queries (terms, counts, other) with the examples, exact
        where they may be among the k largest; -1 in blocks whose bound stays
        below the k-th found."""
        out = np.full((len(queries), len(self.docs)), -1.0)
        for row, (ids, cos) in zip(out, self._scored(queries, k, touched, out), strict=True):
            row[ids] = cos
        return out

    def _scored(self, queries: list[tuple], k: int, touched: list | None = None,
                every: np.ndarray | None = None) -> list[tuple]:
        """For each query the examples that may be among the k nearest, with
        their exact cosines; ``every`` takes the cosines met, within ``slack``.
        A query's most promising block is scored first, which gives its
        threshold."""
        if self.dense is None:
            self.build()
        n, size = len(self.docs), len(queries)
        dense = np.zeros((size, self.dense.shape[1]))
        rare = []
        for i, q in enumerate(queries):
            lists, c = self.coefficients(*q)
            row = self.row[lists]
            dense[i, row[row >= 0]] = c[row >= 0]
            lists, c = lists[row < 0], c[row < 0]
            of, cells = _ranges(self.list_at[lists], self.list_at[lists + 1])
            rare.append((c[of], cells, self.cell_block[cells], lists, c))
        bound = dense @ self.dense_max
        for i, (c, cells, block, *_) in enumerate(rare):
            bound[i] += np.bincount(block, weights=c * self.cell_max[cells], minlength=self.blocks)
        # a block that is not met keeps -2, below 0 with all that is added
        out, single = np.full((size, n), -2.0, np.float32), dense.astype(np.float32)
        lead = bound.argmax(axis=1)
        done = np.zeros((size, self.blocks), bool)
        done[np.arange(size), lead] = True
        self._multiply(out, single, done)
        least = np.full(size, -1.0)
        for i, b in enumerate(lead):
            own = out[i, b * BLOCK:(b + 1) * BLOCK]
            if len(own) >= k:
                own = own + self._rest(rare[i], rare[i][2] == b, touched)[b * BLOCK:(b + 1) * BLOCK]
                least[i] = np.partition(own, len(own) - k)[len(own) - k] * (1 - self.slack)
        live = (bound >= least[:, None] - 1e-7) | done
        self._multiply(out, single, live & ~done)
        near = []
        for i, row in enumerate(out):
            rest = self._rest(rare[i], live[i, rare[i][2]], touched)
            cos = rest + row
            least = np.partition(cos, n - k)[n - k] if n > k else -1.0
            ids = np.flatnonzero(cos >= least - 2 * self.slack * abs(least) - 1e-8)
            on = np.flatnonzero(dense[i])
            near.append((ids, (self.dense[ids[:, None], on] @ dense[i, on]) * self.length[ids] + rest[ids]))
            if every is not None:
                np.copyto(every[i], cos, where=row > -2)
        return near

    def _multiply(self, out: np.ndarray, dense: np.ndarray, live: np.ndarray) -> None:
        """The matrix product for the live (query, block) cells of ``out``."""
        for b in np.flatnonzero(live.any(axis=0)):
            span = slice(b * BLOCK, min((b + 1) * BLOCK, len(self.docs)))
            length = self.length[span].astype(np.float32)
            if live[:, b].all():
                np.multiply(dense @ self.dense[span].T, length, out=out[:, span])
            else:
                own = np.flatnonzero(live[:, b])
                out[own, span] = (dense[own] @ self.dense[span].T) * length

    def _rest(self, rare: tuple, on: np.ndarray, touched: list | None) -> np.ndarray:
        """What the lists outside the matrix add to each example, at least in
        the cells that are on. Where these are most of them, the lists are
        read in one piece each."""
        c, cells, _, lists, factor = rare
        if 2 * np.count_nonzero(on) > len(on):
            size = self.list_size[lists]
            at = np.repeat(self.list_first[lists] - np.cumsum(size) + size, size)
            at += np.arange(len(at))
            weights = np.repeat(factor, size)
        else:
            of, at = _ranges(self.cell_at[cells[on]], self.cell_at[cells[on] + 1])
            weights = c[on][of]
        weights *= self.val[at]
        if touched is not None:
            touched.append(len(at))
        return np.bincount(self.vec[at], weights=weights, minlength=len(self.docs))

    def nearest(self, idx: np.ndarray, tf: np.ndarray, other: float,
                k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Examples of the k largest cosines, their cosines and shares."""
        return self._best(*self._scored([(idx, tf, other)], k)[0], k)

    def _best(self, ids: np.ndarray, cos: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All examples that reach the k-th cosine, by cosine. Those that tie
        at it share the places that are left, so nothing but the texts decides
        who votes."""
        cos = np.round(cos, 9)  # the order of a sum does not break ties
        least = np.partition(cos, len(cos) - k)[len(cos) - k] if len(self.docs) > k else -np.inf
        ids, cos = ids[cos >= least], cos[cos >= least]
        order = np.argsort(-cos, kind="stable")
        ids, cos = ids[order], cos[order]
        tied = cos == least
        share = np.where(tied, (k - (~tied).sum()) / max(tied.sum(), 1), 1.0)
        return ids, cos, share

    def votes(self, queries: list[tuple]) -> list[tuple[float, list]]:
        """Score in [0, 1] and the ids of three nearest examples (of equally
        near ones those of least id), for each (terms, counts, other)."""
        out: list[tuple[float, list]] = []
        for lo in range(0, len(queries), QUERIES):
            part = queries[lo: lo + QUERIES]
            asked = [q for q in part if len(q[0])] if self.docs else []
            near = iter(self._scored(asked, NEIGHBOURS) if asked else [])
            for idx, _, other in part:
                if not len(idx) or not self.docs:
                    out.append((self.base if other else self.empty, []))
                    continue
                ids, cos, share = self._best(*next(near))
                some = cos > 0
                ids, cos, share = ids[some], cos[some], share[some]
                vote = share * NEAR / (NEAR + np.maximum(1 - cos, 0))
                # rounded, as equal votes may be added in another order
                toxic, clean = (round(float((vote * y[ids]).sum()), 9) for y in (self.toxic, self.clean))
                score = (toxic + SMOOTH * self.base) / (toxic + clean + SMOOTH)
                out.append((float(min(max(score, 0.0), 1.0)), [self.docs[i] for i in ids[:3]]))
        return out

    def queries(self, texts: pa.Array) -> list[tuple]:
        """(terms, counts, squares of the counts of other terms) of texts."""
        rows = term_rows(texts)
        spot = np.minimum(np.searchsorted(self.terms, rows.terms), max(len(self.terms) - 1, 0))
        known = self.terms[spot] == rows.terms if len(self.terms) else np.zeros(len(spot), bool)
        owner, at, count = rows.expand(np.where(known, spot, -1))
        # terms that no example holds, told apart by a number in the slice
        other_doc, _, other = rows.expand(np.where(known, -1, np.unique(rows.terms, return_inverse=True)[1].reshape(-1)))
        outside = np.bincount(other_doc, weights=other.astype(float) ** 2, minlength=rows.texts)
        ends = np.searchsorted(owner, np.arange(rows.texts + 1))
        return [(at[a:b], count[a:b], float(o)) for a, b, o in zip(ends[:-1], ends[1:], outside, strict=True)]


def _layout(at: np.ndarray, example: np.ndarray, count: np.ndarray, square: np.ndarray, norm: np.ndarray,
            often: np.ndarray) -> np.ndarray:
    """The examples that have terms, in an order in which neighbours are alike:
    by the signs of their leading components over the frequent lists, then
    by the first of them. The order only decides how many blocks are met."""
    known = norm > 0
    column, row = np.cumsum(known) - 1, np.cumsum(often) - 1
    m = np.zeros((int(often.sum()), int(known.sum())), np.float32)
    for span, lists in _spans(at):
        on = often[lists]
        lists, texts = lists[on], example[span][on]
        m[row[lists], column[texts]] = count[span][on] * np.sqrt(square[lists] / norm[texts])
    if not m.size:
        return np.flatnonzero(known)
    m -= m.mean(axis=1, keepdims=True)
    few = min(COMPONENTS, *m.shape)
    part = np.random.default_rng(0).normal(size=(m.shape[0], few)).astype(np.float32)
    for _ in range(4):
        part = np.linalg.qr(m @ (m.T @ part))[0]
    z = part.T @ m
    signs = ((z > 0) << np.arange(few)[:, None]).sum(axis=0)
    return np.flatnonzero(known)[np.lexsort((z[0], signs))]


def telling(toxic: np.ndarray, clean: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Factor of each term from the chi-square of the 2 x 2 table of term and
    label: ``FLOOR`` at 0, towards one for a term that tells the labels apart."""
    n, total = toxic + clean, ones + zeros
    low = n * (total - n) * ones * zeros
    top = (toxic * zeros - clean * ones) ** 2 * total
    chi = np.divide(top, low, out=np.zeros(len(n)), where=low > 0)
    return FLOOR + (1 - FLOOR) * chi / (chi + CHI2)


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic",
        per_label: int = EXAMPLES) -> Index:
    rows, totals = examples(docs, labels, doc, text, label, per_label)

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        found = term_rows(texts)
        names, key = np.unique(found.terms, return_inverse=True)
        owner, at, count = found.expand(key.reshape(-1))
        ends = pa.array(np.searchsorted(owner, np.arange(found.texts + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (names[at].view(np.int64), count.astype(np.int32))]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["doc_id", "y", "t", "n"])

    id_type = docs.schema[doc].dataType.simpleString()
    vectors = cut_lineage(T.map_texts(rows.select("doc_id", "y", "_text"), run,
                                      f"doc_id {id_type}, y int, t array<long>, n array<int>", "_text"))
    # read from the cut table, so the numbers stay the same in every job
    numbered = vectors.withColumn("_ex", F.monotonically_increasing_id())
    known = numbered.select("_ex", "doc_id", "y").orderBy("doc_id", "_ex").toArrow()  # the bounded sample
    places = pa.table({"_ex": known["_ex"], "ex": pa.array(np.arange(len(known), dtype=np.int32))})
    placed = numbered.join(F.broadcast(docs.sparkSession.createDataFrame(places)), "_ex")
    postings = cut_lineage(
        placed.select("ex", "y", F.explode(F.arrays_zip("t", "n")).alias("_t"))
        .groupBy(F.col("_t.t").alias("t"))
        .agg(F.array_sort(F.collect_list(F.struct("ex", F.col("_t.n").alias("n")))).alias("p"),
             F.sum("y").cast("int").alias("toxic"), F.sum(1 - F.col("y")).cast("int").alias("clean"))
        .withColumn("h", F.xxhash64("p")))
    # terms with equal postings share a list, so that a list comes once; flat
    # columns, whose size follows the bounded sample. The hash only proposes
    lists = (postings.groupBy("h").agg(F.min("p").alias("p"), F.max("p").alias("_q"))
             .select("h", F.col("p.ex").alias("ex"), F.col("p.n").alias("n"), (F.col("p") == F.col("_q")).alias("same")))
    return _assemble(postings.select("t", "toxic", "clean", "h").toArrow(), lists.toArrow(), known, totals)


def _assemble(terms: pa.Table, lists: pa.Table, known: pa.Table, totals: dict[int, int]) -> Index:
    """The index from one row a term, one row a posting list (the terms of a
    list have its hash) and one row an example, in the order of their numbers."""
    if not pc.all(lists["same"], min_count=0).as_py():
        raise RuntimeError("two posting lists share a hash")
    lists = lists.drop_columns("same").sort_by("h").combine_chunks()
    terms = terms.take(np.argsort(terms["t"].to_numpy().view(np.uint64)))
    ex, n = (lists[c].combine_chunks() for c in ("ex", "n"))
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(ex).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return Index(terms["t"].to_numpy().view(np.uint64), np.searchsorted(lists["h"].to_numpy(), terms["h"].to_numpy()),
                 terms["toxic"].to_numpy().astype(float), terms["clean"].to_numpy().astype(float), at,
                 ex.flatten().to_numpy(), n.flatten().to_numpy(), known["doc_id"].to_pylist(), known["y"].to_numpy(), totals)


def score(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic",
          per_label: int = EXAMPLES) -> DataFrame:
    """(doc, held_out, score, predicted, evidence) of every row."""
    index = fit(docs, labels, doc, text, label, per_label)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    id_type = docs.schema[doc].dataType.simpleString()

    def run_all(batches):
        index = shared.value
        for batch in batches:
            for part, texts in T.slices(batch, "_text"):
                found = index.votes(index.queries(texts))
                s = np.array([x[0] for x in found], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)),
                     pa.array([x[1] for x in found], pa.list_(part.column(0).type))],
                    ["doc_id", "held_out", "score", "predicted", "evidence"])

    inner = docs.select(F.col(doc).alias("doc_id"), held_out(F.col(doc)).alias("held_out"), F.col(text).alias("_text"))
    out = inner.mapInArrow(run_all, f"doc_id {id_type}, held_out boolean, score double, predicted int, "
                                    f"evidence array<{id_type}>")
    return out.withColumnRenamed("doc_id", doc)
