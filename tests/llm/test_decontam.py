"""Benchmark decontamination against plain Python over all windows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import decontam


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window=10):
    """Sorted (doc_id, n_words, spans, items) of (id, text) rows."""
    windows = {}
    for name, text in items:
        ws = words(text)
        size = min(window, len(ws))
        if name is not None and size:
            for i in range(len(ws) - size + 1):
                windows.setdefault(tuple(ws[i: i + size]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = []
    for name, text in docs:
        ws = words(text)
        hit, found = [False] * len(ws), set()
        for size in sizes:
            for i in range(len(ws) - size + 1):
                got = windows.get(tuple(ws[i: i + size]))
                if got:
                    found |= got
                    hit[i: i + size] = [True] * size
        spans, at = [], 0
        while at < len(ws):
            end = at
            while end < len(ws) and hit[end]:
                end += 1
            if end > at:
                spans.append((at, end - at))
            at = max(end, at + 1)
        out.append((name, len(ws), spans, sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, **params):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words long, _doc string")
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, items string")
    found = decontam.contamination(d, b, **params).collect()
    return sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], list(r["items"])) for r in found), key=str)


def case(seed=5):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Straße", "a1", "x", "né", "word", "日本", "9", "lorem"] + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 4, 5, 9, 10, 11, 25])))) for i in range(25)]
    items += [(100, items[3][1]), (100, "-- !"), (101, None), (102, ""), (None, "w1 w2"), (3, items[3][1].upper())]
    docs = []
    for i in range(40):
        text = " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 60)))
        if i % 3 == 0:
            text += "; " + rnd.choice(items[:25])[1].replace(" ", ", ") + "\n" + text[:20]
        docs.append((i, text))
    docs += [(7, docs[7][1]), (None, items[0][1]), (None, items[0][1]), (200, None), (201, ""), (202, "..."),
             (203, " ".join(["the"] * 5000))]
    return docs, items


@pytest.mark.parametrize("window,shingle", [(10, 5), (4, 2), (3, 5)])
def test_equals_all_windows(spark, window, shingle):
    docs, items = case()
    assert run(spark, docs, items, window=window, shingle=shingle) == brute(docs, items, window)


def test_blocks_find_the_same(spark):
    docs, items = case(8)
    assert run(spark, docs, items, block_bytes=600) == brute(docs, items)


def test_long_text_and_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    items = [(i, passage + f" end{i}") for i in range(30)] + [(99, "end5")]
    docs = [(i, f"start {passage} end{i} stop") for i in range(40)] + [(50, (passage + " ") * 300)]
    assert run(spark, docs, items) == brute(docs, items)


def test_equal_hashes_are_verified_by_words(monkeypatch):
    """With a hash that tells nothing apart, the words still decide."""
    monkeypatch.setattr(decontam, "_shingles", lambda ws, size: np.full(len(ws.starts), size, np.uint64))
    rows = pa.table({"words": ["a b", "ab c"], "size": pa.array([2, 2], pa.int32()),
                     "prefix": pa.array([2, 2], pa.int64()), "offset": pa.array([0, 0], pa.int32()),
                     "items": [["1"], ["2"]]})
    block = decontam.Windows.build(rows)
    texts = pa.array(["a b a bc ab c", "c a", "b"], pa.large_string())
    start, window, candidates = decontam.occurrences(decontam._words(texts), block, [2])
    found = sorted((int(s), block.items[block.item_of[block.item_at[w]]]) for s, w in zip(start, window))
    assert found == [(0, "1"), (4, "2")] and candidates > len(found)


def test_rare_shingles_leave_few_candidates(spark):
    """A common phrase in every window does not make every document that
    holds the phrase a candidate."""
    common = "it is one of the most"
    items = [(i, f"{common} rare{i} thing{i} of kind{i} seen") for i in range(20)]
    docs = [(i, f"{common} usual things " * 50) for i in range(20)] + [(99, items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    live = decontam.live_windows(d, b)
    assert live.count() == 2  # the windows of one item, all others hold a shingle that never occurs
    block = decontam.Windows.build(live.toArrow())
    ws = decontam._words(pa.array([t for _, t in docs], pa.large_string()))
    start, _, candidates = decontam.occurrences(ws, block, [5])
    assert len(start) == candidates == 2


def test_merged_spans():
    start, length = np.array([5, 0, 3, 2, 9]), np.array([2, 3, 2, 1, 1])
    begin, size, n = decontam.merged(start, length, np.array([3, 2]))
    assert list(zip(begin, size)) == [(0, 7), (2, 1), (9, 1)] and list(n) == [1, 2]
    assert [len(x) for x in decontam.merged(start[:0], length[:0], np.array([0, 0]))] == [0, 0, 2]


def test_empty_tables_and_digest(spark):
    docs, items = case()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    import hashlib

    got = sorted((tuple(r) for r in decontam.digest(decontam.contamination(d, b)).collect()), key=str)
    want = sorted(((name, n, sum(s[1] for s in spans), len(found),
                    hashlib.sha256(",".join(found).encode()).hexdigest(), bool(spans))
                   for name, n, spans, found in brute(docs, items)), key=str)
    assert got == want
