import random
import zlib

import numpy as np

from riskloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert len(rows) > 60 and right >= 0.93 * len(rows)
    toxic = [r["score"] for r in rows if r["toxic"]]
    clean = [r["score"] for r in rows if not r["toxic"]]
    assert np.mean(toxic) > 0.5 > 0.1 > np.mean(clean)


def planted(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{rng.randint(0, 800)}" for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["nastyword", "awfulstem" + rng.choice("abcdef")])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_planted_words(spark, make_docs):
    rows, labels = planted(600)
    got = toxicity.score(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 600
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) == (r["doc_id"] % 4 == 0)
    assert all(zlib.crc32(str(e).encode()) % 5 for r in got for e in r["evidence"])


def test_held_out_labels_do_not_matter(spark, make_docs):
    rows, labels = planted(300, 1)
    flipped = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, y) for i, y in labels]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(
        make_docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def built(rows, totals, ids=None):
    """An index of (label, terms, counts) rows, terms being small integers;
    terms with equal postings share a list."""
    labels = np.array([r[0] for r in rows])
    lists = {}
    for e, (_, terms, counts) in enumerate(rows):
        for t, c in zip(terms, counts):
            lists.setdefault(t, []).append((e, c))
    shared = sorted({tuple(p) for p in lists.values()})
    group = np.array([shared.index(tuple(lists[t])) for t in sorted(lists)])
    at = np.concatenate([[0], np.cumsum([len(p) for p in shared])]).astype(np.int64)
    toxic = np.array([sum(labels[e] for e, _ in lists[t]) for t in sorted(lists)], float)
    clean = np.array([len(lists[t]) for t in sorted(lists)], float) - toxic
    flat = [x for p in shared for x in p]
    return toxicity.Index(np.array(sorted(lists), np.uint64), group, toxic, clean, at,
                          np.array([e for e, _ in flat], np.int64), np.array([c for _, c in flat], np.int64),
                          list(range(len(rows))) if ids is None else ids, labels, totals)


def sample(rng, n, pool):
    rows = []
    for i in range(n):
        terms = sorted(rng.sample(pool(i), rng.randint(1, 9)))
        rows.append((int(i % 3 == 0), terms, [rng.randint(1, 4) for _ in terms]))
    return rows


def test_nearest_is_exact(monkeypatch):
    """Block pruning returns what scoring every example would."""
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = random.Random(4)
    rows = sample(rng, 700, lambda i: range(60))
    index = built(rows, {0: 400, 1: 300})
    vectors = np.zeros((len(rows), 60))
    for i, (_, t, c) in enumerate(rows):
        w = np.array(c) * index.weight[t]
        vectors[i, t] = w / np.sqrt((w * w).sum())
    for _ in range(60):
        t = sorted(rng.sample(range(60), rng.randint(1, 12)))
        c = [rng.randint(1, 3) for _ in t]
        w = np.array(c) * index.weight[t]
        full = np.zeros(60)
        full[t] = w / np.sqrt((w * w).sum() + 30 * index.outside ** 2)
        want = np.round(vectors @ full, 9)
        ids, got, share = index.nearest(np.array(t), np.array(c), 30)
        least = np.sort(want)[::-1][24]
        assert sorted(index.docs[i] for i in ids) == list(np.flatnonzero(want >= least))
        assert np.allclose(got, np.sort(want[want >= least])[::-1]) and np.isclose(share.sum(), 25)


def test_two_blocks(monkeypatch):
    """The first block met holds most cells of a text: none counts twice."""
    monkeypatch.setattr(toxicity, "BLOCK", 40)
    monkeypatch.setattr(toxicity, "DENSE", 2)
    rng = random.Random(6)
    rows = sample(rng, 50, lambda i: range(12) if i < 40 else range(30))
    index = built(rows, {0: 30, 1: 20})
    where = {e: i for i, e in enumerate(index.docs)}
    held = len(index.terms)
    for _ in range(40):
        t = np.array(sorted(rng.sample(range(held), 4)))
        c = np.array([rng.randint(1, 3) for _ in t])
        w = c * index.weight[t]
        w = w / np.sqrt((w * w).sum() + 2 * index.outside ** 2)
        cos = index.cosines([(t, c, 2.0)])[0]
        want = np.zeros(50)
        for e, (_, terms, counts) in enumerate(rows):
            x = dict(zip(np.searchsorted(index.terms, terms), counts * index.weight[np.searchsorted(index.terms, terms)]))
            want[where[e]] = sum(a * x.get(b, 0.0) for a, b in zip(w, t)) / np.sqrt(sum(v * v for v in x.values()))
        ids, got, _ = index.nearest(t, c, 2.0)
        assert np.allclose(got, want[ids], atol=1e-8) and np.isclose(got[-1], np.sort(want)[-25], atol=1e-8)
        assert (cos <= want + 1e-5).all()


def test_blocks_of_other_kinds_are_skipped(monkeypatch):
    """Two kinds of texts without a common term: a text meets the postings of
    its own kind only."""
    monkeypatch.setattr(toxicity, "BLOCK", 32)
    rng = random.Random(9)
    rows = sample(rng, 800, lambda i: range(12) if i < 400 else range(12, 24))
    index = built(rows, {0: 400, 1: 400})
    touched = []
    for kind in (0, 12):
        q = [(np.array([kind, kind + 1, kind + 2]), np.array([1, 2, 1]), 0.0)]
        cos = index.cosines(q, touched=touched)[0]
        assert (cos > -1).sum() < 0.75 * len(cos)
    assert sum(touched) <= len(index.vec)


def test_what_travels_is_small_and_scores_alike():
    import pickle

    rng = random.Random(2)
    index = built(sample(rng, 500, lambda i: range(40)), {0: 300, 1: 200})
    queries = [(np.array([1, 5, 9]), np.array([1, 1, 2]), 3.0)]
    want = index.votes(queries)
    sent = pickle.dumps(index)
    assert b"dense_max" not in sent and pickle.loads(sent).votes(queries) == want


def test_index_is_made_in_little_memory():
    """What is needed beside the postings follows ``POSTINGS``, not their number."""
    import tracemalloc

    lists, each, examples = 40_000, 100, 4_000
    at = np.arange(lists + 1, dtype=np.int64) * each
    example = ((np.arange(lists, dtype=np.int32)[:, None] * 7 + np.arange(each, dtype=np.int32) * 40) % examples).ravel()
    count = np.ones(len(example), np.int32)
    labels = np.arange(examples) % 2
    half = np.full(lists, each / 2)
    tracemalloc.start()
    index = toxicity.Index(np.arange(lists, dtype=np.uint64), np.arange(lists), half, half, at, example, count,
                           list(range(examples)), labels, {0: 2_000, 1: 2_000})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.place) == lists * each and peak < 20 * lists * each


def test_ids_decide_nothing():
    """Examples that tie at the last place share it, whatever their ids."""
    rows = [(i % 2, [1, 2], [1, 1]) for i in range(60)]
    query = [(np.array([0, 1]), np.array([1, 1]), 0.0)]
    scores = set()
    for order in (range(60), sorted(range(60), key=lambda i: (i % 2, i)), sorted(range(60), key=lambda i: (-(i % 2), i))):
        index = built([rows[i] for i in order], {0: 30, 1: 30}, ids=list(order))
        scores.add(index.votes(query)[0][0])
    assert scores == {0.5}


def test_permuted_ids_leave_the_scores(spark, make_docs):
    rows, labels = planted(200, 3)
    keep = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    new = dict(zip(keep, reversed(keep)))
    moved = [(new.get(i, i), t) for i, t in rows]
    marks = [(new.get(i, i), y) for i, y in labels]
    text = dict(rows)
    a = {text[r["doc_id"]]: r["score"] for r in toxicity.score(
        make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    back = {i: t for i, t in moved}
    b = {back[r["doc_id"]]: r["score"] for r in toxicity.score(
        make_docs(moved), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    assert a == b


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(make_docs([]), labels).collect() == []


def test_many_mildly_telling_words(spark, make_docs):
    """Words about twice as likely under one label decide together, and no
    example with a word is left out of the index."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(260)})
    mild = names[:100]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 2
        text = [rng.choice(mild[:50] if rng.random() < (0.66 if toxic else 0.34) else mild[50:])
                if rng.random() < 0.7 else rng.choice(names[100:]) for _ in range(70)]
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    learnt = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert set(toxicity.fit(docs, marks).docs) == learnt
    got = [r for r in toxicity.score(docs, marks).collect() if r["held_out"]]
    assert len({r["score"] for r in got}) > len(got) / 2
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in got) > 0.8 * len(got)
