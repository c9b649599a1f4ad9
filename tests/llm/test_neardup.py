import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import graph, neardup
from riskloom.llm import textkit as T


def bag(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
             if w]
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def overlap(x, y):
    both = sum(min(v, y[k]) for k, v in x.items())
    return both / (sum(x.values()) + sum(y.values()) - both)


def brute(rows, threshold=0.8):
    """Class (smallest id) of each row, by comparing all pairs."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= threshold:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, d if bags[i] is None else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def found(docs):
    return sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()), key=repr)


def words(rng, n):
    return [f"{rng.choice('abcdefg')}{rng.randint(0, 400)}" for _ in range(n)]


def family(rng, n, size, edits):
    base = words(rng, n)
    out = [base]
    for _ in range(size - 1):
        copy = list(rng.choice(out[:3]))
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 9999)}"
        out.append(copy)
    return [" ".join(x) for x in out]


def test_against_all_pairs(make_docs):
    rng = random.Random(5)
    texts = []
    for _ in range(8):
        texts += family(rng, rng.randint(20, 200), rng.randint(2, 25), 9)
    texts += [" ".join(words(rng, rng.randint(1, 120))) for _ in range(60)]
    passage = " ".join(words(rng, 40))
    texts += [" ".join(words(rng, 30)) + " " + passage for _ in range(80)]
    texts += [" ".join(["again", "and"] * rng.randint(20, 26)) for _ in range(10)]       # multiplicities
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    assert found(make_docs(rows)) == brute(rows)


def test_hub_and_spokes(make_docs):
    """Copies near to one original and far from each other: one class."""
    rng = random.Random(6)
    base = words(rng, 300)
    rows = [(1000, " ".join(base))]
    for i in range(150):
        copy = list(base)
        for k in range(6):
            copy[(i * 7 + k * 50) % 300] = f"s{i}x{k}"
        rows.append((i, " ".join(copy)))
    assert found(make_docs(rows)) == brute(rows)
    assert len({c for _, c in found(make_docs(rows))}) == 1


def test_large_bucket_is_verified_inside_the_join(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 4)
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(family(rng, 60, 60, 14) + family(rng, 80, 40, 16))]
    assert found(make_docs(rows)) == brute(rows)


HOT = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
       "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
       "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "24"}


def test_large_bucket_hot_on_both_sides_is_not_split_into_a_product(spark, monkeypatch):
    """One bucket in which most members look for others: every link is found,
    and the join has a few tasks, not the product of the splits of its sides."""
    monkeypatch.setattr(neardup, "LARGE", 4)
    monkeypatch.setattr(neardup, "CELL", 16)
    n = 240
    name = lambda i: b"%016d" % i
    items = [[(i // 2) * 1_000 + k for k in range(90)] + [-(i * 1_000 + k) for k in range(10)] for i in range(n)]
    before = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    try:
        met = spark.createDataFrame([(1, n, name(i), name(0)) for i in range(n)], "bucket long, n long, node binary, a binary")
        meeting = spark.createDataFrame([(name(i), [0] * 8, [1]) for i in range(n)],
                                        "node binary, bits array<long>, buckets array<long>")
        known = spark.createDataFrame([(name(i), x) for i, x in enumerate(items)], "node binary, items array<long>")
        edges = spark.createDataFrame([], "a binary, b binary")
        roots = spark.createDataFrame([], "node binary, root binary")
        out = neardup._apart(met, meeting, known, edges, roots, 0.8)
        pairs = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in out.collect()}
        assert pairs == {frozenset((name(i), name(i + 1))) for i in range(0, n, 2)}
        assert out.rdd.getNumPartitions() <= 4 * 24
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 700])
def test_cells_of_a_bucket_pair_all_members_once(spark, n):
    rows = spark.createDataFrame([(7, n, b"%d" % i, i % 3 == 0) for i in range(n)],
                                 "bucket long, n long, node binary, _rest boolean")
    some, others = neardup.in_cells(rows)
    met = some.join(others.select("bucket", "_cell", others["node"].alias("other")), ["bucket", "_cell"])
    met = [(bytes(r["node"]), bytes(r["other"])) for r in met.select("node", "other").collect()]
    assert sorted(met) == sorted((b"%d" % i, b"%d" % j) for i in range(0, n, 3) for j in range(n))


def test_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (None, "lonely text of nobody at all"), (20, "One two THREE"), (21, "one\ttwo three")]
    assert found(make_docs(rows)) == brute(rows)


def test_keep_one(make_docs, odd_rows):
    out = neardup.keep_one(make_docs(odd_rows))
    assert out.schema == make_docs([]).schema
    left = sorted((r["doc_id"], (r["text"] or "")[:12], r["_doc"], r["node"]) for r in out.collect())
    assert [x[0] for x in left] == [1, 1, 2, 3, 4, 5, 7, 9]
    assert {x[2:] for x in left} == {("a", "d")}
    assert sum(x[1] == "other text" for x in left) == 1


def test_empty_table(make_docs):
    assert neardup.classes(make_docs([])).collect() == []
    assert neardup.keep_one(make_docs([])).collect() == []


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.95])
def test_signatures_are_unbiased_for_weights(share):
    """Matching components estimate the weighted Jaccard similarity."""
    rng = np.random.default_rng(int(share * 100))
    keys = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    both = int(400 * share)
    wa = rng.integers(1, 12, 400)
    wb = np.where(np.arange(400) < both, wa, rng.integers(1, 12, 400))
    kb = np.where(np.arange(400) < both, keys, keys + np.uint64(1))
    docs = np.repeat([0, 1], 400)
    got = neardup.bag_minhash(docs, np.concatenate([keys, kb]), np.concatenate([wa, wb]), 2, size=4096)
    want = wa[:both].sum() / (wa.sum() + wb.sum() - wa[:both].sum())
    assert abs((got[0] == got[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / 4096) + 1e-9
    # a weight that only grows shares its processes: min / max of the weights
    grown = neardup.bag_minhash(docs, np.concatenate([keys, keys]), np.concatenate([wa, wa * 2]), 2, size=4096)
    assert abs((grown[0] == grown[1]).mean() - 0.5) < 0.05


def test_signature_does_not_depend_on_the_slice():
    texts = pa.array(["a b c d e f g h", "x y z", "a b c d e f g h"], pa.large_string())

    def sig(t):
        w = T.words_of(t, lower=True)
        return neardup.bag_minhash(*neardup.weighted(*neardup.shingles(w, neardup.content_hashes(w))), len(t))

    whole = sig(texts)
    for i in range(3):
        assert (sig(texts.slice(i, 1))[0] == whole[i]).all()
    assert (whole[0] == whole[2]).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(200)]                      # a long chain
    edges += [("hub", f"spoke{i:05d}") for i in range(4000)]                          # a hot node
    edges += [(f"r{rng.randint(0, 80):02d}", f"r{rng.randint(0, 80):02d}") for _ in range(60)] + [("self", "self")]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in got}
    assert set(got) == {n for e in edges if e[0] != e[1] for n in e}


def test_spread_join_equals_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(5000)] + [(f"k{i}", i) for i in range(500)]
                                 + [(None, 1), ("none", 2)], "key string, v long")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, w long")
    assert graph.hot_keys(rows, "key").count() == 1
    for how in ("inner", "left"):
        a = sorted(map(repr, graph.spread_join(rows, table, "key", how).collect()))
        assert a == sorted(map(repr, rows.join(table, "key", how).collect()))
