import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from riskloom.llm import brown
from riskloom.llm import textkit as T

SIZES = {"classes": 4, "clustered": 12, "head": 30}


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + ["\n"]


def word_hash(w):
    return T.words_of(pa.array([w], pa.large_string())).hashes[0]


def brute(rows, classes, clustered):
    """Base and class scores word by word, with the classes of the operator's
    own clustering run on counts made here."""
    train = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    top = sorted((w for w in c if w != "\n"), key=lambda w: (-c[w], int(np.uint64(word_hash(w)).view(np.int64))))[:clustered]
    top.sort(key=word_hash)
    ident = {w: k for k, w in enumerate(top)}
    size = len(top) + 2
    pairs = np.zeros((size, size))
    of = lambda w: size - 1 if w == "\n" else ident.get(w, size - 2)
    for ws in train:
        for a, b in zip(["\n", *ws[:-1]], ws, strict=True):
            pairs[of(a), of(b)] += 1
    cls = brown.exchange(pairs, np.array([c[w] for w in top], float), classes)
    k = int(cls.max()) + 1
    table = np.zeros((k, k))
    for a in range(size):
        for b in range(size):
            table[cls[a], cls[b]] += pairs[a, b]
    total = Counter()
    for w in top:
        total[cls[ident[w]]] += c[w]
    others = [w for w in c if w not in ident and w != "\n"]
    room = sum(c[w] for w in others) + 0.5 * (len(others) + 1)
    out = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = 0.0
        for a, b in zip(["\n", *ws[:-1]], ws, strict=True):
            x, y = cls[of(a)], cls[of(b)]
            score += math.log10((table[x, y] + brown.ALPHA) / (table[x].sum() + brown.ALPHA * k))
            if b in ident:
                score += math.log10(c[b] / total[y])
            elif b != "\n":
                score += math.log10((c[b] + 0.5) / room)
        out.append((i, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return sorted(out, key=repr)


def check(rows, docs):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
                  for r in brown.score(docs, **SIZES).collect()), key=lambda r: repr(r[:4]) + f"{r[4]:.6f}")
    want = sorted(brute(rows, SIZES["classes"], SIZES["clustered"]), key=lambda r: repr(r[:4]) + f"{r[4]:.6f}")
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:4] == y[:4]
        assert abs(x[4] - y[4]) < 1e-6 * max(1, abs(y[4])) and abs(x[5] - y[5]) < 1e-6 * max(1, abs(y[5]))


def test_against_brute_force(make_docs):
    text = "the cat saw the dog and the bird saw The cat run far away from this odd place today"
    rows = [(i, " ".join(text.split()[i % 5: 6 + i % 11])) for i in range(60)]
    check(rows, make_docs(rows))


def test_odd_rows(make_docs, odd_rows):
    check(odd_rows, make_docs(odd_rows))


def test_probabilities_sum_to_one(make_docs):
    rows = [(i, f"a b c d{i % 4} e{i % 9} f") for i in range(40)]
    model, _ = brown.train(make_docs(rows), **SIZES)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    size = len(model.words)
    for k in range(int(model.classes[:size].max()) + 1):
        assert np.isclose((10 ** model.emission[model.classes[:size] == k]).sum(), 1)


def test_exchange_finds_planted_classes():
    """Words that alternate between two sets fall into those sets."""
    rng = np.random.default_rng(0)
    n = 20
    counts = np.zeros((n + 2, n + 2))
    for _ in range(20_000):
        a, b = rng.integers(0, 10), rng.integers(10, 20)
        counts[a, b] += 1
        counts[b, rng.integers(0, 10)] += 1
    cls = brown.exchange(counts, counts[:n].sum(axis=1), 2)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10]


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.6, (32, 32)).astype(float)

    def likelihood(cls):
        k = cls.max() + 1
        t = np.zeros((k, k))
        np.add.at(t, (cls[:, None], cls[None, :]), counts)
        return brown._xlogx(t).sum() - brown._xlogx(t.sum(0)).sum() - brown._xlogx(t.sum(1)).sum()

    freq = counts[:30].sum(axis=1)
    scores = [likelihood(brown.exchange(counts, freq, 5, sweeps=s)) for s in range(6)]
    assert all(b >= a - 1e-6 for a, b in zip(scores[:-1], scores[1:], strict=True)) and scores[-1] > scores[0]


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = brown.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_empty_table(make_docs):
    assert brown.score(make_docs([])).collect() == []


def test_no_training_text(make_docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = brown.score(make_docs([(held, "a b")])).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and abs(r["base_score"]) < 1e-12


def xlogx(x):
    return x * math.log(x) if x > 0 else 0.0


def brute_all(rows, classes, seed):
    """Scores with a class for every training word, word by word: the words
    beyond the seed join the class that raises the likelihood most."""
    train = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    top = sorted((w for w in c if w != "\n"), key=lambda w: (-c[w], int(np.uint64(word_hash(w)).view(np.int64))))[:seed]
    top.sort(key=word_hash)
    ident = {w: k for k, w in enumerate(top)}
    of = lambda w: len(top) + 1 if w == "\n" else ident.get(w, len(top))
    pairs = np.zeros((len(top) + 2, len(top) + 2))
    bigrams = [(a, b) for ws in train for a, b in zip(["\n", *ws[:-1]], ws, strict=True)]
    for a, b in bigrams:
        pairs[of(a), of(b)] += 1
    cls = brown.exchange(pairs, np.array([c[w] for w in top], float), classes)
    k = int(cls.max()) + 1
    table = np.zeros((k, k))
    for a, b in bigrams:
        table[cls[of(a)], cls[of(b)]] += 1
    known = {w: int(cls[ident[w]]) for w in top}
    afters, befores = ({w: Counter() for w in c} for _ in range(2))
    for a, b in bigrams:
        afters[a][int(cls[of(b)])] += 1
        befores[b][int(cls[of(a)])] += 1
    for w in c:
        if w in ident or w == "\n":
            continue
        after, before, gains = afters[w], befores[w], []
        for to in range(k - 2):
            cells = Counter({(to, j): x for j, x in after.items()}) + Counter({(i, to): x for i, x in before.items()})
            gain = sum(xlogx(table[x] + m) - xlogx(table[x]) for x, m in cells.items())
            for total in (table[to].sum(), table[:, to].sum()):
                gain -= xlogx(total + c[w]) - xlogx(total)
            gains.append(round(gain, 9))
        known[w] = gains.index(max(gains))
    kind = lambda w: k - 1 if w == "\n" else known.get(w, k - 2)
    table = np.zeros((k, k))
    for a, b in bigrams:
        table[kind(a), kind(b)] += 1
    out = []
    for i, t in rows:
        ws = tokens(t)
        score = 0.0
        for a, b in zip(["\n", *ws[:-1]], ws, strict=True):
            x, y = kind(a), kind(b)
            score += math.log10((table[x, y] + brown.ALPHA) / (table[x].sum() + brown.ALPHA * k))
            if b in known:
                score += math.log10(c[b] / table[:, y].sum())
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((i, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out


def check_all(rows, docs, **sizes):
    key = lambda r: repr(r[:4]) + f"{r[4]:.6f}"
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
                  for r in brown.score(docs, classes=4, **sizes).collect()), key=key)
    want = sorted(brute_all(rows, 4, sizes.get("seed", brown.SEED)), key=key)
    assert [x[:4] for x in got] == [y[:4] for y in want]
    for x, y in zip(got, want, strict=True):
        assert abs(x[4] - y[4]) < 1e-6 * max(1, abs(y[4])) and abs(x[5] - y[5]) < 1e-6 * max(1, abs(y[5]))


def varied(n):
    rng = np.random.default_rng(5)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 5 + i % 20) % 200)) for i in range(n)]


def test_every_training_word_has_a_class(make_docs):
    rows = varied(120)
    check_all(rows, make_docs(rows), seed=10, head=25)


def test_all_words_odd_rows(make_docs, odd_rows):
    check_all(odd_rows, make_docs(odd_rows), seed=3, head=5)


def test_the_head_changes_no_score(make_docs):
    """Whether a word's class travels to the tasks or comes by the join."""
    rows = varied(80)
    one, two = ({(r["doc_id"]): (r["n_known"], round(r["score"], 6)) for r in
                 brown.score(make_docs(rows), classes=4, seed=10, head=h).collect()} for h in (10, 500))
    assert one == two


def test_rare_words_are_told_apart(make_docs):
    """Words beyond the seed that stand in different places get different
    classes: a text that keeps to their places is likelier than one that swaps them."""
    rows = [(i, "the cat runs fast and sees dogs today" if i % 2 else f"the x{i % 40} runs fast and sees y{i % 40} today")
            for i in range(400)]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows += [(held[0], "the x4 runs fast and sees y8 today"), (held[1], "the y8 runs fast and sees x4 today")]
    got = {r["doc_id"]: r["score"] for r in brown.score(make_docs(rows), classes=8, seed=8, head=20).collect()}
    assert got[held[0]] > got[held[1]] + 1
