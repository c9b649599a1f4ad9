import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskloom.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def expected(tokenizer, rows, most):
    out = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), most)):
            part = ids[at: at + most]
            out.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check(tokenizer, rows, docs, most):
    got = packing.pack(docs, max_tokens=most).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) \
        == expected(tokenizer, rows, most)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(by), sum(r["length"] for r in got)


def test_odd_rows(tokenizer, make_docs, odd_rows):
    check(tokenizer, odd_rows, make_docs(odd_rows), 4096)


def test_registered_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    used, total = check(tokenizer, rows, docs, 4096)
    assert used <= -(-total // 4096) + 1
    used, total = check(tokenizer, rows, docs, 512)
    assert used <= -(-total // 512) * 1.01


def test_empty_table(make_docs):
    assert packing.pack(make_docs([])).collect() == []


def test_ids_of_unusual_words(tokenizer):
    table = tokens.WordIds(open(tokens.default_path(), encoding="utf-8").read())
    texts = ["don't I'll we've it's 'tis", "Ünïcödé ǅ Σίσυφος İstanbul ſ ª² ½ ĳ", "a\x1cb c d e\x85f",
             "日本語 テキスト 🙂👍🏽", "<|endoftext|> x<|startoftext|>y <|other|>", "é Å ﬁ", "", " \n\n ",
             "x" * 5000, "12345 3.14 1,000", "́ lone", "tab\tand\rreturn"]
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(table.encode(t), "<u4").tolist() == want, t


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 5
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 1e-9]).max(initial=0) < 1e-6


def test_patterns_fill_the_sequence():
    found = packing.patterns(16, 3)
    assert len(found) == len(set(found)) and all(sum(p) == 16 and len(p) <= 3 for p in found)
    assert (16,) in found and (6, 5, 5) in found


@pytest.mark.parametrize("most", [7, 64, 100, 4096])
def test_plan_places_every_piece(most):
    rng = random.Random(most)
    for _ in range(20):
        lengths = Counter(min(most, 1 + int(rng.expovariate(3 / most))) for _ in range(rng.choice([1, 30, 3000])))
        layout = packing.plan(dict(lengths), most)
        seen = Counter()
        for length, first, count, _, _ in layout.tolist():
            assert first == seen[length]
            seen[length] += count
        assert seen == lengths
        for parts in packing.gaps(layout).values():
            at = 0
            for offset, length in parts:
                assert offset == at
                at += length
            assert at <= most


def test_plan_is_close_to_the_least():
    rng = random.Random(1)
    lengths = Counter(min(4096, 20 + int(rng.expovariate(1 / 900))) for _ in range(50_000))
    used, least = packing.fullness(dict(lengths))
    assert used <= least * 1.002


def test_plan_rows_follow_lengths_not_pieces():
    rng = random.Random(2)
    lengths = Counter(min(4096, 20 + int(rng.expovariate(1 / 900))) for _ in range(20_000))
    small = len(packing.plan(dict(lengths)))
    large = len(packing.plan({k: v * 1000 for k, v in lengths.items()}))
    assert large < 8 * small


def test_sequences_follow_the_positions(make_docs):
    """Earlier documents of a length come first, and so do their sequences."""
    rows = [(i, " ".join(["word"] * (3 + 7 * (i % 5)))) for i in range(300)]
    docs = make_docs(rows).drop("h")
    found = []
    for place in ("doc_id", "299 - doc_id"):
        got = packing.pack(docs.selectExpr("*", f"{place} AS h"), max_tokens=64, position="h").collect()
        at = {i: i if place == "doc_id" else 299 - i for i, _ in rows}
        least, by_length = {}, {}
        for r in got:
            least[r["sequence_id"]] = min(least.get(r["sequence_id"], 300), at[r["doc_id"]])
            by_length.setdefault(r["length"], []).append((at[r["doc_id"]], r["sequence_id"]))
        order = [least[s] for s in sorted(least)]
        assert sorted(least) == list(range(len(least))) and order == sorted(order)
        assert len(got) == 300 and least[0] == 0
        found.append({r["doc_id"]: r["sequence_id"] for r in got})
    assert found[0] != found[1] and found[0][0] == found[1][299] == 0
