import random
from fractions import Fraction

import pytest

from riskloom.llm import mixing


def deviation(counts, slots):
    """Largest distance of any class from its share at any slot, in blocks."""
    period, done, worst = sum(counts), [0] * len(counts), Fraction(0)
    for t, i in enumerate(slots, 1):
        done[i] += 1
        worst = max(worst, *(abs(Fraction(t * c, period) - d) for c, d in zip(counts, done, strict=True)))
    return worst


def test_schedule_stays_within_a_block():
    rng = random.Random(0)
    cases = [[1], [1, 1], [99, 1], [90] + [1] * 10, mixing.shares(mixing.TARGET, mixing.OTHER)[1]]
    cases += [[rng.randint(1, 40) for _ in range(rng.randint(1, 14))] for _ in range(150)]
    for counts in cases:
        slots = mixing.schedule(counts)
        assert [slots.count(i) for i in range(len(counts))] == counts
        assert deviation(counts, slots) < 1, counts


def test_documents_follow_the_schedule(make_docs):
    rng = random.Random(1)
    rows = [(i, f"t{i}", rng.choice(["a", "a", "a", "b", "c"])) for i in range(900)]
    weights = {"a": "0.5", "b": "0.3", "c": "0.1"}
    got = mixing.place(make_docs(rows), weights, "0.1", block_docs=4).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(900))
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    # while all sources last, every prefix of whole blocks is within a block of the target
    left = {s: sum(r[2] == s for r in rows) for s in "abc"}
    done, slots = dict.fromkeys("abc", 0), 0
    last = None
    for r in got:
        if r["mix_slot"] != last:
            if min(left[s] - done[s] * 4 for s in "abc") < 4:
                break
            done[r["source"]] += 1
            last = r["mix_slot"]
            slots = last + 1
            for s, w in zip("abc", (0.5, 0.3, 0.1), strict=True):
                assert abs(done[s] - w * slots) < 1 + 1e-9


def test_odd_rows(make_docs):
    rows = [(1, "x", None), (1, "x", None), (2, None, "src0"), (None, "y", "src0"), (None, "y", "src0"),
            (3, "", "unheard"), (4, "z", "src1"), (4, "z", "src1")]
    got = mixing.place(make_docs(rows)).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(len(rows)))
    out = mixing.mixed(make_docs(rows))
    assert out.schema == make_docs(rows).schema and out.count() == len(rows)
    assert {r["mix_position"] for r in out.collect()} == {"e"}      # the input's own column


def test_mixed_lies_in_order(make_docs):
    rows = [(i, f"t{i}", f"src{i % 3}") for i in range(500)]
    want = [r["doc_id"] for r in mixing.place(make_docs(rows)).orderBy("mix_position").collect()]
    got = [r["doc_id"] for r in mixing.mixed(make_docs(rows), rows_per_part=100).collect()]
    assert got == want


def test_empty_table(make_docs):
    assert mixing.place(make_docs([])).collect() == []
    assert mixing.mixed(make_docs([])).collect() == []


def test_weights_are_checked():
    for weights, other in (({"a": "0.5"}, "0.4"), ({"a": "1"}, "0"), ({"a": "0.99999"}, "0.00001")):
        with pytest.raises(ValueError):
            mixing.shares(weights, other)


def test_native_plan(make_docs):
    plan = mixing.place(make_docs([(1, "x", "src0")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
