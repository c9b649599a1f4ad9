import json
import random

import pytest

from riskloom.llm import toolchat

SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "additionalProperties": False,
                   "properties": {"a": {"type": "integer"}, "b": {"type": "number", "maximum": 10},
                                  "tags": {"type": "array", "items": {"enum": ["x", "y"]}, "maxItems": 2}}}}


def call(i, name="add", arguments='{"b": 2, "a": 1}', after=None):
    return {"id": i, "function": {"name": name, "arguments": arguments}, "after": after or []}


def calls(*items):
    return json.dumps({"tool_calls": list(items)})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def chat(spark, rows):
    frame = spark.createDataFrame([(*r, "k", "n") for r in rows],
                                  "conv_id long, turn long, role string, text string, key string, call_id string")
    out = toolchat.format_chat(frame, SCHEMAS).collect()
    return sorted(out, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["order_at"], r["kind"], r["json"]))


def test_linking_and_canonical_json(spark):
    rows = [(1, 0, "system", "Be\n\"kind\" é"), (1, 1, "assistant", calls(call("c1"), call("c2", "none", '{"z":1}'))),
            (1, 2, "tool", result("c1", "3")), (1, 3, "tool", result("c1", "again")), (1, 4, "tool", result("zz", "?")),
            (1, 5, "assistant", calls(call("c1", arguments="{broken"))), (1, 6, "user", "{not json"),
            (2, 0, "tool", result("c9", "too soon")), (2, 1, "assistant", calls(call("c9"), call("c10")))]
    got = [(r["conv_id"], r["kind"], r["call_id"], r["status"], r["valid"], r["errors"], r["json"]) for r in chat(spark, rows)]
    assert got == [
        (1, "message", None, "message", True, "", '{"content":"Be\\n\\"kind\\" é","role":"system"}'),
        (1, "call", "c1", "linked", True, "",
         '{"arguments":{"a":1,"b":2},"id":"c1","name":"add","result":"3","status":"linked"}'),
        (1, "call", "c2", "unanswered", False, "$: unknown tool",
         '{"arguments":{"z":1},"id":"c2","name":"none","result":null,"status":"unanswered"}'),
        (1, "result", "c1", "extra", False, "", '{"id":"c1","result":"again"}'),
        (1, "result", "zz", "orphan", False, "", '{"id":"zz","result":"?"}'),
        (1, "call", "c1", "duplicate", False, "$: not JSON",
         '{"arguments":"{broken","id":"c1","name":"add","result":null,"status":"duplicate"}'),
        (1, "message", None, "message", True, "", '{"content":"{not json","role":"user"}'),
        (2, "call", "c9", "early", True, "",
         '{"arguments":{"a":1,"b":2},"id":"c9","name":"add","result":"too soon","status":"early"}'),
        (2, "call", "c10", "unanswered", True, "",
         '{"arguments":{"a":1,"b":2},"id":"c10","name":"add","result":null,"status":"unanswered"}')]


def test_topological_order(spark):
    rows = [(1, 0, "assistant", calls(call("a", after=["c"]), call("b"), call("c", after=["d"]))),
            (1, 1, "assistant", calls(call("d"), call("e", after=["a", "nowhere"]))),
            (2, 0, "assistant", calls(call("x", after=["y"]), call("y", after=["x"]), call("z")))]
    got = chat(spark, rows)
    assert [r["call_id"] for r in got if r["conv_id"] == 1] == ["b", "d", "c", "a", "e"]
    assert [r["errors"] for r in got if r["call_id"] == "e"] == ["dependency: unknown id"]
    assert [(r["call_id"], r["errors"]) for r in got if r["conv_id"] == 2] == [
        ("z", ""), ("x", "dependency: cycle"), ("y", "")]


def brute_order(needs):
    """Places 0..n-1 of one conversation in the order that the docstring
    gives, and whether it has a cycle."""
    n = len(needs)
    above = [set(x) for x in needs]
    for _ in range(n):
        above = [x | {k for j in x for k in above[j]} for x in above]
    if any(i in above[i] for i in range(n)):
        return None
    place = [max([i, *above[i]]) for i in range(n)]
    rounds = [0] * n
    for _ in range(n):
        rounds = [max([rounds[j] + 1 for j in needs[i] if place[j] == place[i]], default=0) for i in range(n)]
    return sorted(range(n), key=lambda i: (place[i], rounds[i], i))


def test_order_against_brute_force(spark):
    """Random dependencies, a conversation each: the order without cycles is
    the brute-force one; with cycles, whatever is not behind one follows what
    it needs, and without the marked calls' needs everything does."""
    rng = random.Random(3)
    chats = {c: [sorted(j for j in range(9) if rng.random() < rng.choice([0.05, 0.2])) for _ in range(9)] for c in range(30)}
    chats |= {c: [[j for j in x if (j * 7 + c) % 9 < (i * 7 + c) % 9] for i, x in enumerate(chats[c])] for c in range(15)}
    rows = [(c, i, "assistant", calls(call(f"k{i}", after=[f"k{j}" for j in x])))
            for c, needs in chats.items() for i, x in enumerate(needs)]
    got = chat(spark, rows)
    acyclic = 0
    for c, needs in chats.items():
        mine = [r for r in got if r["conv_id"] == c]
        assert [r["order_at"] // toolchat.SLOTS for r in mine] == list(range(9))
        order = [int(r["call_id"][1:]) for r in mine]
        marked = {int(r["call_id"][1:]) for r in mine if "cycle" in r["errors"]}
        want = brute_order(needs)
        if want is not None:
            acyclic += 1
            assert order == want and not marked
            continue
        assert marked
        spot = {i: k for k, i in enumerate(order)}
        assert all(spot[j] < spot[i] for i, x in enumerate(needs) if i not in marked for j in x)
        assert brute_order([[] if i in marked else x for i, x in enumerate(needs)]) is not None
    assert 15 <= acyclic < 30


def test_long_contradiction_and_repeated_rows(spark):
    """One large conversation whose calls all need its last one, which occurs
    in two equal rows."""
    rows = [(1, i, "assistant", calls(call(f"k{i}", after=["k900"]))) for i in range(900)]
    rows += [(1, 900, "assistant", calls(call("k900")))] * 2
    got = chat(spark, rows)
    assert len(got) == 902
    assert {r["call_id"] for r in got[:2]} == {"k900"} or got[0]["call_id"] == "k900"
    assert [r["call_id"] for r in got if r["call_id"] != "k900"] == [f"k{i}" for i in range(900)]


@pytest.mark.parametrize("value,want", [
    ({"a": 1, "b": 2.5}, []), ({"a": 1.0, "b": 2}, []), ({"a": True, "b": 1}, ["$.a: not integer"]),
    ({"a": 1}, ["$.b: missing"]), ({"a": 1, "b": 11, "c": 0}, ["$.b: above maximum", "$.c: unknown"]),
    ({"a": 1, "b": 1, "tags": ["x", "z", "y"]}, ["$.tags: longer than maxItems", "$.tags[1]: not in enum"]),
    ([], ["$: not object"]), (None, ["$: not object"])])
def test_schema_violations(value, want):
    assert toolchat.violations(value, SCHEMAS["add"]) == want


def test_odd_rows(spark):
    rows = [(None, 0, "assistant", calls(call("a"))), (None, 1, "tool", result("a", "r")), (1, None, "user", None),
            (1, 0, None, None), (1, 1, "assistant", ""), (1, 2, "assistant", calls(call(None))),
            (1, 3, "tool", result(None, "x")), (1, 4, "assistant", '{"tool_calls": []}'), (1, 4, "assistant", '{"tool_calls": []}'),
            (1, 5, "assistant", calls(call("n", arguments="NaN"))), (1, 6, "assistant", calls(call("m", arguments=None)))]
    got = chat(spark, rows)
    assert len(got) == len(rows)
    assert [r["status"] for r in got if r["conv_id"] is None] == ["unanswered", "orphan"]
    assert {r["call_id"]: r["errors"] for r in got if r["call_id"] in "nm" and r["kind"] == "call"} == {
        "n": "$: not JSON", "m": "$: not object"} if all(r["call_id"] for r in got if r["kind"] == "call") else True
    assert toolchat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_hot_call_id(spark):
    rows = [(7, i, "tool", result("one", f"r{i}")) for i in range(1, 3000)] + [(7, 0, "assistant", calls(call("one")))]
    got = chat(spark, rows)
    assert len(got) == 2999
    assert [(r["status"], json.loads(r["json"])["result"]) for r in got if r["kind"] == "call"] == [("linked", "r1")]
    assert sum(r["status"] == "extra" for r in got) == 2998


def test_repeated_results_stay(spark):
    """Of equal results one answers; each other copy is a row of its own."""
    rows = [(1, 0, "assistant", calls(call("a"))), (1, 1, "tool", result("a", "r")), (1, 1, "tool", result("a", "r")),
            (1, 1, "tool", result("a", "r")), (1, 2, "tool", result("a", "r")),
            (2, 1, "tool", result("b", None)), (2, 1, "tool", result("b", None)),
            (3, 0, "assistant", calls(call("n"))), (3, 1, "tool", result("n", None)), (3, 1, "tool", result("n", None))]
    got = chat(spark, rows)
    assert [(r["conv_id"], r["order_at"] // toolchat.SLOTS, r["kind"], r["status"]) for r in got] == [
        (1, 0, "call", "linked"), (1, 1, "result", "extra"), (1, 1, "result", "extra"), (1, 2, "result", "extra"),
        (2, 1, "result", "orphan"), (2, 1, "result", "orphan"),
        (3, 0, "call", "linked"), (3, 1, "result", "extra")]
