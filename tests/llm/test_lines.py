import hashlib

from riskloom.llm import lines
from riskloom.llm.catalog import QUERIES

WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=2):
    key = lambda x: x.strip(WS).translate(LOW)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if i is None or len(held.get(key(x), ())) < min_docs or min(held[key(x)]) == i]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=repr)


CASES = [(1, "A shared LINE here\nown line one\nA shared LINE here"), (2, "x\n a shared line HERE\t\nend"),
         (3, "a shared line here"), (4, "ÄÖ shared line\nshort"), (5, "äÖ shared line"), (6, "ÄÖ SHARED line"),
         (7, None), (8, ""), (9, "\n\n"), (2, "x\n a shared line HERE\t\nend"), (None, "a shared line here")]


def test_against_brute_force(make_docs):
    assert found(lines.dedup_lines(make_docs(CASES))) == brute(CASES)


def test_larger_threshold(make_docs):
    assert found(lines.dedup_lines(make_docs(CASES), min_docs=3)) == brute(CASES, 3)


def test_odd_rows(make_docs, odd_rows):
    assert found(lines.dedup_lines(make_docs(odd_rows))) == brute(odd_rows)


def test_hot_line_is_spread(make_docs):
    """A line of all documents is hot, so its rows meet a broadcast."""
    rows = [(i, f"the line that everyone has\nown line of document {i}") for i in range(3000)]
    got = found(lines.dedup_lines(make_docs(rows)))
    assert got == brute(rows)
    assert sum(r[2] for r in got) == 2999


def test_replace_keeps_columns(make_docs):
    docs = make_docs(CASES)
    out = lines.replace_lines(docs)
    assert out.schema == docs.schema
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert rows[2, "x\nend"]["n_chars"] == 5 and rows[2, "x\nend"]["_doc"] == "a"
    assert rows[3, ""]["n_chars"] == 0
    assert (7, None) in rows and (None, "a shared line here") in rows


def test_empty_table(make_docs):
    assert lines.dedup_lines(make_docs([])).collect() == []
    assert lines.replace_lines(make_docs([])).collect() == []


def test_digest(spark):
    for r in QUERIES["op3_line_dedup"](spark, "/root/testdata/sf0.001").filter("n_dropped = n_lines").collect():
        assert r["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_native_plan(spark, make_docs):
    plan = lines.dedup_lines(make_docs(CASES))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
