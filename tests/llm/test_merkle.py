"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _chunk long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc, text, lang, source, n = row
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)]
    return h("".join(told))


def tree(nodes, fanout):
    """(root, proof of each node as (left, right) pairs)"""
    proofs, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a: a + fanout]
            for j in range(len(run)):
                for i in members[a + j]:
                    proofs[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(h("".join(run)))
            held.append([i for j in range(len(run)) for i in members[a + j]])
        nodes, members = up, held
    return nodes[0], proofs


def brute(rows, fanout=16):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((ordered, *tree([leaf(r) for r in ordered], fanout)))
    if not trees:
        return []
    root, upper = tree([t[1] for t in trees], fanout)
    out = []
    for (ordered, subroot, proofs), above in zip(trees, upper):
        for r, proof in zip(ordered, proofs):
            path, mine = proof + above, leaf(r)
            node = mine
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf((r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:]))
            for left, right in path:
                node = h(left + node + right)
            out.append((r[0], mine, subroot, root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def audit(spark, rows, fanout=16, levels=3):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    found = merkle.manifest(docs, probe=merkle.tampered_leaf(), fanout=fanout, levels=levels)
    folded = merkle.fold(F.coalesce("probe", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof_text(F.col("path"))), folded,
                       folded == F.col("root"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def table(n, sources=3):
    rows = [(i, f"Text {i} É ÄB", "en" if i % 2 else None, f"s{i % sources}", i) for i in range(n)]
    return rows + [(n + i, f"Hot {i}", "en", "hot", None) for i in range(2 * n)]


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 1), (4, 2), (16, 3)])
def test_equals_one_tree(spark, fanout, levels):
    rows = table(50, 5)
    assert audit(spark, rows, fanout, levels) == brute(rows, fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17])
def test_ragged_ends(spark, n):
    rows = [(i, "T", "en", "one", 1) for i in range(n)]
    assert audit(spark, rows, 2, 1) == brute(rows, 2)


def test_many_sources(spark):
    rows = [(i, "T", "en", f"s{i % 37:02d}é", 1) for i in range(60)]
    assert audit(spark, rows, 3, 1) == brute(rows, 3)


def test_nulls_repeats_empties_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "x", None, None, None), (1, "", "", "", 0), (1, "", "", "", 0),
            (1, "Other", "", "", 0), (2, "LONG " * 200_000, "en", "b", 1), (3, None, "en", "b", None),
            (10**18, "A", "en", "b", -5), (-7, "B", "en", "b", 2)] + [(9, "same", "en", "c", 4)] * 40
    assert audit(spark, rows) == brute(rows)
    assert audit(spark, rows, 2, 1) == brute(rows, 2)


def test_only_changed_rows_fail(spark):
    rows = table(40)
    found = audit(spark, rows)
    touched = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert {r[0] for r in found if not r[6]} == touched and touched


def test_empty_table(spark):
    assert audit(spark, []) == []


def test_a_round_swaps_at_most_fanout_hashes(spark):
    """Every group that meets in a round holds at most ``fanout`` rows."""
    rows = spark.range(37).select(F.lit(0).cast("long").alias("_s"), F.col("id").alias("_chunk"),
                                  F.lit(37).cast("long").alias("_chunks"), F.md5(F.col("id").cast("string")).alias("digest"),
                                  F.array().cast("array<struct<l:string,r:string>>").alias("path"))
    chunks = rows.select(F.lit("x").alias("source"), "_chunk", "digest")
    sources = spark.createDataFrame([("x", 37, 0, 0)], "source string, _chunks long, _s long, _before long")
    found = {r["_chunk"]: r for r in merkle.exchange(chunks, sources, 4).collect()}
    nodes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(37)]
    root, proofs = tree(nodes, 4)
    assert len(found) == 37
    for i, r in found.items():
        assert r["root"] == root and [(p["l"], p["r"]) for p in r["path"]] == proofs[i]
        assert all(len(p["l"] + p["r"]) <= 3 * 64 for p in r["path"])
