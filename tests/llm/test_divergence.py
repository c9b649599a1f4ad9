"""The divergence audit against plain Python over all terms."""

import re
from collections import Counter, defaultdict

from riskloom.llm import divergence


def brute(rows, min_docs=3, top=200):
    """rows: (text, lang, source)"""
    given = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")),
              lang or "", source or "") for t, lang, source in rows]
    held, whole, part, groups = defaultdict(set), defaultdict(Counter), defaultdict(Counter), set()
    for d, (terms, lang, source) in enumerate(given):
        groups.add((lang, source))
        for t in terms:
            held[lang, t].add(d)
            whole[lang][t] += 1
            part[lang, source][t] += 1
    out = []
    for lang, source in groups:
        kept = [t for t in whole[lang] if len(held[lang, t]) >= min_docs]
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + v) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // q

        p, q = shares(part[lang, source]), shares(whole[lang])
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                o = shares(part[lang, other])
                pairs.append((sum(f(p[t], o[t]) for t in kept), other))
        terms = [(f(p[t], q[t]), t) for t in kept if part[lang, source][t] and p[t] > q[t]]
        for kind, found, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(found, key=lambda r: (-r[0], r[1].encode()))[:most]
            out += [(lang, source, kind, item, value, i) for i, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def run(spark, rows, **params):
    frame = spark.createDataFrame([(None, *r, 1, "x") for r in rows],
                                  "doc_id long, text string, lang string, source string, n long, term string")
    return sorted(tuple(r) for r in divergence.audit(frame, **params).collect())


def corpus():
    words = ["Straße", "alpha", "Beta", "gamma", "déjà", "delta", "eps", "zeta", "日本", "omega"]
    rows = []
    for d in range(60):
        text = " ".join(words[(d * k + k * k) % len(words)] for k in range(1, 3 + d % 17))
        rows.append((text + "!", "en" if d % 3 else "fr", f"src{d % 4}"))
    return rows


def test_equals_all_terms(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_nulls_empties_ties_and_repeats(spark):
    rows = corpus() + [(None, None, None), ("", "en", "only empty"), ("one two three", None, "x"),
                       ("one two three", "", "x"), ("one two three", "", None), ("A-B-C", "en", "src0"),
                       ("lonely", "xx", "alone"), (("eps " * 5000) + "tail", "en", "src1")]
    assert run(spark, rows) == brute(rows)


def test_many_ties_are_cut_by_utf8_order(spark):
    shared = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    rows = [(shared, "en", "hot")] * 3 + [("other words here", "en", "cold")] * 3
    found = run(spark, rows)
    assert found == brute(rows)
    assert sum(r[2] == "term" and r[1] == "hot" for r in found) == 200
    small = run(spark, rows, top=7)
    assert small == brute(rows, top=7)


def test_counts_beyond_64_bits_stay_exact(spark):
    from pyspark.sql import functions as F

    n, size, terms = 10**12, 3 * 10**13, 12345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(size), F.lit(terms)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 1) // (size + terms)


def test_long_text_is_cut_between_terms(monkeypatch):
    text = ("añb cd1ef " * 400).encode()
    whole = divergence._TERM.findall(text)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 50)
    parts = list(divergence._pieces(text))
    assert len(parts) > 20 and b"".join(parts) == text
    assert [t for p in parts for t in divergence._TERM.findall(p)] == whole


def test_flushed_tables_sum_to_the_same(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "TABLE_TERMS", 3)
    batch = pa.record_batch([pa.array(["en"] * 4), pa.array(["s"] * 4), pa.array(["a b c d", "a b", None, "a e"])],
                            names=["lang", "source", "text"])
    n, docs = Counter(), Counter()
    parts = list(divergence._count([batch.slice(0, 2), batch.slice(2, 2)]))
    for part in parts:
        for r in part.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert len(parts) > 1 and n == Counter("abcdabae") and docs == Counter("abcdabae")


def test_empty_table_and_no_kept_terms(spark):
    assert run(spark, []) == []
    rows = [("a b", "en", "x"), ("c d", "en", "y")]
    assert run(spark, rows) == brute(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
