"""Exact kNN against brute force (with a hot spot of duplicates) and SMOTE
properties: balanced classes, synthetic rows on their segments."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import smote as S
from riskloom.operators.smote import SplitTree, knn, knn_exact, smote, split_tree


def _brute(points, k):
    keys = np.array([p[0] for p in points])
    X = np.array([p[1:] for p in points], dtype=float)
    out = {}
    for i, q in enumerate(X):
        d = np.sqrt(((X - q) ** 2).sum(1))
        d[i] = np.inf
        idx = np.lexsort((keys, d))[:k]
        out[keys[i]] = [round(float(d[j]), 9) for j in idx]
    return out


def test_knn_exact_matches_brute_force_with_hot_spot(spark):
    rng = np.random.default_rng(3)
    pts = []
    for i in range(900):
        if i % 3 == 0:  # a third of the rows share one point
            pts.append((i, 1.0, 1.0, 1.0))
        else:
            pts.append((i, *[float(x) for x in rng.integers(0, 6, 3)]))
    df = spark.createDataFrame(pts, "id long, a double, b double, c double")
    nn = knn_exact(df, "id", ["a", "b", "c"], k=5, block_size=64, chunk_size=50)
    got = {}
    for r in nn.collect():
        got.setdefault(r["id"], []).append((r["rank"], round(r["dist"], 9)))
    want = _brute(pts, 5)
    assert set(got) == set(want)
    for key, lst in got.items():
        assert [d for _, d in sorted(lst)] == want[key]


def _cloud(spark, n=1200, d=8):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(n - n // 3, d)), np.tile(rng.normal(size=d), (n // 3, 1))])
    names = [f"x{i}" for i in range(d)]
    return [(i, *map(float, r)) for i, r in enumerate(x)], names


def test_best_first_search_visits_few_pairs(spark):
    pts, names = _cloud(spark, 2400, 4)
    df = spark.createDataFrame(pts, "id long, " + ", ".join(f"{c} double" for c in names))
    report = {}
    got = {}
    for r in knn_exact(df, "id", names, k=4, block_size=60, report=report).collect():
        got.setdefault(r["id"], {})[r["rank"]] = round(r["dist"], 9)
    want = _brute(pts, 4)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == want
    assert report["leaves"] >= 40 and report["visited_share"] < 0.35  # a third of the rows are one point


def test_rows_travel_once_a_block_not_once_a_leaf(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pts = [(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(1600, 8)) + 1e4)]  # far from the origin
    names = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame(pts, "id long, " + ", ".join(f"{c} double" for c in names))
    sent, visits = [], S._visits

    def counted(*args, **kw):
        out = visits(*args, **kw)
        sent.append(out.count())
        return out

    monkeypatch.setattr(S, "_visits", counted)
    report = {}
    got = {}
    for r in knn_exact(df, "id", names, k=3, block_size=8, report=report).collect():
        got.setdefault(r["id"], {})[r["rank"]] = round(r["dist"], 9)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == _brute(pts, 3)
    # a row may have to see most of the leaves, but there are few blocks
    assert report["leaves"] >= 200 and sum(sent) <= len(pts) * S.FEW_BLOCKS


def test_missing_values_hide_no_neighbours(spark):
    rows = [(i, float(i), 0.0) for i in range(4)] + [(10 + i, None, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {(r["id"], r["rank"]): (r["nbr_key"], r["dist"]) for r in knn_exact(df, "id", ["a", "b"], k=5).collect()}
    assert {q for q, _ in got} == {0, 1, 2, 3} and len(got) == 12
    assert got[(0, 1)] == (1, 1.0) and got[(0, 3)] == (3, 3.0)


def test_keys_of_any_type(spark):
    pts, names = _cloud(spark, 300, 3)
    df = spark.createDataFrame([(f"k{p[0]:04d}", *p[1:]) for p in pts], "name string, " + ", ".join(f"{c} double" for c in names))
    want = _brute(pts, 3)
    got = {}
    for r in knn_exact(df, "name", names, k=3, block_size=40).collect():
        assert r["nbr_key"] != r["name"] and r["nbr_key"].startswith("k")
        got.setdefault(int(r["name"][1:]), {})[r["rank"]] = round(r["dist"], 9)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == want


def test_approximate_mode_finds_nine_of_ten(spark):
    pts, names = _cloud(spark)
    df = spark.createDataFrame(pts, "id long, " + ", ".join(f"{c} double" for c in names))
    want = _brute(pts, 5)
    hits = sum(r["dist"] <= want[r["id"]][r["rank"] - 1] + 1e-9
               for r in knn(df, "id", names, k=5, mode="lsh", block_size=200).collect())
    assert hits >= 0.9 * 5 * len(pts)


def test_small_and_equal_tables(spark):
    one = spark.createDataFrame([(1, 0.0)], "id long, a double")
    assert knn_exact(one, "id", ["a"]).count() == 0
    same = spark.createDataFrame([(i, 2.0) for i in range(50)], "id long, a double")
    got = knn_exact(same, "id", ["a"], k=2, block_size=5).collect()
    assert len(got) == 100 and all(r["dist"] == 0 for r in got)
    assert [r["nbr_key"] for r in got if r["id"] == 7] == [0, 1]


def test_split_tree_halves_the_widest_axis():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(800, 3)) * [10, 1, 0.1]
    tree = split_tree(v, np.eye(3), 16)
    assert isinstance(tree, SplitTree) and tree.axis[0] == 0
    sizes = np.unique(tree.leaf_of(v), return_counts=True)[1]
    assert len(sizes) == 16 and sizes.min() == sizes.max() == 50
    # one value holds most rows: it stays together, the rest is split off
    tree = split_tree(np.array([[1.0]] * 60 + [[0.0]] * 20), np.eye(1), 4)
    assert sorted(np.unique(tree.leaf_of(np.array([[1.0], [0.0]])), return_counts=True)[1]) == [1, 1]


def test_smote_balances_and_stays_on_segments(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 5 == 0), float(rng.normal()), float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    out = smote(df, "id", ["a", "b"], "y", k=3, block_size=40)
    counts = {(r["y"], r["is_synthetic"]): r["n"] for r in
              out.groupBy("y", "is_synthetic").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts[(1, False)] + counts[(1, True)] == counts[(0, False)]
    assert (0, True) not in counts
    # every synthetic row lies on a segment from its origin to a minority row
    mino = {r[0]: np.array(r[2:]) for r in rows if r[1] == 1}
    for r in out.filter(F.col("is_synthetic")).collect():
        x = mino[r["id"]]
        p = np.array([r["a"], r["b"]])
        ok = False
        for other in mino.values():
            d = other - x
            if np.allclose(d, 0):
                ok = ok or np.allclose(p, x)
                continue
            t = float(np.dot(p - x, d) / np.dot(d, d))
            if -1e-9 <= t <= 1 + 1e-9 and np.allclose(x + t * d, p, atol=1e-9):
                ok = True
                break
        assert ok
