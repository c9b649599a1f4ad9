"""SMOTE oversampling with a distributed k-nearest-neighbour search (SURVEY
F5), exact or approximate.

The search never forms all pairs and never puts an unbounded group in one
task. ``knn`` with ``mode='exact'`` is a best-first search over a k-d tree:

1. rows are rotated on their principal components (orthonormal, so distances
   stay the same);
2. a split tree is laid out on a bounded, hash-drawn sample (``SAMPLE_ROWS``):
   every node halves its widest component at the sample's median. The sample
   decides the layout only: every row walks the tree, and a leaf that holds
   too many rows (many equal points) is dealt into parts by a hash;
3. each leaf keeps the exact bounding box of all its rows. The boxes are
   bounded in number by the layout, so they go to every task. Neighbouring
   leaves make up a block of at most ``BLOCK_ROWS`` rows or one leaf;
4. round one: a row visits its own block; the k-th distance found is its
   radius;
5. round two: the row visits the other blocks of which a leaf's box lies
   within the radius. A box distance is a lower bound, so nothing nearer is
   missed. A row travels once a block, not once a leaf;
6. the visitors of a block are dealt into chunks, and each chunk meets the
   block's rows in a cogrouped pandas UDF. Inside, a visitor meets only the
   leaves within its radius, nearest first; a matrix product bounds the
   distances from below and those that may be among the k nearest are summed
   exactly. The candidates of both rounds merge (ties broken by neighbour key).

``mode='lsh'`` is approximate and labelled so: a forest of random-projection
trees (each leaf is a locality-sensitive bucket of bounded size); a row meets
its own bucket in every tree. Its cost is linear in the rows, its recall
grows with ``tables``.

Keys may be of any type; keys that are no integers are numbered in their
order by a distributed rank first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from riskloom.functions.clinical import hash_bits, hash_unit
from riskloom.operators.prefix import global_rank
from riskloom.session import cut_lineage

KNN_SCHEMA = "__q long, __nbr long, __dist double"
PLACE_SCHEMA = "__key long, __v array<double>, __leaf long"
VISIT_SCHEMA = "__key long, __v array<double>, __block long, __r double"

# Rows of the sample that lays out a tree, and sample rows a leaf at least:
# their ratio bounds the number of leaves.
SAMPLE_ROWS = 40_000
SAMPLE_LEAF = 10
LEAF_ROWS = 128
# Rows of a block of leaves, and blocks that a smaller table is dealt into.
BLOCK_ROWS = 16_384
FEW_BLOCKS = 32
# Parts of an oversized leaf get their own numbers.
_PARTS = 1 << 20


def _near_pairs(qv: np.ndarray, mv: np.ndarray, radius: np.ndarray, kk: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) places that may be within the radius and among the kk
    nearest. Squared distances come from a matrix product, so they have a
    slack far above its rounding."""
    mid = np.nanmean(mv, axis=0) if len(mv) else 0.0
    q, m = qv - mid, mv - mid
    qq, mm = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", m, m)
    square = q @ (-2.0 * m.T)
    square += qq[:, None]
    square += mm
    np.copyto(square, np.inf, where=np.isnan(square))
    limit = np.minimum(np.partition(square, kk - 1, axis=1)[:, kk - 1], radius * radius)
    limit += 1e-10 * (np.nan_to_num(qq) + np.nan_to_num(mm).max(initial=0.0) + np.where(np.isfinite(limit), limit, 0.0))
    return np.nonzero((square <= limit[:, None]) & np.isfinite(square))


def _distances(qv: np.ndarray, mv: np.ndarray) -> np.ndarray:
    """Row by row; squares accumulate feature by feature, in order."""
    acc = np.zeros(len(qv))
    for f in range(qv.shape[1]):
        d = qv[:, f] - mv[:, f]
        acc += d * d
    return np.sqrt(acc)


class _Best:
    """The k nearest (distance, then key) found so far of each visitor."""

    def __init__(self, qv: np.ndarray, qk: np.ndarray, radius: np.ndarray, k: int):
        self.qv, self.qk, self.k, self.radius = qv, qk, k, radius.copy()
        self.dist = np.full((len(qk), k), np.inf)
        self.nbr = np.full((len(qk), k), np.iinfo(np.int64).max)
        self.pairs = 0

    def meet(self, at: np.ndarray, mv: np.ndarray, mk: np.ndarray) -> None:
        """The visitors at these places meet some members."""
        step = max(1, 4_000_000 // max(1, len(mk)))
        for s in range(0, len(at), step):
            self._meet(at[s:s + step], mv, mk)

    def _meet(self, at: np.ndarray, mv: np.ndarray, mk: np.ndarray) -> None:
        k = self.k
        self.pairs += len(at) * len(mk)
        # a row with the visitor's key may be among the nearest and does not count
        copies = int(np.unique(mk, return_counts=True)[1].max())
        row, col = _near_pairs(self.qv[at], mv, self.radius[at], min(k + copies, len(mk)))
        other = self.qk[at[row]] != mk[col]
        row, col = row[other], col[other]
        if not len(row):
            return
        far = _distances(self.qv[at[row]], mv[col])
        hit = np.unique(row)
        mine = at[hit]
        who = np.concatenate([row, np.repeat(hit, k)])
        far = np.concatenate([far, self.dist[mine].ravel()])
        key = np.concatenate([mk[col], self.nbr[mine].ravel()])
        rank = np.lexsort((key, far, who))
        who, far, key = who[rank], far[rank], key[rank]
        keep = np.arange(len(who)) - np.searchsorted(who, who, side="left") < k
        self.dist[mine], self.nbr[mine] = far[keep].reshape(-1, k), key[keep].reshape(-1, k)
        self.radius[mine] = np.minimum(self.radius[mine], self.dist[mine, k - 1])

    def found(self) -> pd.DataFrame:
        row, col = np.nonzero(np.isfinite(self.dist))
        return pd.DataFrame({"__q": self.qk[row], "__nbr": self.nbr[row, col], "__dist": self.dist[row, col]})


def _search(best: _Best, mv: np.ndarray, mk: np.ndarray, leaf: np.ndarray, axes: np.ndarray) -> None:
    """Every visitor meets the leaf whose box is nearest, then the leaves
    whose boxes lie within the distance of its k-th nearest."""
    order = np.argsort(leaf, kind="stable")
    mv, mk = mv[order], mk[order]
    starts = np.flatnonzero(np.diff(leaf[order], prepend=leaf[order[0]] - 1))
    if len(starts) == 1:
        best.meet(np.arange(len(best.qk)), mv, mk)
        return
    ends = np.append(starts[1:], len(mk))
    z = mv @ axes.T
    boxes = _Boxes(axes, np.fmin.reduceat(z, starts, axis=0), np.fmax.reduceat(z, starts, axis=0)).widened()
    step = max(1, 2_000_000 // len(starts))
    for s in range(0, len(best.qk), step):
        at = np.arange(s, min(s + step, len(best.qk)))
        far = boxes.distance(best.qv[at])
        first = np.argmin(np.where(np.isnan(far), np.inf, far), axis=1)
        far[far > _reach(best.radius[at])[:, None]] = np.nan
        for i in np.unique(first):
            some = (first == i) & ~np.isnan(far[:, i])
            best.meet(at[some], mv[starts[i]:ends[i]], mk[starts[i]:ends[i]])
        far[np.arange(len(at)), first] = np.nan
        for i in np.argsort(np.where(np.isnan(far), np.inf, far).min(axis=0), kind="stable"):
            some = far[:, i] <= _reach(best.radius[at])
            if some.any():
                best.meet(at[some], mv[starts[i]:ends[i]], mk[starts[i]:ends[i]])


def _reach(radius: np.ndarray) -> np.ndarray:
    return radius * (1 + 1e-9) + 1e-12


def _principal_directions(points: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """The principal components (orthonormal) and the row count, from sums of
    products per batch (d + 1 squared numbers). The directions lay out the
    tree only; rows with a missing value take no part in them."""
    schema = "i int, s double"

    def products(frames):
        for pdf in frames:
            if len(pdf):
                v = _vectors(pdf["__v"])
                x = np.column_stack([np.ones(len(v)), v])
                whole = x[np.isfinite(x).all(axis=1)]
                total = np.append((whole.T @ whole).ravel(), len(v))
                yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "s": total})

    total = np.zeros((d + 1) ** 2 + 1)
    for r in points.select("__v").mapInPandas(products, schema).groupBy("i").agg(F.sum("s").alias("s")).collect():
        total[r["i"]] = r["s"]
    sums = total[:-1].reshape(d + 1, d + 1)
    cov = np.zeros((d, d))
    if sums[0, 0] > 0:
        mean = sums[0, 1:] / sums[0, 0]
        cov = sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean)
    vals, vecs = np.linalg.eigh(np.where(np.isfinite(cov), cov, 0.0))
    return vecs[:, np.argsort(vals)[::-1]].T.copy(), int(total[-1])


def leaf_rows(n: int) -> int:
    """Rows a leaf: ``LEAF_ROWS``, or more where the sample could not lay out
    so many leaves."""
    return max(LEAF_ROWS, math.ceil(n * SAMPLE_LEAF / SAMPLE_ROWS))


@dataclass
class SplitTree:
    """Nodes in breadth-first order. ``axis`` is a row of ``axes`` (-1: leaf);
    a row goes right when its projection is above ``cut``."""
    axes: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        z = v @ self.axes.T
        while True:
            inner = np.flatnonzero(self.axis[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = self.left[node] + (z[inner, self.axis[node]] > self.cut[node])


def split_tree(sample: np.ndarray, axes: np.ndarray, leaves: int, rng: np.random.Generator | None = None) -> SplitTree:
    """Halve the widest axis (or, with ``rng``, a random one) of the node with
    the most sample rows until there are ``leaves``; a node of equal points
    stays whole."""
    z = sample @ axes.T
    axis, cut, left, held = [-1], [0.0], [-1], [np.arange(len(sample))]
    queue = [(-len(sample), 0)]
    made = 1
    while queue and made < leaves:
        _, i = heapq.heappop(queue)
        rows = z[held[i]]
        order = rng.permutation(len(axes)) if rng is not None else np.argsort(-rows.var(axis=0), kind="stable")
        for d in order:
            c = np.median(rows[:, d])
            above = rows[:, d] > c
            if not above.any():  # more than half of them lie on the largest value
                below = rows[rows[:, d] < c, d]
                if not len(below):
                    continue
                c = below.max()
                above = rows[:, d] > c
            axis[i], cut[i], left[i] = int(d), float(c), len(axis)
            for side in (held[i][~above], held[i][above]):
                axis.append(-1), cut.append(0.0), left.append(-1), held.append(side)
                if len(side) > 1:
                    heapq.heappush(queue, (-len(side), len(axis) - 1))
            made += 1
            break
        held[i] = None
    return SplitTree(axes, np.array(axis), np.array(cut), np.array(left))


def _vectors(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _sample(points: DataFrame, n: int, rows: int) -> np.ndarray:
    """About ``rows`` of the points, by a hash of the key (all when fewer)."""
    drawn = points
    if n > rows:
        drawn = points.filter(hash_unit("__key", "knn_sample") < rows / n)
    return _vectors(drawn.select("__v").toPandas()["__v"])


def _assign(points: DataFrame, tree: SplitTree, most: int) -> DataFrame:
    """(__key, __v, __leaf): every row's leaf; a leaf of more than twice
    ``most`` rows is dealt into parts. Cut in the checkpoint folder."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def walk(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(__leaf=shared.value.leaf_of(_vectors(pdf["__v"])) * _PARTS)

    placed = cut_lineage(points.select("__key", "__v").mapInPandas(walk, PLACE_SCHEMA))
    counts = placed.groupBy("__leaf").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 2 * most)
    big = {r["__leaf"]: math.ceil(r["__n"] / most) for r in counts.collect()}  # at most one row a leaf
    if not big:
        return placed
    parts = F.broadcast(points.sparkSession.createDataFrame(list(big.items()), "__leaf long, __parts long"))
    return cut_lineage(placed.join(parts, "__leaf", "left").select(
        "__key", "__v", (F.col("__leaf") + F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(
            hash_bits("__key", "knn_part") % F.col("__parts"))).alias("__leaf")))


def _meet(visits: DataFrame, blocked: DataFrame, axes: np.ndarray, k: int, chunk: int, pairs=None) -> DataFrame:
    """Top k, within the radius, of every visitor (__key, __v, __block, __r)
    among the rows (__key, __v, __leaf, __block) of its block, other than
    itself; the visitors of a block come in chunks. The accumulator ``pairs``
    counts the distances computed."""
    visits = visits.select("__key", "__v", "__r", F.col("__block").alias("__to"))
    per_block = visits.groupBy("__to").agg(F.count(F.lit(1)).alias("__nv"))
    n_chunks = per_block.select("__to", F.greatest(F.lit(1), F.ceil(F.col("__nv") / chunk)).cast("int").alias("__nc"))
    left = (visits.join(n_chunks, "__to")
            .withColumn("__c", (hash_bits("__key", "knn_chunk") % F.col("__nc")).cast("int")).drop("__nc"))
    right = (blocked.select(F.col("__key").alias("__mkey"), F.col("__v").alias("__mv"), "__leaf", "__block")
             .join(n_chunks.withColumnRenamed("__to", "__block"), "__block")
             .select("__mkey", "__mv", "__leaf", "__block", F.explode(F.sequence(F.lit(0), F.col("__nc") - 1)).alias("__c")))

    def visit(mine: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        best = _Best(_vectors(mine["__v"]), mine["__key"].to_numpy(dtype=np.int64), mine["__r"].to_numpy(), k)
        if len(mine) and len(members):
            _search(best, _vectors(members["__mv"]), members["__mkey"].to_numpy(dtype=np.int64),
                    members["__leaf"].to_numpy(), axes)
        if pairs is not None:
            pairs.add(best.pairs)
        return best.found()

    return left.groupBy("__to", "__c").cogroup(right.groupBy("__block", "__c")).applyInPandas(visit, KNN_SCHEMA)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row's distinct candidates."""
    w = Window.partitionBy("__q").orderBy(F.col("__dist").asc(), F.col("__nbr").asc())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@dataclass
class _Boxes:
    axes: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def widened(self) -> _Boxes:
        """Boxes and projections are sums in another order: a slack far above
        rounding."""
        slack = 1e-9 * (1 + np.abs(np.nan_to_num(self.lo)).max(initial=0) + np.abs(np.nan_to_num(self.hi)).max(initial=0))
        return _Boxes(self.axes, self.lo - slack, self.hi + slack)

    def distance(self, v: np.ndarray) -> np.ndarray:
        """Rows x boxes: how far each box lies from each row."""
        z = v @ self.axes.T
        acc = np.zeros((len(v), len(self.lo)))
        for i in range(z.shape[1]):
            gap = np.maximum(np.maximum(self.lo[:, i] - z[:, i][:, None], z[:, i][:, None] - self.hi[:, i]), 0.0)
            acc += gap * gap
        return np.sqrt(acc)


def _leaf_boxes(placed: DataFrame, axes: np.ndarray) -> pd.DataFrame:
    """(__leaf, n, lo, hi), a row a leaf: its rows and their exact bounds on
    the axes. Rows with a missing value, which are near nothing, bound nothing."""
    d = len(axes)

    def box(frames):
        for pdf in frames:
            if len(pdf):
                z = _vectors(pdf["__v"]) @ axes.T
                order = np.argsort(pdf["__leaf"].to_numpy(), kind="stable")
                leaf, starts, n = np.unique(pdf["__leaf"].to_numpy()[order], return_index=True, return_counts=True)
                lo, hi = np.fmin.reduceat(z[order], starts, axis=0), np.fmax.reduceat(z[order], starts, axis=0)
                yield pd.DataFrame({"__leaf": leaf, "n": n, **{f"lo{i}": lo[:, i] for i in range(d)},
                                    **{f"hi{i}": hi[:, i] for i in range(d)}})

    ends = [(f"{side}{i}", fn) for side, fn in (("lo", F.min), ("hi", F.max)) for i in range(d)]
    parts = placed.select("__v", "__leaf").mapInPandas(box, "__leaf long, n long, " + ", ".join(f"{c} double" for c, _ in ends))
    found = parts.groupBy("__leaf").agg(F.sum("n").alias("n"), *[
        fn(F.when(~F.isnan(c), F.col(c))).alias(c) for c, fn in ends]).toPandas()
    for side in ("lo", "hi"):
        found[side] = list(found[[f"{side}{i}" for i in range(d)]].to_numpy(dtype=float))
    return found[["__leaf", "n", "lo", "hi"]]


def _blocks(leaf: np.ndarray, n: np.ndarray, tree: SplitTree, rows: int) -> np.ndarray:
    """Block of each leaf: runs of leaves that are neighbours in the tree, of
    at most ``rows`` rows or one leaf."""
    place, walk = {}, [0]
    while walk:
        node = walk.pop()
        if tree.axis[node] < 0:
            place[node] = len(place)
        else:
            walk += [tree.left[node] + 1, tree.left[node]]
    order = sorted(range(len(leaf)), key=lambda i: (place[leaf[i] // _PARTS], leaf[i]))
    block, held, out = 0, 0, np.zeros(len(leaf), np.int64)
    for i in order:
        if held and held + n[i] > rows:
            block, held = block + 1, 0
        out[i] = block
        held += n[i]
    return out


def _visits(rows: DataFrame, boxes: _Boxes, block: np.ndarray) -> DataFrame:
    """The blocks other than its own that a row must visit: those of which a
    leaf's box lies within its radius ``__r``. ``boxes`` ascend by block."""
    shared = rows.sparkSession.sparkContext.broadcast((boxes, block))

    def walk(frames):
        b, of = shared.value
        names, starts = np.unique(of, return_index=True)
        step = max(1, 2_000_000 // len(of))
        for pdf in frames:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s:s + step]
                near = b.distance(_vectors(part["__v"])) <= _reach(part["__r"].to_numpy())[:, None]
                go = np.logical_or.reduceat(near, starts, axis=1) & (part["__block"].to_numpy()[:, None] != names)
                row, col = np.nonzero(go)
                yield pd.DataFrame({"__key": part["__key"].to_numpy()[row], "__v": part["__v"].to_numpy()[row],
                                    "__block": names[col], "__r": part["__r"].to_numpy()[row]})

    return rows.select("__key", "__v", "__block", "__r").mapInPandas(walk, VISIT_SCHEMA)


def _exact(points: DataFrame, directions: np.ndarray, n: int, k: int, block: int, chunk: int,
           report: dict | None) -> DataFrame:
    spark = points.sparkSession
    leaves = max(1, min(math.ceil(n / block), SAMPLE_ROWS // SAMPLE_LEAF))
    tree = split_tree(_sample(points, n, SAMPLE_ROWS), directions, leaves)
    placed = _assign(points, tree, block)
    found = _leaf_boxes(placed, directions)  # a row a leaf, bounded above
    of = _blocks(found["__leaf"].to_numpy(), found["n"].to_numpy(), tree, max(block, min(BLOCK_ROWS, math.ceil(n / FEW_BLOCKS))))
    found = found.assign(__block=of).sort_values(["__block", "__leaf"])
    boxes = _Boxes(directions, _vectors(found["lo"]), _vectors(found["hi"])).widened()
    named = F.broadcast(spark.createDataFrame(found[["__leaf", "__block"]]))
    blocked = placed.join(named, "__leaf")
    pairs = spark.sparkContext.accumulator(0) if report is not None else None
    first = blocked.select("__key", "__v", "__block", F.lit(math.inf).alias("__r"))
    near = cut_lineage(_nearest(_meet(first, blocked, directions, k, chunk, pairs), k))
    radius = near.groupBy("__q").agg(F.max("__dist").alias("__d"), F.count(F.lit(1)).alias("__n"))
    known = F.coalesce(F.col("__n"), F.lit(0)) >= min(k, n - 1)
    rows = blocked.join(radius, blocked["__key"] == radius["__q"], "left").select(
        "__key", "__v", "__block", F.when(known, F.col("__d")).otherwise(F.lit(math.inf)).alias("__r"))
    second = _meet(cut_lineage(_visits(rows, boxes, found["__block"].to_numpy())), blocked, directions, k, chunk, pairs)
    if report is not None:
        second = cut_lineage(second)
        report.update(rows=n, leaves=len(found), blocks=int(of.max()) + 1, visited_share=pairs.value / n / n)
    return _nearest(near.select("__q", "__nbr", "__dist").unionByName(second), k)


def _forest(points: DataFrame, directions: np.ndarray, n: int, k: int, block: int, chunk: int, tables: int,
            seed: int) -> DataFrame:
    """Approximate: the nearest among the rows that share a bucket in any of
    ``tables`` trees of random projections."""
    rng = np.random.default_rng(seed)
    sample = _sample(points, n, SAMPLE_ROWS)
    leaves = max(1, min(math.ceil(n / block), SAMPLE_ROWS // SAMPLE_LEAF))
    found = None
    for _ in range(tables):
        axes = rng.normal(size=(2 * directions.shape[1], directions.shape[1]))
        axes /= np.linalg.norm(axes, axis=1, keepdims=True)
        blocked = _assign(points, split_tree(sample, axes, leaves, rng), block)
        blocked = blocked.withColumn("__block", F.col("__leaf"))
        met = _meet(blocked.withColumn("__r", F.lit(math.inf)), blocked, axes, k, chunk)
        found = met if found is None else found.unionByName(met)
    return _nearest(found.distinct(), k)


def knn(df: DataFrame, key: str, cols: Sequence[str], k: int = 5, mode: str = "exact", block_size: int | None = None,
        chunk_size: int | None = None, input_is_cut: bool = False, tables: int = 6, seed: int = 42,
        report: dict | None = None) -> DataFrame:
    """k nearest neighbours (Euclidean) of every row among the other rows:
    (key, rank, nbr_key, dist), rank 1..k by (dist, nbr_key). ``mode`` is
    'exact', or 'lsh': approximate, with ``tables`` random-projection trees.
    ``block_size`` is the rows a leaf holds (default ``leaf_rows``; four times
    as many for 'lsh'). ``report`` takes the rows, the leaves and the share of all
    pairs that the exact search computed."""
    if mode not in ("exact", "lsh"):
        raise ValueError(f"mode {mode!r}")
    cols = list(cols)
    kind = df.schema[key].dataType
    whole = isinstance(kind, (ByteType, ShortType, IntegerType, LongType))
    df = df.select(key, *cols)
    numbered = df if whole else global_rank(df, key, tiebreak=cols, out="__id")
    if not (input_is_cut and whole):
        numbered = cut_lineage(numbered)  # read by several jobs below
    points = numbered.select((F.col(key).cast("long") if whole else F.col("__id")).alias("__key"),
                             F.array(*[F.col(c).cast("double") for c in cols]).alias("__v"))
    directions, n = _principal_directions(points, len(cols))
    if n < 2:
        found = points.sparkSession.createDataFrame([], KNN_SCHEMA + ", rank int")
    elif mode == "exact":
        block = block_size or leaf_rows(n)
        found = _exact(points, directions, n, k, block, chunk_size or max(4096, block), report)
    else:
        block = block_size or 4 * leaf_rows(n)
        found = _forest(points, directions, n, k, block, chunk_size or max(4096, block), tables, seed)
    found = found.select("__q", "rank", "__nbr", "__dist")
    if not whole:
        names = numbered.select("__id", F.col(key).alias("__name"))
        for side in ("__q", "__nbr"):
            found = found.join(names, found[side] == names["__id"]).withColumn(side, F.col("__name")).drop("__id", "__name")
    return found.select(F.col("__q").alias(key), "rank", F.col("__nbr").alias("nbr_key"), F.col("__dist").alias("dist"))


def knn_exact(df: DataFrame, key: str, cols: Sequence[str], k: int = 5, block_size: int | None = None,
              chunk_size: int | None = None, input_is_cut: bool = False, report: dict | None = None) -> DataFrame:
    """``knn`` in its exact mode."""
    return knn(df, key, cols, k, "exact", block_size, chunk_size, input_is_cut, report=report)


def smote(df: DataFrame, key: str, features: Sequence[str], label: str, k: int = 5,
          salt: str = "smote42", neighbours: DataFrame | None = None, block_size: int | None = None,
          mode: str = "exact") -> DataFrame:
    """oversample the minority class up to the majority count. Each new
    row lies on the segment from a minority row to one of its k nearest
    minority rows, at a uniform point; everything random is a hash of
    (key, copy number, salt), so reruns give the same rows. ``mode='lsh'`` takes
    approximate neighbours. Each minority row
    makes floor(need / n_min) or one more copies (the extra copies go to the
    rows ranked first by a hash). Adds ``is_synthetic`` and ``copy_no`` (0 for
    an original, then 1, 2, ..): (key, copy_no) names every row."""
    features = list(features)
    df = cut_lineage(df)  # counted, filtered, joined and unioned below
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df.withColumns({"is_synthetic": F.lit(False), "copy_no": F.lit(0).cast("long")})
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    n_min, n_maj = counts[minority], counts[majority]
    need = n_maj - n_min
    base = df.withColumns({"is_synthetic": F.lit(False), "copy_no": F.lit(0).cast("long")})
    if need <= 0 or n_min < 2:
        return base
    mino = df.filter(F.col(label) == minority).select(key, *features)
    nn = neighbours if neighbours is not None else knn(mino, key, features, k, mode, block_size=block_size,
                                                       input_is_cut=True)  # mino reads the cut df
    kk = min(k, n_min - 1)
    per, extra = divmod(need, n_min)
    ranked = global_rank(mino.select(key).withColumn("__h", hash_bits(key, salt + ":extra")),
                         "__h", tiebreak=[key], out="__r")
    copies = ranked.select(key, (F.lit(per) + (F.col("__r") <= extra).cast("long")).alias("__cnt"))
    jobs = (copies.filter(F.col("__cnt") > 0)
            .select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__cnt") - 1)).alias("__j")))
    tag = F.concat(F.col(key).cast("string"), F.lit("#"), F.col("__j").cast("string"))
    jobs = jobs.select(key, (F.col("__j") + 1).alias("copy_no"), (F.lit(1) + hash_bits(tag, salt + ":nn") % kk).cast("int").alias("rank"),
                       hash_unit(tag, salt + ":gap").alias("__gap"))
    picked = jobs.join(nn.select(key, "rank", "nbr_key"), [key, "rank"])
    src = mino.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    nbr = mino.select(F.col(key).alias("nbr_key"), *[F.col(f).cast("double").alias(f"__n_{f}") for f in features])
    synth = (picked.join(src, key).join(nbr, "nbr_key")
             .select(key, "copy_no", *[(F.col(f) + F.col("__gap") * (F.col(f"__n_{f}") - F.col(f))).alias(f) for f in features]))
    other = {c: F.lit(None).cast(df.schema[c].dataType) for c in df.columns if c not in features and c not in (label, key)}
    synth = synth.select(*[
        F.col(c) if c == key or c in features
        else F.lit(minority).cast(df.schema[label].dataType).alias(c) if c == label
        else other[c].alias(c)
        for c in df.columns], F.lit(True).alias("is_synthetic"), "copy_no")
    base_cast = base.select(*[F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in base.columns])
    return base_cast.unionByName(synth)
