"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are shuffled by a hash and cut into blocks. In a
period of Q slots a source of weight c/Q has c blocks; its j-th block is
released at floor((j-1) Q / c) and due at ceil(j Q / c). Earliest deadline
first among the released blocks gives a schedule in which every source stays
less than one block from its share at every slot. The schedule of one period
depends on the weights alone, so it is a small table; a block finds its slot
by a join with it, and a document its final place by a closed form.

The main path is DataFrame functions only. Cases: a source without a weight
of its own, null included, belongs to one pool with weight ``other``; when a
source runs out its slots close up and the others go on in the same order;
every row is placed once, repeated rows too; a null id is hashed as ''; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 16
MAX_PERIOD = 10_000
SEED = "mix:"
BUCKET_DIGITS = 3      # leading hex digits of the hash: 4096 groups a class

# Target weights of the corpus in use; they sum to one.
TARGET = {"src0": "0.14", **{f"src{i}": "0.05" for i in range(1, 10)},
          **{f"src{i}": "0.04" for i in range(10, 20)}}
OTHER = "0.01"


def shares(weights: dict[str, str | Fraction], other: str | Fraction) -> tuple[list[str], list[int]]:
    """Class names (the pool last, as '') and their blocks in a period."""
    exact = [Fraction(w) for w in (*weights.values(), other)]
    if any(w <= 0 for w in exact) or sum(exact) != 1:
        raise ValueError("weights must be positive and sum to one, with the pool's")
    period = lcm(*(w.denominator for w in exact))
    if period > MAX_PERIOD:
        raise ValueError(f"weights need a period of {period} slots; at most {MAX_PERIOD}")
    return [*weights, ""], [int(w * period) for w in exact]


def schedule(counts: list[int]) -> list[int]:
    """The class of each slot of a period, by earliest deadline first."""
    period = sum(counts)
    released = [(-(-period // c), i, 1) for i, c in enumerate(counts)]  # (deadline, class, block)
    heapq.heapify(released)
    waiting: list[tuple[int, int, int, int]] = []                       # (release, deadline, ...)
    slots = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(released, heapq.heappop(waiting)[1:])
        _, i, j = heapq.heappop(released)
        slots.append(i)
        if j < counts[i]:
            due = -(-(j + 1) * period // counts[i])
            heapq.heappush(waiting, (j * period // counts[i], due, i, j + 1))
    return slots


def _schedule_table(spark, counts: list[int]) -> DataFrame:
    """(_cls, _nth, _at, _before): slot of the nth block of each class in the
    period, and how many blocks each class has before that slot."""
    done = [0] * len(counts)
    rows = []
    for t, i in enumerate(schedule(counts)):
        rows.append(f"({i}, {done[i]}L, {t}L, array({', '.join(f'{x}L' for x in done)}))")
        done[i] += 1
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS s(_cls, _nth, _at, _before)")


def class_of(source: Column, names: list[str]) -> Column:
    pairs = [F.lit(x) for i, n in enumerate(names[:-1]) for x in (n, i)]
    pool = F.lit(len(names) - 1)
    return F.coalesce(F.create_map(*pairs)[source], pool) if pairs else pool


def _placed(docs: DataFrame, weights: dict | None, other: str | Fraction, doc: str, source: str,
            block_docs: int, tie: list[str]) -> DataFrame:
    """(_row, mix_block, mix_slot, mix_position); the row travels as one
    struct, so its columns may have any names."""
    names, counts = shares(TARGET if weights is None else weights, other)
    period = sum(counts)
    key = F.concat(F.lit(SEED), F.coalesce(F.col(doc).cast("string"), F.lit("")))
    rows = (docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc).alias("_id"),
                        class_of(F.col(source), names).alias("_cls"), F.md5(key.cast("binary")).alias("_h"),
                        (F.xxhash64(*tie) if tie else F.lit(0)).alias("_tie"))
            .withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS)))
    # rank within the class: counts of at most 4096 hash groups, then a rank in each
    sizes = rows.groupBy("_cls", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_cls").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_cls", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_cls", "_bucket").orderBy("_h", "_id", "_tie")
    ranked = (rows.withColumn("_at_row", F.row_number().over(within) - 1)
              .join(shift, ["_cls", "_bucket"])
              .withColumn("_rank", F.col("_at_row") + F.col("_shift")))
    # one row per weight at most
    total = {r["_cls"]: r["_n"] for r in sizes.groupBy("_cls").agg(F.sum("_n").alias("_n")).collect()}
    per = F.element_at(F.array(*[F.lit(c).cast("long") for c in counts]), F.col("_cls") + 1)
    found = (ranked.withColumn("mix_block", F.floor(F.col("_rank") / block_docs))
             .withColumn("_nth", F.col("mix_block") % per)
             .withColumn("_round", F.floor(F.col("mix_block") / per))
             # at most MAX_PERIOD rows
             .join(F.broadcast(_schedule_table(docs.sparkSession, counts)), ["_cls", "_nth"])
             .withColumn("mix_slot", F.col("_round") * period + F.col("_at")))
    ahead = F.lit(0).cast("long")
    for i, c in enumerate(counts):
        blocks = F.col("_round") * c + F.col("_before")[i]
        ahead = ahead + F.least(F.lit(total.get(i, 0)).cast("long"), blocks * block_docs)
    return found.select("_row", "mix_block", "mix_slot",
                        (ahead + F.col("_rank") % block_docs).alias("mix_position"))


def place(docs: DataFrame, weights: dict | None = None, other: str | Fraction = OTHER,
          doc: str = "doc_id", source: str = "source", block_docs: int = BLOCK_DOCS,
          tie: list[str] | None = None) -> DataFrame:
    """``docs`` with ``mix_block`` (block within the class), ``mix_slot`` and
    ``mix_position`` (0, 1, 2, ... over all rows); columns of these names in
    the input are replaced."""
    found = _placed(docs, weights, other, doc, source, block_docs, tie or [])
    own = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_position")]
    return found.select(*[F.col("_row").getField(c).alias(c) for c in own], "mix_block", "mix_slot", "mix_position")


def mixed(docs: DataFrame, weights: dict | None = None, other: str | Fraction = OTHER, doc: str = "doc_id",
          source: str = "source", block_docs: int = BLOCK_DOCS, rows_per_part: int = 20_000) -> DataFrame:
    """``docs`` itself, laid out in mixing order: each partition holds the
    next run of positions, sorted."""
    found = _placed(docs, weights, other, doc, source, block_docs, docs.columns)
    parts = F.floor(F.col("mix_position") / rows_per_part).cast("int")
    n = max(1, -(-docs.count() // rows_per_part))
    return found.repartitionById(n, parts).sortWithinPartitions("mix_position").select("_row.*")


def oracle_sql(weights: dict | None = None, other: str = OTHER, block_docs: int = BLOCK_DOCS) -> str:
    """DuckDB SQL that simulates the scheduler slot by slot and numbers the
    documents in the order of its slots."""
    names, counts = shares(TARGET if weights is None else weights, other)
    period, n = sum(counts), len(counts)
    values = ", ".join(f"({i}, '{name}', {c})" for i, (name, c) in enumerate(zip(names, counts, strict=True)))
    c = "[" + ", ".join(map(str, counts)) + "]"
    zero = "[" + ", ".join("0" for _ in counts) + "]"
    return f"""
WITH RECURSIVE weight(cls, name, c) AS (VALUES {values}),
edf(t, done, pick) AS (
  SELECT -1, {zero}::INT[], NULL::INT
  UNION ALL
  SELECT t + 1, [CASE WHEN i = p THEN done[i] + 1 ELSE done[i] END for i in range(1, {n + 1})], p
  FROM (SELECT t, done,
          (list_min([CASE WHEN done[i] < {c}[i] AND done[i] * {period} // {c}[i] <= t + 1
                     THEN (((done[i] + 1) * {period} + {c}[i] - 1) // {c}[i]) * {n + 1} + i
                     ELSE 1000000000 END for i in range(1, {n + 1})]) % {n + 1})::INT AS p
        FROM edf WHERE t + 1 < {period})),
slots AS (SELECT pick - 1 AS cls, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth
          FROM edf WHERE pick IS NOT NULL),
ranked AS (
  SELECT doc_id, source, cls, c,
         row_number() OVER (PARTITION BY cls ORDER BY md5('{SEED}' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r
  FROM (SELECT doc_id, source, coalesce(w.cls, {n - 1}) AS cls, coalesce(w.c, {counts[-1]}) AS c
        FROM documents d LEFT JOIN weight w ON w.name = d.source AND w.name <> '')),
placed AS (
  SELECT doc_id, source, r, r // {block_docs} AS mix_block,
         (r // {block_docs} // ranked.c) * {period} + s.t AS mix_slot
  FROM ranked JOIN slots s ON s.cls = ranked.cls AND s.nth = (r // {block_docs}) % ranked.c)
SELECT doc_id, source, mix_block::BIGINT AS mix_block, mix_slot::BIGINT AS mix_slot,
       row_number() OVER (ORDER BY mix_slot, r) - 1 AS mix_position
FROM placed
"""
