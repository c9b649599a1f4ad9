"""Registered queries for SMOTE (F5): exact neighbour distances against a
brute-force DuckDB oracle, and the class balance after oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import prep as P
from riskloom.operators.features import FEATURES
from riskloom.operators.smote import knn, knn_exact, smote
from riskloom.plans import hospital as H
from riskloom.plans.oracle import hash_bits_sql, split_cte, with_views
from riskloom.plans.registry import register
from riskloom.session import cut_lineage

# None: 128 rows a leaf, more where the layout sample is too small for so many
# leaves; at sf0.01 this gives nine leaves, so both rounds are exercised
KNN_BLOCK = None


def scaled_train(spark, sf_dir):
    train, _, _ = P.prepare_features(H.hospital_features(spark, sf_dir), H.KEY, H.LABEL, FEATURES)
    return train


def _scaled_sql() -> str:
    return (split_cte() + ",\n"
            "m AS (SELECT " + ", ".join(
                f"avg(CAST({f} AS DOUBLE)) AS m_{f}, CASE WHEN stddev_pop(CAST({f} AS DOUBLE)) > 0 "
                f"THEN stddev_pop(CAST({f} AS DOUBLE)) ELSE 1.0 END AS s_{f}" for f in FEATURES) + " FROM tr),\n"
            "st AS (SELECT t.encounter_id, t.readmitted_binary, " + ", ".join(
                f"(CAST(t.{f} AS DOUBLE) - m.m_{f}) / m.s_{f} AS {f}" for f in FEATURES) + " FROM tr t, m)")


def _dist_sql(a: str, b: str) -> str:
    acc = None
    for f in FEATURES:
        term = f"(({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f}))"
        acc = term if acc is None else f"({acc} + {term})"
    return f"sqrt({acc})"


def _knn_sql(select: str) -> str:
    return with_views(f"""
{select} FROM (
  SELECT a.encounter_id, {_dist_sql('a', 'b')} AS dist,
         CAST(row_number() OVER (PARTITION BY a.encounter_id ORDER BY {_dist_sql('a', 'b')}, b.encounter_id) AS INTEGER) AS rank
  FROM mi a JOIN mi b ON a.encounter_id <> b.encounter_id) WHERE rank <= 5""", "feat",
                      extra=_scaled_sql() + ",\nmi AS (SELECT * FROM st WHERE readmitted_binary = 1)")


KNN_SQL = _knn_sql("SELECT encounter_id, rank, dist")


@register("f5_knn_exact_distances", KNN_SQL)
def f5_knn_exact_distances(spark, sf_dir):
    """Exact 5-NN among minority training rows on the scaled features (the
    distances per rank are independent of how equal-distance ties break)."""
    mino = scaled_train(spark, sf_dir).filter(F.col(H.LABEL) == 1)
    nn = knn_exact(mino, H.KEY, FEATURES, k=5, block_size=KNN_BLOCK, chunk_size=KNN_BLOCK)
    return nn.select(H.KEY, "rank", "dist")


@register("f5_knn_string_keys", _knn_sql("SELECT 'enc-' || encounter_id AS name, rank, dist"))
def f5_knn_string_keys(spark, sf_dir):
    """The same search with keys that are no integers."""
    mino = scaled_train(spark, sf_dir).filter(F.col(H.LABEL) == 1)
    named = mino.select(F.concat(F.lit("enc-"), F.col(H.KEY).cast("string")).alias("name"), *FEATURES)
    return knn_exact(named, "name", FEATURES, k=5, block_size=KNN_BLOCK).select("name", "rank", "dist")


@register("f5_knn_lsh_recall", _knn_sql("SELECT count(*) AS n_pairs, true AS recall_90"))
def f5_knn_lsh_recall(spark, sf_dir):
    """The approximate mode against the exact one: pairs of row and neighbour,
    and whether nine of ten are found (by distance, so ties count)."""
    mino = cut_lineage(scaled_train(spark, sf_dir).filter(F.col(H.LABEL) == 1).select(H.KEY, *FEATURES))
    exact = knn_exact(mino, H.KEY, FEATURES, k=5, input_is_cut=True)
    near = knn(mino, H.KEY, FEATURES, k=5, mode="lsh", input_is_cut=True).select(H.KEY, "rank", F.col("dist").alias("d"))
    met = exact.join(near, [H.KEY, "rank"], "left")
    return met.agg(F.count(F.lit(1)).alias("n_pairs"),
                   (F.avg(F.coalesce(F.col("d") <= F.col("dist") + 1e-12, F.lit(False)).cast("double")) >= 0.9)
                   .alias("recall_90"))


@register("f5_smote_class_counts", with_views("""
SELECT readmitted_binary, is_synthetic, count(*) AS n FROM st GROUP BY 1, 2
UNION ALL
SELECT 1 AS readmitted_binary, true AS is_synthetic,
       CAST(sum(CASE WHEN readmitted_binary = 0 THEN 1 ELSE 0 END)
            - sum(CASE WHEN readmitted_binary = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n
FROM st""".replace("SELECT readmitted_binary, is_synthetic, count(*) AS n FROM st GROUP BY 1, 2",
                   "SELECT readmitted_binary, false AS is_synthetic, count(*) AS n FROM st GROUP BY 1, 2"),
    "feat", extra=_scaled_sql()))
def f5_smote_class_counts(spark, sf_dir):
    """Class counts after SMOTE: the minority is raised to the majority."""
    train = scaled_train(spark, sf_dir)
    res = smote(train, H.KEY, FEATURES, H.LABEL, k=5, block_size=KNN_BLOCK)
    return res.groupBy(H.LABEL, "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


def _smote_sql() -> str:
    """The oversampled table rebuilt in SQL: brute-force neighbours, and the
    same md5-driven choices."""
    bits = lambda what: hash_bits_sql("encounter_id", f"smote42:{what}")
    tag = lambda what: hash_bits_sql("encounter_id || '#' || j", f"smote42:{what}")
    dist = _dist_sql("a", "b")
    new = ", ".join(f"a.{f} + jb.gap * (b.{f} - a.{f}) AS {f}" for f in FEATURES)
    return with_views(f"""
SELECT encounter_id, readmitted_binary, {', '.join(FEATURES)}, false AS is_synthetic, CAST(0 AS BIGINT) AS copy_no FROM st
UNION ALL
SELECT jb.encounter_id, 1 AS readmitted_binary, {new}, true AS is_synthetic, CAST(jb.j + 1 AS BIGINT) AS copy_no
FROM jobs jb JOIN near nn ON nn.encounter_id = jb.encounter_id AND nn.rank = jb.pick
JOIN mi a ON a.encounter_id = jb.encounter_id JOIN mi b ON b.encounter_id = nn.nbr""", "feat", extra=_scaled_sql() + f""",
mi AS (SELECT * FROM st WHERE readmitted_binary = 1),
near AS (SELECT * FROM (SELECT a.encounter_id, b.encounter_id AS nbr,
         row_number() OVER (PARTITION BY a.encounter_id ORDER BY {dist}, b.encounter_id) AS rank
       FROM mi a JOIN mi b ON a.encounter_id <> b.encounter_id) WHERE rank <= 5),
need AS (SELECT count(*) FILTER (readmitted_binary = 1) AS n, count(*) FILTER (readmitted_binary = 0)
         - count(*) FILTER (readmitted_binary = 1) AS more FROM st),
copies AS (SELECT encounter_id, more // n + CASE WHEN row_number() OVER (ORDER BY {bits('extra')}, encounter_id) <= more % n
           THEN 1 ELSE 0 END AS cnt FROM mi, need),
each AS (SELECT encounter_id, unnest(range(cnt)) AS j FROM copies),
jobs AS (SELECT encounter_id, j, 1 + {tag('nn')} % 5 AS pick, {tag('gap')} / 4294967296.0::DOUBLE AS gap FROM each)""")


@register("f5_smote_rows", _smote_sql())
def f5_smote_rows(spark, sf_dir):
    """The oversampled training table, row by row; (encounter_id, copy_no)
    names each."""
    train = scaled_train(spark, sf_dir)
    return smote(train, H.KEY, FEATURES, H.LABEL, k=5, block_size=KNN_BLOCK)
