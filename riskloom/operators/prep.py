"""Split, folds, target encoding, scaling, assembly.

Split and fold membership follows the rank of md5 bits of (key, salt) inside
each class, through the distributed prefix sum (P1): stratified exactly, and
the same rows on every run and every engine (DuckDB computes the same bits).
A map-only variant that keeps the shares in expectation is there as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.clinical import hash_bits
from riskloom.operators.prefix import global_rank
from riskloom.session import sized_broadcast

SPLIT_SALT = "split42"
FOLD_SALT = "fold42"


def stratified_split(df: DataFrame, key: str, label: str, test_frac: float = 0.2,
                     salt: str = SPLIT_SALT, exact: bool = True, out: str = "is_test",
                     keep: Sequence[str] | None = None) -> DataFrame:
    """mark test rows. Per class (a null label is one), the
    round(test_frac * n_c) rows with the smallest md5 bits of (key, salt) are
    test, so every row stays and classes keep their share exactly. With
    ``exact=False``: bits below test_frac * 2^32, a map-only projection that
    keeps the share in expectation. ``keep`` names the columns that are read
    afterwards, so that only they travel."""
    bits = hash_bits(key, salt)
    if not exact:
        return df.withColumn(out, bits < F.lit(int(test_frac * 4294967296)))
    ranked = global_rank(df.withColumn("__h", bits), "__h", by=[label], tiebreak=[key], out="__r", size="__n", keep=keep)
    return (ranked.withColumn(out, F.col("__r") <= F.round(F.col("__n") * F.lit(test_frac)))
            .drop("__h", "__r", "__n"))


def assign_folds(df: DataFrame, key: str, label: str, k: int = 5, salt: str = FOLD_SALT,
                 exact: bool = True, out: str = "fold") -> DataFrame:
    """fold id in [0, k): rank by md5 bits inside each class, fold =
    (rank - 1) mod k, so class counts per fold differ by at most one.
    ``exact=False``: bits mod k, without a shuffle."""
    bits = hash_bits(key, salt)
    if not exact:
        return df.withColumn(out, (bits % k).cast("int"))
    ranked = global_rank(df.withColumn("__h", bits), "__h", by=[label], tiebreak=[key], out="__r")
    return ranked.withColumn(out, ((F.col("__r") - 1) % k).cast("int")).drop("__h", "__r")


# ---------------------------------------------------------------- target encoding

def target_encode_fit(train: DataFrame, cols: Sequence[str], label: str,
                      smoothing: float = 1.0, min_samples_leaf: int = 20) -> DataFrame:
    """F3 fit: long table (column, value, n, prior, encoding). Encoding =
    (1 - w) prior + w mean, w = 1 / (1 + exp(-(n - min_samples_leaf) /
    smoothing)); the prior (training label mean) is one scalar."""
    prior = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    prior = float(prior) if prior is not None else 0.0
    # one pass: each row gives one (column, value) pair per encoded column
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    stats = (train.select(F.col(label).cast("double").alias("__y"), pairs.alias("__p"))
             .groupBy(F.col("__p.column").alias("column"), F.col("__p.value").alias("value"))
             .agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean")))
    w = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n") - F.lit(min_samples_leaf)) / F.lit(smoothing)))
    return stats.select("column", "value", "n", F.lit(prior).alias("prior"),
                        ((F.lit(1.0) - w) * F.lit(prior) + w * F.col("mean")).alias("encoding"))


def target_encode_apply(df: DataFrame, encodings: DataFrame, cols: Sequence[str], prior: float,
                        suffix: str = "") -> DataFrame:
    """F3 apply: replace each column by its encoding; unseen or null values
    get the training prior. One broadcast join per column (size checked)."""
    out = df
    for c in cols:
        enc = encodings.filter(F.col("column") == c).select(
            F.col("value").alias("__v"), F.col("encoding").alias("__e"))
        out = (out.join(sized_broadcast(enc), F.col(c).cast("string") == F.col("__v"), "left")
               .withColumn(c + suffix, F.coalesce(F.col("__e"), F.lit(prior)))
               .drop("__v", "__e"))
    return out


# ---------------------------------------------------------------- scaling

def scale_fit(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """F4 fit: mean and population sd per feature in one aggregate; the
    result is 2 x n_features numbers (bounded), returned to the driver."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.avg(x).alias(f"m_{f}"), F.stddev_pop(x).alias(f"s_{f}")]
    row = train.agg(*aggs).first()
    out = {}
    for f in features:
        m, s = row[f"m_{f}"], row[f"s_{f}"]
        out[f] = (float(m) if m is not None else 0.0,
                  float(s) if s not in (None, 0.0) and s == s else 1.0)
    return out


def scale_apply(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """F4 apply: (x - mean) / sd as literals in one projection (codegen)."""
    scaled = {f: ((F.col(f).cast("double") - F.lit(m)) / F.lit(s)).alias(f + suffix) for f, (m, s) in params.items()}
    if suffix:
        return df.select("*", *scaled.values())
    return df.select(*[scaled.get(c, F.col(c)) for c in df.columns])


def scaler_table(spark, params: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(f, m, s) for f, (m, s) in params.items()], "feature string, mean double, sd double")


# ---------------------------------------------------------------- assembly

def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), out: str = "features") -> DataFrame:
    """feature vector column next to the key, label and sensitive columns."""
    va = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")
    return va.transform(df).select(*keep, out)


def prepare_features(df: DataFrame, key: str, label: str, features: Sequence[str],
                     sensitive: Sequence[str] = (), test_frac: float = 0.2, exact: bool = True,
                     encode_cols: Sequence[str] = ()):
    """split -> (target encoding) -> scaling fit on train -> apply to
    both. Returns (train, test, scaler params); both frames keep key, label,
    sensitive columns and the scaled features as plain columns."""
    feats = list(features)
    read = list(dict.fromkeys([key, label, *sensitive, *feats, *encode_cols]))
    split = stratified_split(df, key, label, test_frac, exact=exact, keep=read)
    if encode_cols:
        train_rows = split.filter(~F.col("is_test"))
        enc = target_encode_fit(train_rows, encode_cols, label)
        prior = train_rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
        split = target_encode_apply(split, enc, encode_cols, float(prior))
        feats += [c for c in encode_cols if c not in feats]
    cols = [key, label, *sensitive, *[f for f in feats if f not in sensitive], "is_test"]
    split = split.select(*dict.fromkeys(cols))
    train = split.filter(~F.col("is_test")).drop("is_test")
    test = split.filter(F.col("is_test")).drop("is_test")
    params = scale_fit(train, feats)
    return scale_apply(train, params), scale_apply(test, params), params
