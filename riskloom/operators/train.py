"""Train, compare, tune and score with ``pyspark.ml``.

Fits run on a fixed physical layout (hash-partitioned and sorted by key),
so a fit does not depend on how upstream stages happened to order rows.
Independent fits (folds x models, or trials) are submitted from a small
driver thread pool, as ``CrossValidator(parallelism=..)`` does.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.clinical import hash_unit
from riskloom.operators import evaluate as Ev
from riskloom.operators.clean import align_features
from riskloom.operators.compile import score_sql
from riskloom.operators.prep import assign_folds, scale_apply
from riskloom.session import cut_lineage

MODEL_ORDER = ["logreg", "forest", "gbt6", "gbt8"]


@dataclass
class ModelSpec:
    """An estimator factory plus how its row weights are formed."""
    name: str
    make: Callable[[dict], object]  # params -> estimator (featuresCol/labelCol/weightCol set)
    weighting: str  # 'balanced' | 'positive' | 'none'
    params: dict = field(default_factory=dict)


# The node ids of a forest are kept and cut in the checkpoint folder, so a deep
# fit of many trees does not send them again. A boosted model grows one tree at
# a time; walking it costs less than a table of node ids a level. Its errors are
# cut, so its lineage does not grow with its rounds.
_DEEP = {"cacheNodeIds": True, "checkpointInterval": 10}
_BOOSTED = {"cacheNodeIds": False, "checkpointInterval": 10}
HELD_OUT = "__held_out"


def _held_out(p: dict) -> dict:
    """With a share of rows held out, boosting stops where their error does."""
    return {"validationIndicatorCol": HELD_OUT, "validationTol": p.get("validationTol", 0.01)} if p.get("held_out") else {}


def _min_instances(p: dict) -> int:
    """Spark bounds the rows of a child only. A node of fewer than
    ``min_samples_split`` rows cannot have two children of at least half of
    that, so the larger of both bounds stands for it."""
    return max(p.get("minInstancesPerNode", 1), p.get("min_samples_split", 2) // 2)


# --- fixed values: settings of the four models and the search ranges ---

def base_models(fast: bool = False) -> dict[str, ModelSpec]:
    """G1-G4 at the reference settings. ``fast`` is an explicit smaller
    profile (10 trees or rounds, less depth) for tests and quick looks."""
    trees, depth_rf, rounds = (10, 5, 10) if fast else (200, 12, 200)
    return {
        "logreg": ModelSpec("logreg", lambda p: LogisticRegression(
            maxIter=p.get("maxIter", 1000), tol=p.get("tol", 1e-4), elasticNetParam=0.0, standardization=False,
            regParam=p["regParam"], weightCol="__w"), "balanced", {"C": 1.0}),
        "forest": ModelSpec("forest", lambda p: RandomForestClassifier(
            numTrees=p.get("numTrees", trees), maxDepth=p.get("maxDepth", depth_rf),
            minInstancesPerNode=_min_instances(p), featureSubsetStrategy="sqrt",
            weightCol="__w", seed=42, **_DEEP), "balanced"),
        "gbt6": ModelSpec("gbt6", lambda p: GBTClassifier(
            maxIter=p.get("maxIter", rounds), maxDepth=p.get("maxDepth", 6 if not fast else 3),
            stepSize=p.get("stepSize", 0.1), subsamplingRate=p.get("subsamplingRate", 1.0),
            featureSubsetStrategy=str(p.get("featureSubsetStrategy", "all")),
            minInstancesPerNode=p.get("minInstancesPerNode", 1), minInfoGain=p.get("minInfoGain", 0.0),
            weightCol="__w", seed=42, **_BOOSTED, **_held_out(p)), "positive"),
        "gbt8": ModelSpec("gbt8", lambda p: GBTClassifier(
            maxIter=p.get("maxIter", rounds), maxDepth=p.get("maxDepth", 8 if not fast else 4),
            stepSize=p.get("stepSize", 0.1), subsamplingRate=p.get("subsamplingRate", 1.0),
            featureSubsetStrategy=str(p.get("featureSubsetStrategy", "all")),
            minInstancesPerNode=p.get("minInstancesPerNode", 1), minInfoGain=p.get("minInfoGain", 0.0),
            weightCol="__w", seed=42, **_BOOSTED, **_held_out(p)), "positive"),
    }


def _class_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def with_weights(df: DataFrame, label: str, weighting: str, counts: dict, pos_weight: float | None = None) -> DataFrame:
    """Row weight column ``__w``: balanced n / (2 n_c), a positive-class
    weight (neg / pos unless given), or 1. Class counts are two numbers."""
    n = sum(counts.values())
    if weighting == "balanced":
        w = {c: n / (2.0 * m) for c, m in counts.items()}
        expr = F.lit(1.0)
        for c, v in w.items():
            expr = F.when(F.col(label) == c, F.lit(v)).otherwise(expr)
        return df.withColumn("__w", expr)
    if weighting == "positive":
        pw = pos_weight if pos_weight is not None else (counts.get(0, 0) / counts[1] if counts.get(1) else 1.0)
        return df.withColumn("__w", F.when(F.col(label) == 1, F.lit(float(pw))).otherwise(F.lit(1.0)))
    return df.withColumn("__w", F.lit(1.0))


FIT_ROWS = 200_000


def fit_layout(df: DataFrame, key: str, rows_per_partition: int = FIT_ROWS) -> DataFrame:
    """Fixed physical layout for a fit: as many partitions as the rows ask
    for (whatever the cluster), hashed and sorted by the key and a hash of the
    row, so equal keys have a fixed order too."""
    n = max(1, math.ceil(df.count() / rows_per_partition))
    own = F.xxhash64(*[c for c in df.columns if c != "features"])
    return df.repartition(n, key).sortWithinPartitions(key, own)


@dataclass
class LaidOut:
    """A weighted training table as its fits read it, cut once for all of them:
    label, ``__w`` and the feature vector, in the layout of ``fit_layout``."""
    rows: DataFrame
    sum_w: float
    assembler: VectorAssembler


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def lay_out(train: DataFrame, key: str, label: str, features: Sequence[str], weighting: str,
            pos_weight: float | None = None) -> LaidOut:
    data = with_weights(train, label, weighting, _class_counts(train, label), pos_weight)
    assembler = _assembler(features)
    rows = assembler.transform(fit_layout(data.withColumn(label, F.col(label).cast("double")), key))
    return LaidOut(cut_lineage(rows.select(label, "__w", "features")), data.agg(F.sum("__w")).first()[0], assembler)


class Layouts:
    """The tables of a comparison or a search, each laid out once for every
    weighting that is asked for, when a fit first needs it."""

    def __init__(self, key: str, label: str, features: Sequence[str], pos_weight: float | None = None):
        self._args, self._pos_weight = (key, label, list(features)), pos_weight
        self._locks: dict = {}
        self._found: dict = {}
        self._lock = Lock()

    def of(self, name: object, train: DataFrame, weighting: str) -> LaidOut:
        k = (name, weighting)
        with self._lock:
            lock = self._locks.setdefault(k, Lock())
        with lock:
            if k not in self._found:
                self._found[k] = lay_out(train, *self._args, weighting, self._pos_weight)
            return self._found[k]


def fit_model(spec: ModelSpec, train: DataFrame, key: str, label: str, features: Sequence[str],
              params: dict | None = None, pos_weight: float | None = None, laid: LaidOut | None = None) -> PipelineModel:
    """Assemble + estimator fitted on ``train`` (weights per ``spec``). The
    parameter ``held_out`` (a share) marks rows by a hash of the key on which
    a boosted model watches its error to end its rounds. ``laid`` is ``train``
    as ``lay_out`` makes it for the weighting; the fitted model is the same."""
    p = dict(spec.params)
    p.update(params or {})
    if laid is not None and not p.get("held_out"):
        if spec.name.startswith("logreg") or "C" in p:
            p["regParam"] = 1.0 / (p.get("C", 1.0) * laid.sum_w)
        est = spec.make(p).setFeaturesCol("features").setLabelCol(label)
        return PipelineModel([laid.assembler, est.fit(laid.rows)])
    counts = _class_counts(train, label)
    data = with_weights(train, label, spec.weighting, counts, pos_weight)
    if spec.name.startswith("logreg") or "C" in p:
        # sklearn's C on the weighted sum  ==  regParam = 1 / (C * sum of weights) on the weighted mean
        sum_w = data.agg(F.sum("__w")).first()[0]
        p["regParam"] = 1.0 / (p.get("C", 1.0) * sum_w)
    if p.get("held_out"):
        data = data.withColumn(HELD_OUT, hash_unit(key, "held_out42") < p["held_out"])
    est = spec.make(p).setFeaturesCol("features").setLabelCol(label)
    pipe = Pipeline(stages=[_assembler(features), est])
    return pipe.fit(fit_layout(data.withColumn(label, F.col(label).cast("double")), key))


def score(model: PipelineModel | str, df: DataFrame, threshold: float = 0.5, prob: str = "prob",
          pred: str = "pred") -> DataFrame:
    """Probability of the positive class and the label at a threshold.
    ``model`` is a fitted pipeline or its compiled SQL (``compile.model_sql``)."""
    if isinstance(model, str):
        return score_sql(df, model, threshold, prob, pred)
    out = model.transform(df)
    keep = [c for c in df.columns]
    return out.select(*keep, vector_to_array("probability")[1].alias(prob)).withColumn(
        pred, (F.col(prob) >= F.lit(threshold)).cast("int"))


def evaluate_scored(scored: DataFrame, label: str, prob: str = "prob", threshold: float = 0.5,
                    by: Sequence[str] = ()) -> DataFrame:
    """AUC and thresholded metrics of a scored table, per group."""
    by = list(by)
    auc = Ev.roc_auc(scored, label, prob, by=by)
    met = Ev.classification_metrics(Ev.confusion(scored, label, prob, threshold, by=by))
    return Ev.attach(met, auc, by)  # one AUC row per group


def _metrics_row(scored: DataFrame, label: str, prob: str = "prob", threshold: float = 0.5) -> dict:
    r = evaluate_scored(scored, label, prob, threshold).first()
    return r.asDict()


def _judged(r: dict) -> dict:
    """AUC, F1 and recall, and the rows they come from."""
    return {"auc": r["auc"], "f1": r["f1"], "recall": r["recall"], "n": r["tn"] + r["fp"] + r["fn"] + r["tp"],
            "n_pos": r["fn"] + r["tp"]}


def cv_folds(train: DataFrame, key: str, label: str, k: int = 5, resample: Callable | None = None,
             full: DataFrame | None = None):
    """Fold tables for CV: resampled training part and untouched validation
    part per fold, plus the resampled full table. Each is checkpointed once
    and can be shared by any number of models or trials."""
    folds = cut_lineage(assign_folds(train, key, label, k))
    rs = resample or (lambda d: d)
    fold_train = {f: cut_lineage(rs(folds.filter(F.col("fold") != f).drop("fold"))) for f in range(k)}
    fold_val = {f: folds.filter(F.col("fold") == f).drop("fold") for f in range(k)}
    return fold_train, fold_val, (full if full is not None else cut_lineage(rs(train)))


@dataclass
class CompareResult:
    rows: list[dict]
    models: dict[str, PipelineModel]
    fold_rows: list[dict]
    test_rows: list[dict] = field(default_factory=list)  # what each final fit was judged on, fold -1


def compare_models(train: DataFrame, test: DataFrame, key: str, label: str, features: Sequence[str],
                   models: dict[str, ModelSpec], resample: Callable[[DataFrame], DataFrame] | None = None,
                   k: int = 5, threshold: float = 0.5, parallelism: int = 8,
                   pos_weight: float | None = None, folds=None) -> CompareResult:
    """Per model, k-fold CV with ``resample`` (SMOTE) on the training
    folds only, mean AUC / F1 / recall; then fit on the resampled full
    training table and evaluate on test. Resampled folds are computed and laid
    out once and shared by all models (checkpointed)."""
    fold_train, fold_val, full_train = folds or cv_folds(train, key, label, k, resample)
    layouts = Layouts(key, label, features, pos_weight)

    def fit(name, at, table):
        return fit_model(models[name], table, key, label, features, pos_weight=pos_weight,
                         laid=layouts.of(at, table, models[name].weighting))

    def run_fold(args):
        name, f = args
        m = fit(name, f, fold_train[f])
        r = _metrics_row(score(m, fold_val[f], threshold), label, threshold=threshold)
        return {"model": name, "fold": f, **_judged(r)}

    def run_final(name):
        m = fit(name, -1, full_train)
        r = _metrics_row(score(m, test, threshold), label, threshold=threshold)
        return name, m, r

    jobs = [(name, f) for name in models for f in range(k)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        fold_rows = list(pool.map(run_fold, jobs))
        finals = list(pool.map(run_final, list(models)))
    means = cv_means(train.sparkSession, fold_rows)
    rows, fitted = [], {}
    for pos, (name, m, r) in enumerate(finals):
        rows.append({"model": name, "position": pos, **means[name],
                     "test_auc": r["auc"], "test_f1": r["f1"], "test_recall": r["recall"],
                     "test_precision": r["precision"], "test_specificity": r["specificity"],
                     "test_accuracy": r["accuracy"]})
        fitted[name] = m
    return CompareResult(rows, fitted, fold_rows, [{"model": name, "fold": -1, **_judged(r)} for name, _, r in finals])


FOLD_SCHEMA = "model string, fold int, auc double, f1 double, recall double"
RESULT_SCHEMA = ("model string, position int, cv_auc double, cv_f1 double, cv_recall double, failed_folds long, "
                 "test_auc double, test_f1 double, test_recall double, test_precision double, "
                 "test_specificity double, test_accuracy double")


def cv_means(spark, fold_rows: list[dict]) -> dict[str, dict]:
    """H7 over one row per fit, with the number of folds whose AUC is
    undefined (one class only); such a fold is reported, not hidden."""
    folds = spark.createDataFrame([(r["model"], r["fold"], r["auc"], r["f1"], r["recall"]) for r in fold_rows], FOLD_SCHEMA)
    bad = folds.groupBy("model").agg(F.sum(F.col("auc").isNull().cast("long")).alias("failed_folds"))
    return {r["model"]: {c: r[c] for c in ("cv_auc", "cv_f1", "cv_recall", "failed_folds")}
            for r in Ev.cv_summary(folds).join(bad, "model").collect()}


def results_table(spark, rows: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in RESULT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RESULT_SCHEMA)


def best_model(spark, rows: list[dict]) -> str:
    """G6 on the comparison rows."""
    return Ev.pick_best(results_table(spark, rows)).first()["model"]


# ---------------------------------------------------------------- G7

SEARCH_SPACES = {
    # name: (low, high, kind) kind in {'int', 'float', 'log'}
    "gbt6": {"maxIter": (100, 500, "int"), "maxDepth": (3, 10, "int"), "stepSize": (0.01, 0.3, "log"),
             "subsamplingRate": (0.6, 1.0, "float"), "featureSubsetStrategy": (0.6, 1.0, "float"),
             "minInstancesPerNode": (1, 10, "int"), "minInfoGain": (1e-8, 10.0, "log")},
    "gbt8": {"maxIter": (100, 500, "int"), "maxDepth": (3, 12, "int"), "stepSize": (0.01, 0.3, "log"),
             "subsamplingRate": (0.6, 1.0, "float"), "featureSubsetStrategy": (0.6, 1.0, "float"),
             "minInstancesPerNode": (5, 100, "int"), "minInfoGain": (1e-8, 10.0, "log")},
    "forest": {"numTrees": (100, 500, "int"), "maxDepth": (5, 20, "int"), "min_samples_split": (2, 20, "int"),
               "minInstancesPerNode": (1, 10, "int")},
    "logreg": {"C": (1e-4, 10.0, "log")},
}


def sample_params(space: dict, n: int, seed: int = 42) -> list[dict]:
    """Seeded random search over the ranges (log-uniform where marked)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        p = {}
        for name, (lo, hi, kind) in space.items():
            if kind == "int":
                p[name] = int(rng.integers(lo, hi + 1))
            elif kind == "log":
                p[name] = float(math.exp(rng.uniform(math.log(lo), math.log(hi))))
            else:
                p[name] = float(rng.uniform(lo, hi))
        out.append(p)
    return out


TRIAL_SCHEMA = "trial int, fold int, params string, auc double, f1 double, recall double, n long, n_pos long"


@dataclass
class SearchResult:
    model: PipelineModel
    best: dict
    best_trial: int
    best_auc: float
    test_row: dict
    trials: list[dict]


def read_trials(spark, table: str) -> DataFrame:
    """The finished (trial, fold) rows of a search."""
    try:
        return spark.read.schema(TRIAL_SCHEMA).parquet(table)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], TRIAL_SCHEMA)


def random_search(train: DataFrame, test: DataFrame, key: str, label: str, features: Sequence[str],
                  spec: ModelSpec, space: dict, n_trials: int, resample: Callable | None = None,
                  k: int = 5, seed: int = 42, parallelism: int = 8, threshold: float = 0.5, folds=None,
                  pos_weight: float | None = None, table: str | None = None) -> SearchResult:
    """``n_trials`` seeded random trials scored by mean CV AUC; the best
    is refit on the resampled training table and evaluated on test.

    ``table`` names a folder of the shared store: every finished (trial, fold)
    is written there at once, and a rerun with the same settings skips what
    it finds, so a search that was ended goes on where it stood. A stored
    trial whose parameters differ is an error. A trial with an undefined fold
    cannot win; a search in which no trial is defined is an error."""
    spark = train.sparkSession
    trials = sample_params(space, n_trials, seed)
    text = [json.dumps(t, sort_keys=True) for t in trials]
    done = {} if table is None else {(r["trial"], r["fold"]): r.asDict() for r in read_trials(spark, table).collect()}
    for (i, _), r in done.items():
        if i < n_trials and r["params"] != text[i]:
            raise ValueError(f"{table} holds trial {i} of another search")
    fold_train, fold_val, full_train = folds or cv_folds(train, key, label, k, resample)
    layouts = Layouts(key, label, features, pos_weight)

    def run(args):
        i, f = args
        if args in done:
            return done[args]
        m = fit_model(spec, fold_train[f], key, label, features, params=trials[i], pos_weight=pos_weight,
                      laid=layouts.of(f, fold_train[f], spec.weighting))
        r = _metrics_row(score(m, fold_val[f], threshold), label, threshold=threshold)
        row = {"trial": i, "fold": f, "params": text[i], **_judged(r)}
        if table is not None:
            # a folder of its own, as fits end at the same time; the file shows up when it is whole
            names = [c.split()[0] for c in TRIAL_SCHEMA.split(", ")]
            one = spark.createDataFrame([tuple(row[c] for c in names)], TRIAL_SCHEMA).drop("trial", "fold").coalesce(1)
            one.write.mode("overwrite").parquet(f"{table}/trial={i}/fold={f}")
        return row

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        res = list(pool.map(run, [(i, f) for i in range(n_trials) for f in range(k)]))
    means = cv_means(spark, [{**r, "model": str(r["trial"])} for r in res])
    defined = [i for i in range(n_trials) if means[str(i)]["failed_folds"] == 0]
    if not defined:
        raise ValueError("random_search: no trial has an AUC on every fold")
    best = max(defined, key=lambda i: (means[str(i)]["cv_auc"], -i))
    model = fit_model(spec, full_train, key, label, features, params=trials[best], pos_weight=pos_weight)
    test_row = _metrics_row(score(model, test, threshold), label, threshold=threshold)
    rows = [{"trial": i, **{k_: float(v) for k_, v in t.items()}, "cv_auc": means[str(i)]["cv_auc"],
             "failed_folds": means[str(i)]["failed_folds"]} for i, t in enumerate(trials)]
    return SearchResult(model, trials[best], best, means[str(best)]["cv_auc"], test_row, rows)


# ---------------------------------------------------------------- G9, A5

def band(scored: DataFrame, threshold: float, keep: Sequence[str] = (), prob: str = "prob") -> DataFrame:
    """flagged = p >= t; band High (flagged) / Medium (p >= 0.6 t) / Low."""
    p = F.col(prob)
    return scored.select(*keep, prob, (p >= threshold).alias("flagged"),
                         F.when(p >= threshold, "High").when(p >= 0.6 * threshold, "Medium").otherwise("Low")
                         .alias("band"))


def screen(df: DataFrame, model: PipelineModel | str, scaler: dict[str, tuple[float, float]], features: Sequence[str],
           threshold: float, keep: Sequence[str] = ()) -> DataFrame:
    """Align to the feature list, scale, score, flag and band. Stateless,
    so the same code runs on a streaming DataFrame."""
    aligned = align_features(df, features, keep=keep)
    return band(score(model, scale_apply(aligned, scaler), threshold), threshold, keep)


def save_model(model: PipelineModel, path: str) -> None:
    """A5: persist the fitted pipeline (assembler + estimator)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_bundle(spark, model: PipelineModel, scaler: dict[str, tuple[float, float]], features: Sequence[str],
                path: str) -> None:
    """A5: the fitted pipeline, the scaler and the feature list (with its
    order) in one folder, as screening needs them."""
    save_model(model, f"{path}/model")
    rows = [(i, f, *scaler[f]) for i, f in enumerate(features)]
    (spark.createDataFrame(rows, "position int, feature string, mean double, sd double").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/features"))


def load_bundle(spark, path: str) -> tuple[PipelineModel, dict[str, tuple[float, float]], list[str]]:
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()  # one row per feature
    return load_model(f"{path}/model"), {r["feature"]: (r["mean"], r["sd"]) for r in rows}, [r["feature"] for r in rows]
