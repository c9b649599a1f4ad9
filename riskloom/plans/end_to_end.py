"""The end-to-end readmission pipeline (the reference's 8 stages) on Spark.

    python -m riskloom.plans.end_to_end --sf-dir /root/testdata/sf0.01 --out /shared/results [--fast]
    python -m riskloom.plans.end_to_end --csv /shared/extract.csv --out /shared/results

1. load (a CSV extract, or encounters derived from the tables), clean and decode, 2. features, 3. split + scale (+ SMOTE for the final fits),
4. compare four models (5-fold CV, SMOTE inside the training folds),
5. random search of the best model, 6. attribution, 7. fairness at 0.5 and at
the Youden threshold, 8. write every result table (one folder each).
Best model and threshold are picked on the test rows, as the reference does.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.clinical import AGE_BIN_EDGES, AGE_BIN_LABELS, bin_right_closed
from riskloom.operators import evaluate as Ev
from riskloom.operators import explain as J
from riskloom.operators import fairness as Fa
from riskloom.operators import prep as P
from riskloom.operators import train as G
from riskloom.operators.cohort import dataset_summary
from riskloom.operators.features import FEATURES
from riskloom.operators.smote import smote
from riskloom.plans import hospital as H
from riskloom.session import cut_lineage, get_session
from riskloom.sources.encounters import load_encounters, read_encounters
from riskloom.sources.lookup import packaged_id_mapping, read_sectioned_lookup
from riskloom.sources.results import write_results

SENSITIVE = ["race", "gender", "age_group"]


def run_end_to_end(spark: SparkSession, sf_dir: str | None = None, out_dir: str | None = None, fast: bool = False,
                   n_trials: int = 50, k: int = 5, csv: str | None = None) -> dict[str, DataFrame]:
    """All stages at the reference settings; ``fast`` states the small model
    profile instead. ``csv`` names a raw extract, else encounters are derived
    from the tables in ``sf_dir``."""
    raw = read_encounters(spark, csv) if csv else load_encounters(spark, sf_dir)
    lookup = read_sectioned_lookup(spark, packaged_id_mapping(spark))
    feat = H.featurize(H.clean_encounters(raw, lookup)).withColumn(
        "age_group", bin_right_closed("age_numeric", AGE_BIN_EDGES, AGE_BIN_LABELS))
    summary = dataset_summary(feat, H.LABEL, FEATURES)
    train, test, scaler = P.prepare_features(feat, H.KEY, H.LABEL, FEATURES, sensitive=SENSITIVE)
    train, test = cut_lineage(train), cut_lineage(test)
    plain_train = train.drop(*SENSITIVE)

    def rs(df):
        return smote(df, H.KEY, FEATURES, H.LABEL, k=5)

    resampled = cut_lineage(rs(plain_train))
    folds = G.cv_folds(plain_train, H.KEY, H.LABEL, k, rs, full=resampled)
    models = G.base_models(fast=fast)
    cmp = G.compare_models(plain_train, test, H.KEY, H.LABEL, FEATURES, models, resample=rs, k=k, folds=folds)
    best = G.best_model(spark, cmp.rows)
    # the finished trials lie beside the results: a rerun goes on where it stood
    found = G.random_search(
        plain_train, test, H.KEY, H.LABEL, FEATURES, models[best], G.SEARCH_SPACES[best], n_trials,
        resample=rs, k=k, folds=folds, table=os.path.join(out_dir, f"trials-{best}-table") if out_dir else None)
    tuned, test_row = found.model, found.test_row
    comparison = Ev.comparison_table(G.results_table(spark, cmp.rows), G.results_table(spark, [{
        "model": f"{best} (tuned)", "position": len(cmp.rows), "cv_auc": found.best_auc, "test_auc": test_row["auc"],
        "test_f1": test_row["f1"], "test_recall": test_row["recall"], "test_precision": test_row["precision"],
        "test_specificity": test_row["specificity"], "test_accuracy": test_row["accuracy"]}]))

    scored = cut_lineage(G.score(tuned, test))
    roc = Ev.roc_points(scored, H.LABEL, "prob")
    youden = float(Ev.youden_threshold(roc).first()["threshold"])
    report = Ev.threshold_report(scored, H.LABEL, "prob", [0.5, youden])
    confusion = Ev.confusion(scored, H.LABEL, "prob", youden).withColumn("threshold", F.lit(youden))
    audit = Fa.fairness_audit(scored, H.LABEL, "prob", ["race", "age_group"], [0.5, youden])
    fairness = Fa.four_fifths(Fa.disparate_impact(audit))

    by_model = None
    for name, model in {**cmp.models, f"{best} (tuned)": tuned}.items():
        part = G.score(model, test).select(H.KEY, H.LABEL, "prob", F.lit(name).alias("model"))
        by_model = part if by_model is None else by_model.unionByName(part)
    by_model = cut_lineage(by_model)
    est = tuned.stages[-1]
    if best == "logreg":
        coef = dict(zip(FEATURES, est.coefficients.toArray().tolist()))
        wide = J.linear_items(test, H.KEY, FEATURES, coef, J.sample_rows(test, H.KEY, 100, salt="bg"))
    else:
        trees, weights = J.extract_trees(spark, est, "gbt" if best.startswith("gbt") else "forest")
        wide = J.tree_items(test, H.KEY, FEATURES, trees, weights)
    wide = cut_lineage(wide)
    importance = J.global_importance(J.to_long(wide))

    tables = {
        "dataset_summary": summary, "model_comparison": comparison, "trials": spark.createDataFrame(found.trials),
        "roc_points": roc, "threshold_report": report, "confusion": confusion, "fairness_groups": audit,
        "fairness_summary": fairness, "feature_importance": importance,
        "local_explanation": J.local_explanation(wide),
        "roc_by_model": Ev.roc_points(by_model, H.LABEL, "prob", by=["model"]),
        "confusion_by_model": Ev.confusion(by_model, H.LABEL, "prob", 0.5, by=["model"]),
        "scaler": P.scaler_table(spark, scaler),
    }
    if out_dir:
        write_results(tables, out_dir)
        G.save_bundle(spark, tuned, scaler, FEATURES, os.path.join(out_dir, "best_model"))
    return tables


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--csv", help="a raw extract in place of the derived encounters")
    ap.add_argument("--out", required=True)
    ap.add_argument("--fast", action="store_true", help="small model profile (10 rounds/trees)")
    ap.add_argument("--trials", type=int, default=50)
    args = ap.parse_args()
    spark = get_session()
    t0 = time.time()
    tables = run_end_to_end(spark, args.sf_dir, args.out, fast=args.fast, n_trials=args.trials, csv=args.csv)
    best = tables["model_comparison"].orderBy(F.desc("position")).first()
    print(json.dumps({"elapsed_sec": round(time.time() - t0, 1), "tuned_model": best["model"],
                      "test_auc": best["test_auc"], "out": args.out}))


if __name__ == "__main__":
    main()
