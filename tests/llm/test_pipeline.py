import re
from collections import Counter

import corpus_pipeline as pipeline
from riskloom.llm import mixing, neardup, quality

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    seen = {}
    at = docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, SF)
        if name != names[-1]:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        seen[name] = (at, spark.read.parquet(str(tmp_path / name)))
        at = seen[name][1]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = seen["quality_rules"]
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(before).collect()}
    assert ids(after) == {i for i, ok in verdict.items() if ok}

    before, after = seen["line_dedup"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    held = Counter()
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i in sorted(old):
        for k in {low(x) for x in old[i].split("\n")}:
            held[k] += len(k) >= 10
            first.setdefault(k, i)
    want = {i: "\n".join(x for x in t.split("\n") if held[low(x)] < 2 or first[low(x)] == i) for i, t in old.items()}
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    assert got == {i: t for i, t in want.items() if t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] != old[r["doc_id"]])

    before, after = seen["near_dedup"]
    assert ids(after) == {r["class_id"] for r in neardup.classes(before).collect()}

    before, after = seen["source_mixing"]
    assert ids(after) == ids(before) and after.count() == before.count()
    order = [r["doc_id"] for r in mixing.place(before, tie=before.columns).orderBy("mix_position").collect()]
    assert [r["doc_id"] for r in after.collect()] == order

    before, after = seen["best_fit_packing"]
    assert ids(after) == ids(before)


def test_run_equals_the_stages(spark):
    out = pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in out) == sorted(
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect())


def test_sequences_follow_the_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = {r["doc_id"]: r["mix_position"] for r in mixing.place(docs, tie=docs.columns).collect()}
    least = {}
    for r in pipeline.best_fit_packing(spark, docs, SF).collect():
        least[r["sequence_id"]] = min(least.get(r["sequence_id"], len(place)), place[r["doc_id"]])
    order = [least[s] for s in sorted(least)]
    assert order == sorted(order) and order[0] == 0 and sorted(least) == list(range(len(least)))


def test_empty_documents(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        at = stage(spark, at, SF)
    assert at.collect() == []
