"""The pipeline, stage by stage, against brute force on the smallest tables."""

import re

import corpus_pipeline as P
from tests.llm.test_operators import DOC, EDGE
from tests.llm.test_pii import BASE
from tidegate.llm import neardup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = P.materialise(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == before.columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    every = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(kept["language_id"]) == {d for d, t in every.items() if re.search(r"[^\W\d_]", t or "")}
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(kept["near_duplicates"]) == {d for d in kept["language_id"] if classes[d] == d}
    bench = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d, t in kept["near_duplicates"].items():
        leaks = any(" " + " ".join(b) + " " in " " + " ".join(re.findall(r"\w+", t.lower())) + " " for b in bench)
        assert not (leaks and d in kept["decontamination"])
    assert len(kept["decontamination"]) > 0.9 * len(kept["near_duplicates"])
    for d, t in kept["pii"].items():
        assert not any(ok(m.group(0)) for p, ok in BASE.values() for m in p.finditer(t))
        if not any(ok(m.group(0)) for p, ok in BASE.values() for m in p.finditer(every[d])) and 'token = "' not in every[d]:
            assert t == every[d]
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept["pii"])


def test_edge_rows(spark, monkeypatch):
    docs = spark.createDataFrame(EDGE, DOC)
    for _, stage in P.STAGES[:-1]:
        docs = P.materialise(stage(spark, docs, SF), "test-edge")
    assert sorted(r["doc_id"] for r in docs.where("doc_id IS NOT NULL").collect()) == [4, 5, 7, 8, 10]
    assert docs.where("doc_id IS NULL").count() == 1
    empty = spark.createDataFrame([], DOC)
    for _, stage in P.STAGES:
        empty_out = stage(spark, empty, SF)
    assert empty_out.count() == 0
