"""The pipeline's stages against plain versions of their decisions, each on its own input."""

import os
from collections import Counter

import pytest

import corpus_pipeline as P
from quarry.llm import packing, quality_rules
from quarry.llm.common import lean

from .test_near_dedup import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3))
    seen = {}
    for k, (name, step) in enumerate(P.STAGES):
        step(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        seen[name] = (docs, out := spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "decontamination", "packing"]
    rows = lambda df: Counter(map(tuple, df.select("doc_id", "text").collect()))
    given, kept = seen["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    judged = [(i in left) == (labels[i] == 1) for i in {r.doc_id for r in given.collect()} & labels.keys()]
    assert sum(judged) / len(judged) > 0.95
    given, kept = seen["quality_rules"]
    assert rows(kept) == rows(given.join(quality_rules.judge(given).where("kept").select("doc_id").distinct(), "doc_id", "left_semi"))
    given, kept = seen["near_dedup"]
    want = brute([(r.doc_id, r.text) for r in given.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, _, k) in want.items() if k)
    given, kept = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in given.collect() if not any(t in r.text for t in items)}
    given, pieces = seen["packing"]
    total = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(total) == given.count() and all(r["sum(length)"] == r["max(doc_tokens)"] for r in total)


def test_run_on_an_empty_table(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, sf, odd, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns: no stage crashes, each keeps all columns, rows without an id stay unless a rule rejects them."""
    docs = odd.unionByName(odd.where("doc_id is null or doc_id = 7"))
    for k, (name, step) in enumerate(P.STAGES):
        given = docs
        step(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(P.STAGES) - 1:
            assert docs.dtypes == given.dtypes, name
            assert docs.where("doc_id is null").count() == given.where("doc_id is null").count(), name
        if name == "near_dedup":
            assert docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").count() == 0
    assert docs.groupBy("doc_id").count().count() > 0


def _resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_workers_give_memory_back_between_stages():
    """A stage's freed memory is not held while the next one runs in the same worker, also where a later block is still in use."""
    pinned = []

    def run(n):
        blocks = [bytes(4_000) for _ in range(n)]
        pinned.append(bytes(4_000))  # above the others, so the heap's end doesn't move
        yield len(blocks)

    before = _resident_mb()
    assert list(lean(run)(50_000)) == [50_000]
    assert _resident_mb() - before < 60  # 200 MB were in use


def test_packing_loads_the_tokenizer_for_texts_that_need_it():
    e = packing.Encoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    e("plain words")
    assert "tokenizer" not in vars(e)
    e("odd\x1cwords")
    assert "tokenizer" in vars(e)
