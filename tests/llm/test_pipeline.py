from __future__ import annotations

import brute
import corpus_pipeline

SF_DIR = f"{brute.TESTDATA}/sf0.001"


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), "test")
        seen[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in seen[name])
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    assert not any(brute.quality(r["text"])["base_failed"] for r in seen["quality_rules"])
    assert len(seen["near_dedup"]) < len(seen["quality_rules"])
    for r in seen["benchmark_decontamination"]:
        assert not brute.contamination(r["text"], items)["contaminated"]
    assert not any(brute.personal(r["text"]) for r in seen["pii"])
    assert all(r["round_trip"] for r in seen["sentencepiece"])
    kept = {r["doc_id"] for r in seen["near_dedup"]}
    assert {r["doc_id"] for r in seen["sentencepiece"]} == kept


def test_empty_and_odd_tables(spark, docs, odd_rows):
    for rows in ([], odd_rows):
        df = docs(rows)
        for _, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.stored(stage(spark, df, SF_DIR), "test")
        assert df.count() <= len(rows)
