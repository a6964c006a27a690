from __future__ import annotations

import corpus_pipeline

from moundwork.session import written_once


def test_stages_in_order(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, step in corpus_pipeline.STAGES:
        docs = written_once(step(spark, docs, folder), "test-stage")
        seen.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == columns
    counts = dict(seen)
    assert len(documents) > counts["quality rules"] > counts["near-duplicates"] == counts["personal data"]
    assert corpus_pipeline.run(spark, folder).count() == counts["packing"]


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        docs = written_once(step(spark, docs, folder), "test-stage")
        assert docs.count() == 0
