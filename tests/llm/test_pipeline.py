"""The pipeline on the smallest tables: each stage works on all that its predecessor kept."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        now = docs.count()
        assert 0 < now <= left and docs.select("doc_id").distinct().count() == now
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        left = now
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == left


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_quality_stage_keeps_by_probability_alone(spark):
    import corpus_pipeline
    from llm.importance import resample

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = {r.doc_id: r.probability for r in resample(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect()}
    assert kept == {i for i, x in p.items() if x >= 0.5}


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
