import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalyard.llm.common import stored

from . import cases

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages_over_odd_documents(spark):
    """Every stage takes nulls, repeated rows, extra columns and what the stage before left."""
    docs = cases.documents(spark)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "test-stage")
        after = docs.count()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name in ("quality rules", "toxicity", "SimHash near-dedup"):
            assert after <= before
        before = after


def test_empty_documents(spark):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "test-stage")
        assert docs.count() == 0


def test_mix_numbers_documents_once(spark, monkeypatch):
    """Partitions that are packed otherwise after the sizes are counted, as when executors are lost, change nothing."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    docs = docs.select("*", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = stored(docs.repartition(8), "test-stage")
    want = sorted(r.doc_id for r in corpus_pipeline.mix(spark, docs, DATA).collect())
    real, key = corpus_pipeline.mixing.mix, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    again = sorted(r.doc_id for r in corpus_pipeline.mix(spark, docs.repartition(3, "text"), DATA).collect())
    assert again == want  # reruns agree, however rows are dealt

    def lost(*args, **more):
        out = stored(real(*args, **more), "test-mix")
        spark.conf.set(key, "100")
        return out

    monkeypatch.setattr(corpus_pipeline.mixing, "mix", lost)
    try:
        got = sorted(r.doc_id for r in corpus_pipeline.mix(spark, docs, DATA).collect())
    finally:
        spark.conf.set(key, before)
    assert got == want


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert out.count() > 0
