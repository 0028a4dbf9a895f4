"""The pipeline's stages bound the Arrow batches that executors and their Python workers hold."""

from __future__ import annotations

import corpus_pipeline


def test_stages_bound_arrow_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for _, stage in corpus_pipeline.STAGES[3:4]:
            stage(spark, docs, "")
        assert int(spark.conf.get(key).rstrip("b")) == corpus_pipeline.BATCH_BYTES
        spark.conf.set(key, "1000b")
        corpus_pipeline.mix_sources(spark, docs, "")
        assert spark.conf.get(key) == "1000b"
    finally:
        spark.conf.set(key, before)
