"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir), gets what its predecessor wrote and returns a
DataFrame with the columns of documents; the last adds the sampled segmentations.

Defined results: rows with null or empty text pass the first three stages (they have no terms,
lines or words), have size 0 in the mix and the one empty segmentation; rows with a null doc_id
are linked with nothing; rows equal in doc_id and text are one after near_dedup; an empty table
gives an empty result; extra columns pass through, but those named like a column of the last
stage are replaced by it.

Stages hold Arrow batches to BATCH_BYTES (Spark's default is 64 MB, or 10,000 rows): a batch is
held by the executor and by its Python worker, twice while it is written. The setting stays in the session.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import dedup, lines, mixing, pieces, toxicity
from sluice.llm.common import materialize, release

BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = spark.conf.get(_BATCH).rstrip("b")
        if not held.isdigit() or int(held) > BATCH_BYTES:
            spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_bounded
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are near copies the first stays; documents left without text go."""
    return lines.dedup_lines(docs)


@_bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return dedup.near_dedup(docs)


@_bounded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks for."""
    return mixing.mix(docs)


@_bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations a row, with inclusion scores; ids decode to the text."""
    return pieces.encode(docs).drop("text")


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("mixing", mix_sources), ("encoding", encode)]
#: clustering, sampling by hashes and piece lattices are not SQL; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        release(*before)
        before = [docs]
    return docs
