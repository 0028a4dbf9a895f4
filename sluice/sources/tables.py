"""Tables of a data folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The shared folder for what is computed once."""
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("on a cluster name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
    return sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def written(df: DataFrame) -> DataFrame:
    """The rows of a plan that several others read, computed once: a reliable checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``written``, for wide rows of which each reader wants a few columns: by column, compressed; in no order."""
    path = f"{_shared(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def given_up(df: DataFrame) -> DataFrame:
    """The same table. Shuffles of the plans that are done go at once, not when the driver next clears its heap: until
    then they lie on disk."""
    df.sparkSession._jvm.System.gc()
    return df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows of a table dealt by key to tasks of about so many rows each: what a task holds doesn't grow with the table."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to as many tasks as there are cores: for few rows that take long each."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
