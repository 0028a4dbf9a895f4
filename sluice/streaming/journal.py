"""The event journal: hourly rollups in batch and as a stream, thinning, pruning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_rollup(events: DataFrame, keys: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """Per UTC hour and key: count, sum, maximum, value of the last event."""
    return events.groupBy(F.date_trunc("hour", ts).alias("bucket_at"), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"), F.max_by(value, F.struct(ts, "event_id")).alias("last_value")
    )


def hourly_stream(events: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The rollup over a stream by event time; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest")).select(F.col("window.start").alias("bucket_at"), *keys, "n", "total", "largest")


def thinned(events: DataFrame, keys: Sequence[str], seconds: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """At most one row per key and period; a kept row starts the period anew.

    Rows are dealt by key and sorted inside their partitions; a task holds one batch and the
    last kept time, however many rows a key has.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for pdf in batches:
            kept = []
            for key, t in zip(zip(*[pdf[k] for k in keys], strict=True), pdf[ts], strict=True):
                ok = key != current or (t - last).total_seconds() >= seconds
                current, last = key, t if ok else last
                kept.append(ok)
            yield pdf[kept]

    return events.where(F.col(ts).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, ts, order).mapInPandas(keep, events.schema)


def pruned(df: DataFrame, key: str, ts: str, tie: str, now: Column, days: int, most: int) -> DataFrame:
    """Rows younger than a number of days, and of each key the newest only."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.filter(F.col(ts) >= now - F.make_interval(days=F.lit(days))).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def sequence_gaps(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Where a log's sequence jumps: the last number before and the first after."""
    w = Window.partitionBy(key).orderBy(seq)
    return df.withColumn("before", F.lag(seq).over(w)).filter(F.col(seq) - F.col("before") > 1).select(key, "before", F.col(seq).alias("after"))
