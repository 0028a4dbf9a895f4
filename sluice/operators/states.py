"""State machines over ordered events: throttling, rate limits, leases, reopened issues.

Where a state can be told from windows, it is a window. Where each step needs the state that
the step before left, rows are dealt by key, sorted inside their partitions and walked in
batches: a task holds one batch and one state, however many events a key has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def walked(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, start: Callable, result: str) -> DataFrame:
    """df with the columns of result (DDL): step(state, row) -> (state, values), from start() for every key."""
    names = [f.split()[0] for f in result.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for key, row in zip(zip(*[pdf[k] for k in keys], strict=True), pdf.itertuples(index=False), strict=True):
                if key != current:
                    current, state = key, start()
                state, values = step(state, row)
                out.append(values)
            yield pdf.assign(**{n: [v[i] for v in out] for i, n in enumerate(names)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{fields}, {result}")


def throttled(failures: DataFrame, keys: Sequence[str], ts: str, order: str, most: int, window_s: int, lock_s: int, cap_s: int) -> DataFrame:
    """Failures with attempts, wait_s and locked: the window opens at the first failure and, once
    expired, anew; waits double from one second up to cap_s; from most attempts on the key is locked."""

    def step(state, row):
        now = getattr(row, ts).timestamp()
        attempts, ends = state
        attempts, ends = (1, now + window_s) if ends is None or ends < now else (attempts + 1, ends)
        return (attempts, ends), (attempts, min(cap_s, 2 ** min(attempts - 1, 20)), lock_s if attempts >= most else 0)

    return walked(failures, keys, [ts, order], step, lambda: (0, None), "attempts int, wait_s int, locked_s int")


def rate_limited(calls: DataFrame, keys: Sequence[str], ts: str, order: str, limit: int, window_s: int) -> DataFrame:
    """Calls with accepted: at most limit accepted ones in any window; refused calls take no slot."""

    def step(state, row):
        now = getattr(row, ts).timestamp()
        while state and state[0] <= now - window_s:
            state.popleft()
        ok = len(state) < limit
        if ok:
            state.append(now)
        return state, (ok,)

    return walked(calls, keys, [ts, order], step, deque, "accepted boolean")


def in_last(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, into: str) -> DataFrame:
    """Rows of the key in the seconds up to and including each row's own."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn(into, F.count("*").over(w))


def reopened(events: DataFrame, key: str, order: str, kind: str, seen: str = "seen", resolved: str = "resolved") -> DataFrame:
    """Sightings of an issue that stood resolved: the last of its sightings and resolutions before was one."""
    w = Window.partitionBy(key).orderBy(order)
    both = events.where(F.col(kind).isin(seen, resolved)).withColumn("_before", F.lag(kind).over(w))
    return both.where((F.col(kind) == seen) & (F.col("_before") == resolved)).drop("_before")


def issue_state(events: DataFrame, key: str, order: str, kind: str, release: str, seen: str = "seen", resolved: str = "resolved") -> DataFrame:
    """(key, status, first_release, last_release, resolutions): what the log leaves of each issue;
    a resolution is kept though the issue is reopened."""
    mine = events.where(F.col(kind).isin(seen, resolved))
    sighted = F.when((F.col(kind) == seen) & F.col(release).isNotNull(), F.col(order))
    return mine.groupBy(key).agg(
        F.when(F.max_by(kind, order) == resolved, "resolved").otherwise("new").alias("status"), F.min_by(release, sighted).alias("first_release"), F.max_by(release, sighted).alias("last_release"),
        F.count_if(F.col(kind) == resolved).alias("resolutions"),
    )


def capped_signatures(events: DataFrame, key: str, ts: str, tie: str, limit: int, overflow: str = "overflow") -> DataFrame:
    """(bucket_at, key, n): hourly counts; of the keys first seen in an hour the first limit ones
    get their own rows, the others' events are summed as overflow in every hour."""
    first = events.groupBy(key).agg(F.min(F.struct(ts, tie)).alias("at"))
    w = Window.partitionBy(F.date_trunc("hour", f"at.{ts}")).orderBy("at")
    own = first.withColumn("known", F.row_number().over(w) <= limit).select(key, "known")
    named = events.join(own, key).withColumn(key, F.when(F.col("known"), F.col(key).cast("string")).otherwise(overflow))
    return named.groupBy(F.date_trunc("hour", ts).alias("bucket_at"), key).agg(F.count("*").alias("n"))


def replayed_jobs(events: DataFrame, key: str, order: str, kind: str, ts: str, now: Column, lease_s: int) -> DataFrame:
    """(key, status, attempts): state of each job after its log of queued, started, done, failed and
    cancelled; a job whose lease ran out is queued again."""
    last = events.groupBy(key).agg(F.max_by(kind, order).alias("last"), F.max_by(ts, order).alias("at"), F.count_if(F.col(kind) == "started").cast("int").alias("attempts"))
    gone = F.col("at") < now - F.make_interval(secs=F.lit(lease_s))
    status = F.when(F.col("last") != "started", F.col("last")).when(gone, "queued").otherwise("running")
    return last.select(key, status.alias("status"), "attempts")


def claimable(jobs: DataFrame, now: Column, n: int, priority: str = "priority", due: str = "next_run_at", tie: str = "job_id") -> DataFrame:
    """The n queued jobs that are due, by priority, then time."""
    return jobs.where((F.col("status") == "queued") & (F.col(due) <= now)).orderBy(F.desc(priority), due, tie).limit(n)


def outbox_pending(outbox: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Rows of the outbox that no publication names, once each; publish them in key order."""
    return outbox.dropDuplicates([key]).join(published.select(key), key, "left_anti")


#: folders that the keys of published rows are dealt to
SEEN_BUCKETS = 256


def drain_outbox(stream: DataFrame, publish: Callable[[DataFrame], None], seen_path: str, key: str, checkpoint: str):
    """A stream that publishes each outbox row once: a replayed batch finds its keys among those written.

    Keys are written in folders by hash, and a batch reads those of its own keys only. A stop
    between publishing and writing publishes that batch again: receivers must bear a repetition.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        df = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(SEEN_BUCKETS)).cast("int"))
        seen = spark.createDataFrame([], df.select(key, "_bucket").schema)
        own = [r._bucket for r in df.select("_bucket").distinct().collect()]  # SEEN_BUCKETS numbers at most
        try:
            seen = spark.read.schema(seen.schema).parquet(seen_path).where(F.col("_bucket").isin(own))
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new = outbox_pending(df, seen, key).persist()
        publish(new.drop("_bucket").orderBy(key))
        new.select(key, "_bucket").write.mode("append").partitionBy("_bucket").parquet(seen_path)
        new.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
