"""Every registered library query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sluice.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def close(x, y) -> bool:
    if isinstance(x, (int, float)) and isinstance(y, (int, float)):
        return abs(x - y) <= 1e-5 * max(1, abs(x))
    return x is None and y is None or str(x) == str(y)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=lambda r: [str(x) if not isinstance(x, float) else f"{x:.4f}" for x in r])
    rel = duck.sql(catalog.SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=lambda r: [str(x) if not isinstance(x, float) else f"{x:.4f}" for x in r])
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_suppression_keeps_no_overlap(spark):
    from pyspark.sql import functions as F

    from sluice.operators.geometry import iou

    kept = catalog._boxes(spark, DIR)
    from sluice.operators.geometry import suppress

    k = suppress(kept, "page", "kind").select("page", "kind", "id", F.struct("x0", "y0", "x1", "y1").alias("b"))
    pair = k.alias("a").join(k.alias("c"), ["page", "kind"]).where("a.id < c.id").where(iou(F.col("a.b"), F.col("c.b")) >= 0.5)
    assert pair.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from sluice.streaming.journal import hourly_rollup, hourly_stream

    events = spark.read.parquet(f"{DIR}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    out = hourly_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), ["event_type"], "value", late="60 days")
    q = out.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.bucket_at, r.event_type): (r.n, round(r.total, 6)) for r in spark.table("rolled").collect()}
    want = {(r.bucket_at, r.event_type): (r.n, round(r.total, 6)) for r in hourly_rollup(events, ["event_type"], "value").collect()}
    assert got == want


def test_outbox_is_drained_once(spark, tmp_path):
    from sluice.operators.states import drain_outbox

    rows = spark.range(20).selectExpr("id AS event_id", "'x' AS body")
    rows.where("event_id < 12").union(rows.where("event_id < 3")).coalesce(1).write.parquet(str(tmp_path / "in"))
    sent = []

    def run(checkpoint):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        drain_outbox(stream, lambda df: sent.extend(r.event_id for r in df.collect()), str(tmp_path / "seen"), "event_id", str(tmp_path / checkpoint)).awaitTermination(120)

    run("a")
    rows.where("event_id >= 9").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("b")  # a new checkpoint reads all rows again
    assert sent == list(range(20))


def test_positions(spark):
    from sluice.operators import matching, relational as rel

    p = spark.createDataFrame([(1, 1), (1, 1), (1, 3)], "g int, p int")
    assert [tuple(r) for r in rel.doubled_positions(p, "g", "p").collect()] == [(1, 1, 2)]
    docs = spark.createDataFrame([(1, "A-1"), (2, "B-2"), (3, "C-3")], "document_id int, number string")
    named = spark.createDataFrame([(1, "A-1"), (2, "В-2")], "row_id int, number string")
    assert [r.document_id for r in matching.never_named(named, docs).collect()] == [3]
    kept = rel.insert_absent(p, spark.createDataFrame([(1, 3), (2, 5), (2, 5)], "g int, p int"), ["g", "p"])
    assert kept.count() == 4


def test_rate_limit_carries_state_over_batches(spark):
    from sluice.operators.states import rate_limited

    rows = spark.createDataFrame([(1, i) for i in range(50)], "k int, i int").selectExpr("k", "i", "timestamp_seconds(i) AS ts")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        ok = [r.i for r in rate_limited(rows, ["k"], "ts", "i", limit=2, window_s=10).collect() if r.accepted]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ok == [i for i in range(50) if i % 10 in (0, 1)]
