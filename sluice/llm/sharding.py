"""Size-balanced shards by sampled splitters, in Spark expressions only (law: bytes).

Records are ordered by key = 64-bit hash of the text, so that equal texts are neighbours.
A size-weighted sample of keys (a row enters by a hash of itself, with probability in
proportion to its size) gives quantile boundaries of shards * RANGES_PER_SHARD ranges;
records are range-partitioned by them. Range sizes are then measured; a range above
OVERFULL times the mean (one text with very many copies, say) is subdivided by a hash of
the row. Shards are cut along the measured cells, and slots are numbered by cell
offset plus place in the cell, so no shard is sorted in one task.

Equal texts share a shard unless their range is overfull: sizes near equal come first.

Defined results: null text has size 8 and a null crc; null doc_id sorts first; repeated
rows get a slot each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RANGES_PER_SHARD = 128
SAMPLES_PER_RANGE = 8
OVERFULL = 3.0
#: keys are first looked up by this many leading bits
PREFIX_BITS = 12


def _splitters(rows: DataFrame, ranges: int) -> DataFrame:
    """(prefix, base, bounds): ranges that begin before the prefix, and bounds inside it."""
    total = rows.agg(F.sum("size").alias("total"))
    rate = F.lit(float(ranges * SAMPLES_PER_RANGE)) / F.col("total")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "tie"), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    sample = rows.join(F.broadcast(total)).withColumn("p", F.least(F.lit(1.0), F.col("size") * rate)).where(u < F.col("p")).select("key", (F.col("size") / F.col("p")).alias("w"))
    keys = sample.groupBy("key").agg(F.sum("w").alias("w"))
    #: the sample has ranges * SAMPLES_PER_RANGE rows in expectation, whatever the input
    upto = Window.orderBy("key")
    cut = keys.withColumn("r", F.floor((F.sum("w").over(upto) - F.col("w")) / F.sum("w").over(Window.partitionBy()) * ranges))
    bounds = cut.groupBy("r").agg(F.min("key").alias("bound"))
    inside = bounds.groupBy(F.shiftright("bound", 64 - PREFIX_BITS).alias("prefix")).agg(F.sort_array(F.collect_list("bound")).alias("bounds"))
    every = rows.sparkSession.range(-(1 << (PREFIX_BITS - 1)), 1 << (PREFIX_BITS - 1)).select(F.col("id").alias("prefix"))
    every = every.join(inside, "prefix", "left").withColumn("bounds", F.coalesce("bounds", F.array().cast("array<bigint>")))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("prefix", "bounds", F.coalesce(F.sum(F.size("bounds")).over(before), F.lit(0)).alias("base"))


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    ranges = shards * RANGES_PER_SHARD
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.lit("tie"), "doc_id", text).alias("tie"),
    )
    rows = materialize(rows)
    split = materialize(_splitters(rows, ranges))
    placed = rows.withColumn("prefix", F.shiftright("key", 64 - PREFIX_BITS)).join(F.broadcast(split), "prefix")  # 2**PREFIX_BITS rows, ranges bounds in all
    placed = placed.withColumn("range", (F.col("base") + F.size(F.filter("bounds", lambda b: b <= F.col("key")))).cast("int")).drop("prefix", "bounds", "base")
    sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    mean = F.sum("bytes").over(Window.partitionBy()) / ranges
    parts = sizes.select("range", F.when(F.col("bytes") > OVERFULL * mean, F.ceil(F.col("bytes") / mean)).otherwise(1).cast("int").alias("parts"))
    parts = materialize(parts)
    placed = placed.join(F.broadcast(parts), "range").withColumn("sub", F.pmod(F.col("tie"), F.col("parts").cast("long")).cast("int"))
    cells = placed.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    order = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("bytes").over(Window.partitionBy())
    middle = F.coalesce(F.sum("bytes").over(order), F.lit(0)) + F.col("bytes") / 2
    cells = cells.withColumn("shard", F.least(F.floor(middle / total * shards), F.lit(shards - 1)).cast("int"))
    within = Window.partitionBy("shard").orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.select("range", "sub", "shard", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("offset")))
    #: at most ranges + 2 * ranges cells: each part of a subdivided range has about a mean range
    out = placed.join(F.broadcast(cells), ["range", "sub"])
    place = Window.partitionBy("range", "sub").orderBy("key", "doc_id", "tie")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.row_number().over(place) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """The table as one folder per shard, each file a run of slots in order; columns of docs named
    shard or slot are replaced, rows equal in doc_id and text share a slot.

    Rows are dealt by ranges of (shard, slot), as many tasks as there are shuffle partitions.
    """
    place = assign_shards(docs.select("doc_id", "text"), shards).groupBy(F.col("doc_id").alias("pk"), F.col("text_crc32").alias("pc")).agg(F.min(F.struct("shard", "slot")).alias("at"))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), F.col("doc_id").alias("k"), F.crc32(F.col("text").cast("binary")).alias("c"))
    out = row.join(place, F.col("k").eqNullSafe(F.col("pk")) & F.col("c").eqNullSafe(F.col("pc"))).select("d.*", "at.shard", "at.slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
