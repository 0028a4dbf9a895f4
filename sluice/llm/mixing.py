"""Mixing sources to target weights by Pareto order sampling, in Spark expressions only.

Every source gets a target of words (``source_targets``): the corpus total shared by
weight, never above ``max_repeat`` times the source's own size, the excess reshared
among the others. A source that needs ratio = target / size takes every document
floor(ratio) times for certain. The words that are left are an unequal-probability sample
of fixed size: a document of s words has inclusion probability p = min(1, c * m), m being
the square root of the largest power of two not above s, and c such that the sum of p * s
over the source is what is left (``_scale``). Longer documents are likelier to enter once
more; those with p = 1 are certain. Documents enter in order of the Pareto ranking
[u / (1 - u)] / [p / (1 - p)], u a hash of seed, doc_id and text, until the words that
are left are filled; the document that crosses that line enters if this brings the
total nearer.

No source is gathered in one task: ranks are binned, bins are summed before the shuffle,
and only rows of the one bin that holds a source's line are put in order.

Defined results: null text has size 0; null source is a source of its own, last in
order; an empty table gives an empty mix; repeated rows count each time and equal rows
(doc_id and text) are taken alike, or by row order at the very line; extra columns
pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

BINS = 1 << 16
MAX_REPEAT = 3


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> with weight, target, ratio. One row per source.

    Resharing the excess until none is above its cap ends where every source has
    min(cap, level * weight): sources fill up in order of cap / weight, and level is what
    is left over the weights that are left. The windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("k", (F.row_number().over(by_name) - 1) % len(weights))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("k") + 1)).drop("k")
    w = w.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("fills", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("fills", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    #: the first source whose cap is not reached fixes the level for all after it
    w = w.withColumn("open", F.min(F.when(F.col("fills") >= F.col("level"), F.struct("fills", "level"))).over(everything)["level"])
    w = w.withColumn("target", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("open") * F.col("weight"))))
    return w.select("source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"))


def _draw(seed: int) -> Column:
    """u in (0, 1) by seed, doc_id and text."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _class(size: Column) -> Column:
    """Position of the highest bit: documents of one class have one inclusion probability."""
    return F.length(F.bin(size)) - 1


def _inclusion(size: Column, c: Column) -> Column:
    return F.least(F.lit(1.0), c * F.pow(F.lit(2.0), _class(size) / 2))


def _pareto(u: Column, p: Column) -> Column:
    odds = F.greatest(p, F.lit(1e-12)) / F.greatest(1 - p, F.lit(1e-12))
    return F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / odds)


def _scale(rows: DataFrame, part: DataFrame) -> DataFrame:
    """(s, c): for each source of part (s, left) the factor with sum(min(1, c m) size) = left.

    Works on the words of each source and size class, some tens of rows a source. With the
    classes above one at p = 1, the words that are left over give c; the highest class
    whose own p is then at most 1 is the right one.
    """
    cells = rows.where("size > 0").groupBy("source", _class(F.col("size")).alias("k")).agg(F.sum("size").alias("words"))
    cells = cells.join(F.broadcast(part), F.col("source").eqNullSafe(F.col("s"))).withColumn("m", F.pow(F.lit(2.0), F.col("k") / 2))  # a row a source
    down = Window.partitionBy("s").orderBy(F.desc("k"))
    above = F.sum("words").over(down) - F.col("words")
    below = F.sum(F.col("words") * F.col("m")).over(Window.partitionBy("s").orderBy("k"))
    cells = cells.select("s", "k", "m", ((F.col("left") - above) / below).alias("c"))
    return cells.where("c * m <= 1 + 1e-9").groupBy("s").agg(F.max_by("c", "k").alias("c"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("source"), word_count("text").alias("size"), _draw(seed).alias("u"), F.hash("text").alias("t"))


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 0, max_repeat: float = MAX_REPEAT) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): rows (doc_id, source, size, u, t) and, for each source, target, whole
    copies, and the last key of the sampled part (line; null: none)."""
    rows = materialize(_sized(docs, seed))
    targets = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat))
    part = targets.select("source", "target", "ratio", F.floor(F.col("ratio")).alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p"), (F.col("target") - F.floor("ratio") * F.col("source_size")).alias("left"))
    part = part.where("p > 1e-12 and left > 0").select(F.col("source").alias("s"), "left")
    scales = materialize(_scale(rows, part).withColumnRenamed("s", "ss"), 1)
    part = part.join(scales, F.col("s").eqNullSafe(F.col("ss"))).drop("ss")
    ranked = rows.where("size > 0").join(part, F.col("source").eqNullSafe(F.col("s")))
    ranked = ranked.withColumn("q", _pareto(F.col("u"), _inclusion(F.col("size"), F.col("c"))))
    #: q / (1 + q) is spread over (0, 1) and keeps the order
    ranked = ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    bins = ranked.groupBy("s", "bin", "left").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = bins.where("before < left and before + words >= left").select(F.col("s").alias("es"), F.col("bin").alias("eb"), "before")
    inside = ranked.join(edge, F.col("s").eqNullSafe(F.col("es")) & (F.col("bin") == F.col("eb")))
    key = F.struct("q", "doc_id", "size", "t")
    order = Window.partitionBy("s").orderBy("q", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(order))
    taken = inside.where(F.col("upto") - F.col("size") / 2 <= F.col("left"))
    lines = taken.groupBy("s").agg(F.max(key).alias("line"))
    full = bins.groupBy("s").agg(F.max(F.when(F.col("before") + F.col("words") < F.col("left"), F.col("bin"))).alias("full_bin"))
    plan = targets.join(full, F.col("source").eqNullSafe(full["s"]), "left").drop("s").join(lines, F.col("source").eqNullSafe(lines["s"]), "left").drop("s")
    plan = plan.join(scales, F.col("source").eqNullSafe(F.col("ss")), "left").drop("ss")
    return rows, materialize(plan)


def _copies(whole: Column, c: Column, u: Column) -> Column:
    q = _pareto(u, _inclusion(F.col("size"), c))
    key = F.struct(q.alias("q"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"), F.col("t").alias("t"))
    bin_ = F.floor(q / (1 + q) * BINS).cast("int")
    extra = c.isNotNull() & (F.col("size") > 0) & ((bin_ <= F.coalesce(F.col("full_bin"), F.lit(-1))) | F.coalesce(key <= F.col("line"), F.lit(False)))
    return (whole + F.when(extra, 1).otherwise(0)).cast("long")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("source", "p_source")
    j = rows.join(p, F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    return j.withColumn("copies", _copies(F.floor("ratio"), F.col("c"), F.col("u")))


def mix_report(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken, copies."""
    rows, plan = mixing_plan(docs, weights, seed)
    return _with_copies(rows, plan).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """The mixed corpus: every document as many times as the mix takes it."""
    _, plan = mixing_plan(docs, weights, seed)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), "doc_id", "source", word_count("text").alias("size"), _draw(seed).alias("u"), F.hash("text").alias("t"))
    return _with_copies(rows, plan).select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).select("doc.*")
