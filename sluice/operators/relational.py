"""Scoped reads, keyset pages, dated resolution, windows and chains over DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.tables import written


def scope_predicate(kind: str, user_key: object = None, object_keys: Sequence | None = None, owner: str = "contractor_id", obj: str = "object_id") -> Column:
    """Row-level visibility: admin and manager see all, a contractor its own rows, others listed objects.

    A contractor without a key, or an empty list of objects, sees nothing.
    """
    if kind in ("admin", "manager"):
        return F.lit(True)
    if kind == "contractor":
        return F.lit(False) if user_key is None else F.coalesce(F.col(owner) == F.lit(user_key), F.lit(False))
    keys = list(object_keys or [])
    return F.coalesce(F.col(obj).isin(keys), F.lit(False)) if keys else F.lit(False)


def scoped(df: DataFrame, kind: str, **kw) -> DataFrame:
    return df.filter(scope_predicate(kind, **kw))


def where_given(df: DataFrame, **conditions: Column | None) -> DataFrame:
    """Conjunction of the conditions that are given; None asks for nothing."""
    given = [c for c in conditions.values() if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def tri_state(column: str, absent: bool | None) -> Column | None:
    return None if absent is None else F.col(column).isNull() if absent else F.col(column).isNotNull()


def contains_text(column: str, needle: str, prefix: bool = False) -> Column:
    """ILIKE with the needle's own %, _ and backslash taken literally."""
    safe = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"{'' if prefix else '%'}{safe}%")


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence | None, limit: int, descending: bool = True) -> DataFrame:
    """limit + 1 rows after a cursor; the extra row tells that there is a next page."""
    if after is not None:
        here, there = F.struct(*keys), F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)])
        df = df.filter(here < there if descending else here > there)
    order = [F.col(k).desc() if descending else F.col(k).asc_nulls_last() for k in keys]
    return df.orderBy(*order).limit(limit + 1)


def effective_on(df: DataFrame, day: Column, start: str = "effective_from", end: str = "effective_to", closed: bool = True) -> DataFrame:
    """Versions in force on a day: the end belongs to the period (closed) or not."""
    stop = F.col(end) >= day if closed else F.col(end) > day
    return df.filter((F.col(start) <= day) & (F.col(end).isNull() | stop))


def newest(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def renumber(df: DataFrame, partition: Sequence[str], order: Sequence[Column], into: str = "position") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def missing_positions(df: DataFrame, group: str, position: str) -> DataFrame:
    """Positions between the least and the greatest of a group that no row has."""
    span = df.groupBy(group).agg(F.min(position).alias("lo"), F.max(position).alias("hi"))
    every = span.select(group, F.explode(F.sequence("lo", "hi")).alias(position))
    return every.join(df.select(group, position).distinct(), [group, position], "left_anti")


def doubled_positions(df: DataFrame, group: str, position: str) -> DataFrame:
    return df.groupBy(group, position).agg(F.count("*").alias("n")).filter("n > 1")


def carried_forward(df: DataFrame, partition: Sequence[str], order: Sequence[Column], value: Column, into: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def neighbour_mean(df: DataFrame, partition: Sequence[str], order: str, value: str, into: str = "neighbour_mean") -> DataFrame:
    """Mean of the previous and the next row's value; a missing side is left out."""
    w = Window.partitionBy(*partition).orderBy(order)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return df.withColumn(into, F.when(n > 0, (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) / n))


def with_counts(parent: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """One count per child table, each aggregated before its join; absent is 0."""
    for name, child in children.items():
        parent = parent.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parent


def ancestor_chain(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) for every row, the node itself at depth 0.

    By doubling: a round joins all pairs below depth 2**k with the jumps of that length, so a
    chain of depth n takes log2(n) written rounds and no recursion limit. A cycle raises.
    """
    rows = df.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    jumps = written(rows.join(rows.select(F.col("node").alias("up")).distinct(), "up", "left_semi").select("node", "up"))
    pairs = written(rows.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    most, step = rows.count(), 1
    while jumps.limit(1).count():
        if step > most:
            raise ValueError("the parents form a cycle")
        further = jumps.join(pairs.withColumnRenamed("node", "up"), "up").select("node", "ancestor", (F.col("depth") + step).alias("depth"))
        pairs = written(pairs.unionByName(further))
        jumps = written(jumps.join(jumps.select(F.col("node").alias("up"), F.col("up").alias("over")), "up").select("node", F.col("over").alias("up")))
        step *= 2
    return pairs


def accumulate(target: DataFrame, delta: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), maxima: Sequence[str] = (), firsts: Sequence[str] = ()) -> DataFrame:
    """Upsert that adds counters, keeps maxima and the target's first non-null values."""
    both = target.withColumn("_o", F.lit(0)).unionByName(delta.withColumn("_o", F.lit(1)))
    aggs = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in firsts]
    return both.groupBy(*keys).agg(*aggs)


def insert_absent(target: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(delta.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti"))


def in_month(ts: str, month: Column) -> Column:
    """Half-open calendar month: from its first instant up to the next month's."""
    start = F.date_trunc("month", month)
    return (F.col(ts) >= start) & (F.col(ts) < F.add_months(start, 1))


def with_sets(parent: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """The sorted distinct values of each child's column, aggregated before its join; none is empty.

    Four left joins of unaggregated children would multiply their rows.
    """
    for name, (child, column) in children.items():
        got = child.groupBy(key).agg(F.sort_array(F.collect_set(column)).alias(name))
        kind = got.schema[name].dataType
        parent = parent.join(got, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return parent


def positional_match(left: DataFrame, right: DataFrame, page: str, edges: Sequence[str], order: str) -> DataFrame:
    """(page, left_id, right_id): blocks of equal rounded geometry, by rank among equals; a full
    join, so blocks without a partner stay. Both sides have page, id, the edges and order."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        place = F.concat_ws("|", *[F.format_string("%.6f", F.col(e)) for e in edges])
        w = Window.partitionBy(page, "place").orderBy(order)
        return df.withColumn("place", place).select(page, "place", F.row_number().over(w).alias("rank"), F.col("id").alias(name))

    return ranked(left, "left_id").join(ranked(right, "right_id"), [page, "place", "rank"], "full").select(page, "left_id", "right_id")


def differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, missing or unknown."""
    e, f = expected.select(key).distinct(), found.select(key).distinct()
    return e.join(f, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(f.join(e, key, "left_anti").withColumn("side", F.lit("unknown")))


def first_spelling(df: DataFrame, group: Sequence[str], value: str, order: str) -> DataFrame:
    """Of values equal after folding case and white space the first in order."""
    norm = F.upper(F.trim(F.regexp_replace(value, r"\s+", " ")))
    return df.withColumn("_k", norm).groupBy(*group, "_k").agg(F.min_by(value, order).alias(value), F.min(order).alias(order)).drop("_k")


def partition_faults(whole: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """(key, fault) where parts are no partition of the whole: lost, foreign or doubled."""
    placed = reduce(DataFrame.union, [p.select(key) for p in parts]).groupBy(key).agg(F.count("*").alias("n"))
    j = whole.select(key, F.lit(True).alias("own")).join(placed, key, "full")
    fault = F.when(F.col("own").isNull(), "foreign").when(F.col("n").isNull(), "lost").when(F.col("n") > 1, "doubled")
    return j.select(key, fault.alias("fault")).where("fault is not null")


def reference_counts(keys: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """(key, source, n): how many rows of each child still name a key, before a delete."""
    named = [c.groupBy(key).agg(F.count("*").alias("n")).withColumn("source", F.lit(name)) for name, c in children.items()]
    return keys.select(key).join(reduce(DataFrame.unionByName, named), key).select(key, "source", "n")


def named_either_way(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose names contain each other, either way. right is a directory, broadcast while
    it has at most 10,000 rows; blank names match nothing."""
    small = right.where(F.trim(b) != "")
    if small.limit(10_001).count() <= 10_000:
        small = F.broadcast(small)
    return left.where(F.trim(a) != "").join(small, F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a)))


def safe_number(c: Column) -> Column:
    """A number only where the whole text is one."""
    return F.when(c.rlike(r"^-?\d+(\.\d+)?$"), c.try_cast("double"))


def counted_upsert(target: DataFrame, delta: DataFrame, key: str, count: str, sample: str) -> DataFrame:
    """(key, count, sample, created): counters added; created tells that the target had no such key."""
    new = delta.groupBy(key).agg(F.count("*").alias("_n"), F.min(sample).alias("_s"))
    j = target.select(key, count, sample).join(new, key, "full")
    return j.select(key, (F.coalesce(count, F.lit(0)) + F.coalesce("_n", F.lit(0))).alias(count), F.coalesce(sample, "_s").alias(sample), F.col(count).isNull().alias("created"))
