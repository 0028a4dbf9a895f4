"""Catalogue imports, retention and overrides: verdicts as columns over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def import_verdicts(rows: DataFrame, catalog: DataFrame, key: str, order: str, checks: dict[str, Column]) -> DataFrame:
    """Rows with verdict create, duplicate or error, and reasons.

    checks: name -> column that is true for a defect. A sound row whose key stands earlier
    in the file, or else in the catalogue, is a duplicate. The catalogue is joined by key.
    """
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))
    rows = rows.withColumn("reasons", reasons).withColumn("sound", F.size("reasons") == 0)
    first = rows.where("sound").groupBy(key).agg(F.min(order).alias("_first"))
    known = catalog.select(F.col(key)).distinct().withColumn("_known", F.lit(True))
    j = rows.join(first, key, "left").join(known, key, "left")
    verdict = F.when(~F.col("sound"), "error").when(F.col(order) > F.col("_first"), "duplicate_in_file").when(F.col("_known"), "duplicate_in_catalog").otherwise("create")
    return j.withColumn("verdict", verdict).drop("_first", "_known", "sound")


def retention(status: Column, decided: Column, holds: Column, days: int, now: Column, hold_counts: bool = True) -> Column:
    """STRUCT(due, deletable, blocks, hold_overridden) of a revision: its status must be a decision and
    dated (decided: text or date), the days must have passed, and no hold may stand where holds count."""
    held = F.coalesce(holds > 0, F.lit(False))
    # fixed values: the statuses that are decisions
    final = status.isin("returned", "approved", "superseded") & decided.isNotNull()
    day = decided.try_cast("timestamp")
    due = F.when(F.coalesce(final, F.lit(False)), day + F.make_interval(days=F.lit(days)))
    pending = ~F.coalesce(final, F.lit(False))
    blocks = F.array_compact(F.array(
        F.when(held & F.lit(hold_counts), "legal_hold"), F.when(pending, "decision_pending"), F.when(~pending & day.isNull(), "invalid_decision_date"), F.when(due > now, "retention_not_expired"),
    ))
    return F.struct(due.alias("due"), (F.size(blocks) == 0).alias("deletable"), blocks.alias("blocks"), (held & F.lit(not hold_counts)).alias("hold_overridden"))


def merged(base: Column, patch: Column) -> Column:
    """Shallow merge of two maps: the patch's values win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k)), patch)


def effective_settings(base: DataFrame, overrides: Sequence[DataFrame], key: str, lists: Sequence[str], maps: Sequence[str], disabled: str, codes: str) -> DataFrame:
    """Settings after overrides in order: given lists replace, maps merge (the later wins),
    disabled codes are taken away from the codes that remain."""
    out = base
    for i, o in enumerate(overrides):
        named = o.select(key, *[F.col(c).alias(f"_{c}") for c in (*lists, *maps, disabled)])
        out = out.join(named, key, "left")
        for c in lists:
            out = out.withColumn(c, F.coalesce(f"_{c}", c))
        for c in maps:
            out = out.withColumn(c, F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(merged(F.col(c), F.col(f"_{c}"))))
        gone = F.coalesce(f"_{disabled}", F.array().cast("array<string>"))
        out = out.withColumn(codes, F.array_except(codes, gone)).drop(*[f"_{c}" for c in (*lists, *maps, disabled)])
    return out


def canonical_hash(df: DataFrame, key: str, parts: Sequence[str], version: str = "v1") -> DataFrame:
    """(key, digest): sha-256 of a group's rows in sorted order, whatever order they came in."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    return df.groupBy(key).agg(F.sha2(F.concat_ws("\n", F.lit(version), F.array_join(F.array_sort(F.collect_list(row)), "\n")), 256).alias("digest"))


def contiguous(df: DataFrame, key: str, position: str) -> DataFrame:
    """(key, first, last, n, whole): whether positions run without a gap."""
    g = df.groupBy(key).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))
    return g.withColumn("whole", F.col("last") - F.col("first") + 1 == F.col("n"))


def histogram(df: DataFrame, key: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """(key, le, n): cumulative counts up to every bound, as a metrics endpoint gives them."""
    counts = df.groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return counts.select(key, F.explode(pairs).alias("p")).select(key, "p.le", "p.n")


def linked_children(df: DataFrame, section: str, order: str, is_parent: Column, node: str, kind: Column) -> DataFrame:
    """(parent_id, node, link): each row after a parent hangs on it, by its kind."""
    w = Window.partitionBy(section).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = df.withColumn("parent_id", F.last(F.when(is_parent, F.col(node)), ignorenulls=True).over(w))
    return carried.where(F.col("parent_id").isNotNull() & ~is_parent).select("parent_id", node, kind.alias("link"))
