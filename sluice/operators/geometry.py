"""Boxes STRUCT<x0, y0, x1, y1>: expressions, non-maximum suppression, union area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import once


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def suppress(df: DataFrame, page: str, kind: str, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression per page and class: columns x0, y0, x1, y1, score; ties by row id.

    The boxes of a page and class are folded in order of their scores; a box stays unless one
    that stayed overlaps it. A page holds a bounded number of boxes.
    """
    row = F.struct((-F.col("score")).alias("by"), F.col("id"), F.struct(*df.columns).alias("r"))
    boxes = F.array_sort(F.collect_list(row))
    grouped = df.groupBy(page, kind).agg(boxes.alias("b"))
    alone = F.size("b") == 1
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: iou(k["r"], x["r"]) >= threshold), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select(F.explode(F.when(alone, F.col("b")).otherwise(kept)).alias("k")).select("k.r.*")


def covered(boxes: Column) -> Column:
    """Area covered by an array of boxes: between neighbouring edges, how much of the height they cover in order of their tops."""
    whole = F.filter(boxes, lambda r: r["x0"].isNotNull() & r["y0"].isNotNull() & r["x1"].isNotNull() & r["y1"].isNotNull())
    by_top = F.array_sort(F.transform(whole, lambda r: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"), r["x0"].alias("x0"), r["x1"].alias("x1"))))
    edges = lambda b: F.array_sort(F.array_distinct(F.concat(F.transform(b, lambda r: r["x0"]), F.transform(b, lambda r: r["x1"]))))
    more = lambda acc, r: F.struct((acc["sum"] + F.greatest(F.lit(0.0), r["y1"] - F.greatest(acc["end"], r["y0"]))).alias("sum"), F.greatest(acc["end"], r["y1"]).alias("end"))
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end"))
    height = lambda b, x, xb: F.aggregate(F.filter(b, lambda r: (r["x0"] <= x) & (r["x1"] >= xb)), none, more, lambda acc: acc["sum"])
    strips = lambda b, xs: F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), lambda x, xb: (xb - x) * height(b, x, xb))
    return once(by_top, lambda b: once(edges(b), lambda xs: F.aggregate(strips(b, xs), F.lit(0.0), lambda acc, v: acc + v)))


def union_area(df: DataFrame, page: str) -> DataFrame:
    """(page, covered): area covered by a page's boxes, a bounded number; pages without any area are left out."""
    boxes = df.where(F.col(page).isNotNull()).groupBy(page).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("b"))
    return boxes.select(page, covered(F.col("b")).alias("covered")).where("covered > 0")


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - w / 2).alias("x0"), (cy - h / 2).alias("y0"), (cx + w / 2).alias("x1"), (cy + h / 2).alias("y1"))


def clamped(b: Column, width: Column, height: Column) -> Column:
    side = lambda v, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), v))
    return F.struct(side(b["x0"], width).alias("x0"), side(b["y0"], height).alias("y0"), side(b["x1"], width).alias("x1"), side(b["y1"], height).alias("y1"))


def belong(a: Column, b: Column, gap: float = 0.6, share: float = 0.5) -> Column:
    """Whether two text boxes are parts of one: side by side on a line, or stacked."""
    width, height = lambda r: r["x1"] - r["x0"], lambda r: r["y1"] - r["y0"]
    h, w = F.least(height(a), height(b)), F.least(width(a), width(b))
    across, down = (F.least(a[k + "1"], b[k + "1"]) - F.greatest(a[k + "0"], b[k + "0"]) for k in "xy")
    near = lambda shared: F.greatest(F.lit(0.0), -shared) <= gap * h
    return (h > 0) & (w > 0) & (((down >= share * h) & near(across)) | ((across >= share * w) & near(down)))


def merge_text_boxes(df: DataFrame, page: str, kind: str, gap: float = 0.6, share: float = 0.5) -> DataFrame:
    """(page, kind, x0, y0, x1, y1, score): text boxes that belong together, over any chain, become
    their hull with the largest score; others stay. A page's boxes, a bounded number, are folded
    into groups: a box joins all groups that it belongs to and makes them one."""
    box = F.struct("x0", "y0", "x1", "y1", "score")
    groups = df.where(F.col(kind) == "text").groupBy(page).agg(F.collect_list(box).alias("b"))
    none = F.slice(F.array(F.col("b")), 1, 0)

    def joined(acc: Column, x: Column) -> Column:
        touches = lambda g: F.exists(g, lambda y: belong(y, x, gap, share))
        apart = F.filter(acc, lambda g: ~touches(g))
        return F.concat(apart, F.array(F.concat(F.flatten(F.filter(acc, touches)), F.array(x))))

    merged = groups.select(page, F.explode(F.aggregate("b", none, joined)).alias("g"))
    least, most = lambda n: F.array_min(F.transform("g", lambda r: r[n])), lambda n: F.array_max(F.transform("g", lambda r: r[n]))
    hull = merged.select(page, F.lit("text").alias(kind), least("x0").alias("x0"), least("y0").alias("y0"), most("x1").alias("x1"), most("y1").alias("y1"), most("score").alias("score"))
    return hull.unionByName(df.where(F.col(kind) != "text").select(*hull.columns))


def above_threshold(df: DataFrame, kind: str, score: str, thresholds: dict[str, float], default: float) -> DataFrame:
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col(kind)), F.lit(default)) if thresholds else F.lit(default)
    return df.where(F.col(score) >= least)


def page_flags(pages: DataFrame, blocks: DataFrame, part: str, page: str, t: dict[str, float]) -> DataFrame:
    """(part, page, flags, coverage, n_blocks) of every page: signs that its layout needs a look.

    blocks: part, page, kind, x0, y0, x1, y1 in shares of the page; a page holds a bounded number
    of them. t: side (degenerate), tiny (area), overlap (IoU), blank and low (coverage),
    neighbours (least mean), change (relative); stamp: whether pages with images have one.
    """
    keys = [part, page]
    of_blocks = blocks.where(F.col(part).isNotNull() & F.col(page).isNotNull()).select(*keys, F.struct("kind", "x0", "y0", "x1", "y1").alias("r"))
    of_pages = pages.select(*keys, F.lit(None).cast(of_blocks.schema["r"].dataType).alias("r"))
    #: a page's row and its blocks' meet where the part's pages are put in order: one shuffle
    both = of_pages.withColumn("given", F.lit(1)).unionByName(of_blocks.withColumn("given", F.lit(0))).repartition(part)
    p = both.groupBy(*keys).agg(F.collect_list("r").alias("b"), F.sum("given").cast("int").alias("given")).where("given > 0")
    p = p.select(*keys, "b", F.explode(F.sequence(F.lit(1), "given"))).select(*keys, "b", F.sort_array(F.array_compact(F.array_distinct(F.transform("b", lambda r: r["kind"])))).alias("kinds"), F.least(covered(F.col("b")), F.lit(1.0)).alias("coverage"), F.size("b").alias("n"))
    w = Window.partitionBy(part).orderBy(page)
    for name, f in (("before", F.lag), ("after", F.lead)):
        p = p.withColumns({f"n_{name}": f("n").over(w), f"kinds_{name}": f("kinds").over(w)})
    beside = F.array_compact(F.array("n_before", "n_after"))
    expected = F.aggregate(beside, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(beside), F.lit(0))
    narrow = lambda r: (r["x1"] - r["x0"] <= t["side"]) | (r["y1"] - r["y0"] <= t["side"])
    outside = lambda r: (r["x0"] < 0) | (r["y0"] < 0) | (r["x1"] > 1) | (r["y1"] > 1) | (r["x0"] > r["x1"]) | (r["y0"] > r["y1"])
    overlap = F.exists(F.transform("b", lambda x, i: F.exists(F.filter("b", lambda y, j: j > i), lambda y: (x["kind"] == y["kind"]) & (intersection(x, y) > 0) & (iou(x, y) >= t["overlap"]))), lambda v: v)
    other = lambda n: F.col(f"kinds_{n}").isNull() | (F.col(f"kinds_{n}") != F.col("kinds"))
    full = F.col("n") > 0
    flags = {
        "no_blocks": ~full, "blank_page_candidate": ~full | (F.col("coverage") < t["blank"]), "low_coverage": full & (F.col("coverage") < F.greatest(F.lit(t["low"]), F.lit(t["blank"]))),
        "bbox_out_of_page": F.exists("b", outside), "degenerate_geometry": F.exists("b", narrow), "tiny_block": F.exists("b", lambda r: ~narrow(r) & (r["kind"] != "stamp") & (area(r) < t["tiny"])),
        "suspicious_overlap": overlap, "missing_expected_stamp": F.lit(bool(t.get("stamp"))) & F.array_contains("kinds", "image") & ~F.array_contains("kinds", "stamp"),
        "neighbor_mismatch": full & (expected >= t["neighbours"]) & (F.abs(F.col("n") - expected) / expected >= t["change"]) & other("before") & other("after"),
    }
    named = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items()])))
    return p.select(*keys, named.alias("flags"), "coverage", F.col("n").alias("n_blocks"))
