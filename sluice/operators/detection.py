"""Detector output as rows: tile plans, activations, top scores, page coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.geometry import above_threshold, merge_text_boxes, suppress

#: a tile whose brightness varies less is blank and is not looked at
BLANK_DEVIATION = 1.0


def tile_starts(size: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles along one side; the last is moved back to end at the border."""
    step = tile - overlap
    last = F.greatest(size - tile, F.lit(0))
    regular = F.sequence(F.lit(0), last, F.lit(step))
    return F.array_distinct(F.concat(regular, F.array(last)))


def plan_tiles(pages: DataFrame, page: str, width: str, height: str, tile: int, overlap: int) -> DataFrame:
    """(page, x, y, w, h) of every tile of every page."""
    xs = pages.select(page, width, height, F.explode(tile_starts(F.col(width), tile, overlap)).alias("x"))
    both = xs.select(page, width, height, "x", F.explode(tile_starts(F.col(height), tile, overlap)).alias("y"))
    return both.select(page, "x", "y", F.least(F.lit(tile), width).alias("w"), F.least(F.lit(tile), height).alias("h"))


def _with(value: Column, f) -> Column:
    """f(value), value being computed once."""
    return F.transform(F.array(value), f)[0]


def softmax(scores: Column) -> Column:
    """Probabilities of an array of logits, shifted by their maximum."""
    grown = _with(F.array_max(scores).cast("double"), lambda top: F.transform(scores, lambda v: F.exp(v.cast("double") - top)))
    both = _with(grown, lambda g: F.struct(g.alias("g"), F.aggregate(g, F.lit(0.0), lambda a, b: a + b).alias("t")))
    return _with(both, lambda x: F.transform(x["g"], lambda v: v / x["t"]))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v.cast("double")))


def top_scores(df: DataFrame, key: str, scores: Column, k: int) -> DataFrame:
    """(key, rank, index, score): the k largest of each array, ties by index.

    Sorted inside each row's array, so no row leaves its partition.
    """
    pairs = F.transform(scores, lambda v, i: F.struct((-v.cast("double")).alias("s"), i.alias("i")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return df.select(key, F.posexplode(best).alias("rank", "b")).select(key, (F.col("rank") + 1).alias("rank"), F.col("b.i").alias("index"), (-F.col("b.s")).alias("score"))


def to_page(x: Column, offset: Column, scale: Column, limit: Column) -> Column:
    """A tile coordinate on its page, clamped to the page."""
    return F.greatest(F.lit(0.0), F.least(limit.cast("double"), (x + offset) / scale))


def capped(df: DataFrame, page: str, score: str, tie: str, n: int) -> DataFrame:
    w = Window.partitionBy(page).orderBy(F.col(score).desc(), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def luma(r: Column, g: Column, b: Column) -> Column:
    """Brightness of a colour, 0 to 255."""
    # fixed values: weights of the colours, in 65536ths
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 0x8000, 16)


def blank_tiles(pixels: DataFrame, keys: list[str], r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """(keys, deviation, blank) of tiles from their pixels."""
    spread = F.stddev_pop(luma(F.col(r), F.col(g), F.col(b)))
    return pixels.groupBy(*keys).agg(spread.alias("deviation")).withColumn("blank", F.col("deviation") < BLANK_DEVIATION)


# fixed values: boxes thinner than this share of their tile are none; a box this large on both sides covers it
THIN, NEAR_FULL = 1e-3, 0.9


def box_verdicts(pages: DataFrame, boxes: DataFrame, floor: float) -> DataFrame:
    """Boxes with tiles and verdict: low, thin, full (a text as large as its tile, where a page has several) or kept."""
    across, down = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    full = (across >= NEAR_FULL) & (down >= NEAR_FULL)
    b = boxes.join(pages.where("width > 0 and height > 0").select("page", "width", "height", "tiles"), "page")
    verdict = F.when(F.col("score") < floor, "low").when((across < THIN) | (down < THIN), "thin").when(full & (F.col("kind") == "text") & (F.col("tiles") > 1), "full").otherwise("kept")
    return b.withColumns({"near_full": full & ~verdict.isin("low", "thin"), "verdict": verdict})


def detection_stats(pages: DataFrame, boxes: DataFrame, floor: float) -> DataFrame:
    """(page, kind, raw, full_tiles, rejected_full, rejected_thin): what became of a page's boxes before suppression."""
    b = box_verdicts(pages, boxes, floor)
    n = lambda v: F.count_if(F.col("verdict") == v)
    tiles = F.count_distinct(F.when(F.col("near_full"), F.struct("tx", "ty")))
    return b.groupBy("page", "kind").agg(n("kept").alias("raw"), tiles.alias("full_tiles"), n("full").alias("rejected_full"), n("thin").alias("rejected_thin"))


def detect_pages(pages: DataFrame, boxes: DataFrame, thresholds: dict[str, float], default: float, nms: float = 0.5, merge: bool = True, most: int = 300) -> DataFrame:
    """(page, kind, x0, y0, x1, y1, score): boxes of tiles as shares of their page.

    pages: (page, width, height, tiles); boxes: (page, id, kind, tx, ty, tw, th, x0, y0, x1, y1, score), corners as
    shares of the tile of size (tw, th) that starts at (tx, ty). Boxes below every threshold, thin ones and
    texts as large as their tile fall first. Then, on the page: suppression by kind, parts of a text merged,
    the threshold of each kind, the best of a page. Pages without extent give none.
    """
    b = box_verdicts(pages, boxes, min([default, *thresholds.values()])).where("verdict = 'kept'")
    at = lambda c, size, off, limit: to_page(F.col(c) * F.col(size), F.col(off), F.lit(1.0), F.col(limit)).alias(c)
    px = b.select("page", "kind", "id", at("x0", "tw", "tx", "width"), at("y0", "th", "ty", "height"), at("x1", "tw", "tx", "width"), at("y1", "th", "ty", "height"), "score")
    kept = suppress(px, "page", "kind", nms)
    kept = merge_text_boxes(kept, "page", "kind") if merge else kept.select("page", "kind", "x0", "y0", "x1", "y1", "score")
    kept = above_threshold(kept, "kind", "score", thresholds, default)
    order = Window.partitionBy("page").orderBy(F.desc("score"), "kind", "x0", "y0", "x1", "y1")
    best = kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r").join(pages.select("page", "width", "height"), "page")
    share = lambda c, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col(size))).alias(c)
    return best.select("page", "kind", share("x0", "width"), share("y0", "height"), share("x1", "width"), share("y1", "height"), "score")
