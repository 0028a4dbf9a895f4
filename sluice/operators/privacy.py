"""Scan of texts for marked personal values that are known by their salted digests only."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import once

# fixed values: the runs in which values stand, and the lengths that values of a kind have
RUNS = {"id": (r"\d+", (10, 12, 13, 15)), "cert": (r"[0-9a-fA-F]+", (32, 33)), "surname": ("[Ѐ-ӿ]+", tuple(range(4, 17)))}
#: a kind with at most so many markers is sent to all tasks
FEW = 10_000


def windows(text: Column, pattern: str, lengths: tuple[int, ...]) -> Column:
    """All distinct pieces of the given lengths inside the runs of a pattern, in lower case."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r: F.length(r) >= lengths[0])
    low = F.transform(runs, lambda r: once(F.lower(r), lambda x: F.struct(x.alias("x"), F.length(x).alias("n"))))
    at = lambda r, i: F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= r["n"] - i + 1), lambda n: F.substring(r["x"], i, n))
    cut = lambda r: F.flatten(F.transform(F.sequence(F.lit(1), r["n"] - lengths[0] + 1), lambda i: at(r, i)))
    return F.array_distinct(F.flatten(F.transform(F.filter(low, lambda r: r["n"] >= lengths[0]), cut)))


def candidates(df: DataFrame, key: str, text: str, kinds: Collection[str] = tuple(RUNS)) -> DataFrame:
    """(key, kind, value): what could be a marked value of the kinds, once a text."""
    each = [F.struct(F.lit(kind).alias("kind"), windows(F.col(text), p, lengths).alias("values")) for kind, (p, lengths) in RUNS.items() if kind in kinds]
    each = F.array(*each) if each else F.array().cast("array<struct<kind:string,values:array<string>>>")
    return df.where(F.col(text).isNotNull()).select(key, F.inline(each)).select(key, "kind", F.explode("values").alias("value"))


def slow_digest(values: DataFrame, salt: str, n: int = 2**15) -> DataFrame:
    """(value, digest) of distinct short values by a memory-hard function: digits alone are too few to hide behind a fast one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for f in frames:
            digest = [hashlib.scrypt(v.encode(), salt=salt.encode(), n=n, r=8, p=1, maxmem=192 << 20, dklen=32).hex() for v in f["value"]]
            yield f.assign(digest=digest)

    return values.select("value").distinct().mapInPandas(run, "value string, digest string")


def scan(df: DataFrame, key: str, text: str, markers: DataFrame, salt: str, slow: bool = True, names: tuple[str, ...] = ()) -> DataFrame:
    """(key, kind, value) of marked values in texts; markers is (kind, digest).

    Pieces are hashed with the salt and joined with the markers, so the values themselves are in
    no table. Digests of ids are slow ones unless slow is off. names are looked for as they stand.
    Markers are counted by kind: pieces of a kind that has none are not cut, and a kind with few
    is joined where its pieces are; only pieces of kinds with many markers are shuffled.
    """
    marked = markers.select("kind", "digest").distinct()
    n = {r["kind"]: r["count"] for r in marked.groupBy("kind").count().collect()}

    def hashed(kinds: Collection[str]) -> DataFrame:
        fast = lambda kinds: candidates(df, key, text, kinds).withColumn("digest", F.sha2(F.concat(F.lit(salt), F.col("value")), 256))
        if not slow or "id" not in kinds:
            return fast(kinds)
        ids = candidates(df, key, text, ("id",))
        ids = ids.join(slow_digest(ids, salt), "value").select(key, "kind", "value", "digest")
        others = [k for k in kinds if k != "id"]
        return fast(others).unionByName(ids) if others else ids

    few, many = [k for k in RUNS if 0 < n.get(k, 0) <= FEW], [k for k in RUNS if n.get(k, 0) > FEW]
    sides = [(few, F.broadcast(marked.where(F.col("kind").isin(few))))] * bool(few) + [(many, marked.where(F.col("kind").isin(many)))] * bool(many)
    found = [hashed(kinds).join(side, ["kind", "digest"], "left_semi").select(key, "kind", "value") for kinds, side in sides]
    hits = reduce(DataFrame.unionByName, found) if found else candidates(df, key, text, ())
    for name in names:
        hits = hits.unionByName(df.where(F.contains(F.col(text), F.lit(name))).select(key, F.lit("org").alias("kind"), F.lit(name).alias("value")))
    return hits
