"""Centroid clustering: plain Lloyd in whole numbers.

Vectors become integers floor(scale * x). Every round the centroids travel to the tasks
(k rows, a parameter), mapInPandas takes integer squared differences to one centroid after
the other and the least of them (ties: the lower number), and each task hands on one row a
centroid with its count and component sums. Spark adds these up by centroid; the driver
reads k rows a round and divides them exactly. No vector leaves its task before the last
assignment is written.

Numbers stay exact at any size: vectors whose components stay below 2**26 are handled as
64-bit integers, larger ones as Python integers; sums travel in limbs of 30 bits, one limb
row (number 0) for all that fits a long.

Defined results: vectors that are null, of another length or hold a null or non-finite
component take no part and have no row. Repeated rows and vec_ids are vectors of their own;
those with equal vec_id start in order of their components. A null vec_id is assigned but
starts no centroid. Fewer vectors than k: as many centroids as there are. No vectors: no
rows. A centroid without vectors stays where it is. Distances and their sums beyond a long
are the largest long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: components below this keep 64 squared differences within a long
SAFE, LIMB, MOST = 1 << 26, 30, (1 << 63) - 1


def usable(vector: Column, size: int) -> Column:
    """Vectors of the given length with finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for each component: int64 where safe, else Python integers."""
    scaled = vectors * float(scale)
    if not scaled.size or np.abs(scaled).max() < SAFE:
        return np.floor(scaled).astype(np.int64)
    exact = lambda x: math.floor(scale * x) if abs(x) < 2.0**53 else int(x) * scale
    return np.array([[exact(x) for x in row] for row in vectors.tolist()], dtype=object)


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the lowest) and the squared distance to it."""
    small = rows.dtype != object and all(abs(c) < SAFE for centroid in centroids for c in centroid)
    kind = np.int64 if small else object
    rows = rows.astype(kind)
    squared = np.empty((len(centroids), len(rows)), dtype=kind)
    for k, centroid in enumerate(centroids):
        apart = rows - np.array(centroid, dtype=kind)
        squared[k] = np.einsum("ij,ij->i", apart, apart) if small else (apart * apart).sum(axis=1)
    took = np.argmin(squared, axis=0)
    return took, squared[took, np.arange(len(rows))]


def limbs(values: list[int]) -> dict[int, list[int]]:
    """Signed integers as rows of limbs; those that fit a long are limb 0 alone."""
    if all(abs(v) <= MOST for v in values):
        return {0: values}
    out: dict[int, list[int]] = {}
    for j, v in enumerate(values):
        rest, at = abs(v), 0
        while rest:
            out.setdefault(at, [0] * len(values))[j] = (rest & ((1 << LIMB) - 1)) * (1 if v > 0 else -1)
            rest >>= LIMB
            at += 1
    return out or {0: values}


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"].to_numpy()).astype(np.float64)


def _sums(kept: DataFrame, centroids: list[list[int]], size: int, scale: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Count and component sums of every centroid's vectors: k rows (times limbs) on the driver."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = [0] * len(shared.value), [[0] * size for _ in shared.value]
        for frame in frames:
            if len(frame):
                rows = whole(_vectors(frame), scale)
                took, _ = nearest(rows, shared.value)
                for k in np.unique(took):
                    mine = rows[took == k]
                    count[k] += len(mine)
                    total[k] = [a + int(b) for a, b in zip(total[k], mine.sum(axis=0), strict=True)]
        out = [(k, at, count[k] if at == 0 else 0, part) for k in range(len(count)) if count[k] for at, part in limbs(total[k]).items()]
        yield pd.DataFrame(out, columns=["cluster", "limb", "n", "s"])

    added = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(size)]
    merged = kept.select("v").mapInPandas(partial, "cluster int, limb int, n long, s array<long>").groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *added).collect()
    shared.destroy()
    count: dict[int, int] = {}
    total: dict[int, list[int]] = {}
    for r in merged:
        count[r.cluster] = count.get(r.cluster, 0) + r.n
        total[r.cluster] = [a + (int(r[f"s{j}"]) << (LIMB * r.limb)) for j, a in enumerate(total.get(r.cluster, [0] * size))]
    return count, total


def start(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors of least sha256(`seed:vec_id`), in hash order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [[int(x) for x in whole(np.array([r.v], dtype=np.float64), scale)[0]] for r in first]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of (vec_id, embedding) after the rounds, and the final centroids."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v"), size))
    centroids = start(kept, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        count, total = _sums(kept, centroids, size, scale)
        centroids = [[s // count[c] for s in total[c]] if c in count else old for c, old in enumerate(centroids)]
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame) and shared.value:
                took, squared = nearest(whole(_vectors(frame), scale), shared.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": took.astype(np.int32), "distance": [min(int(d), MOST) for d in squared]})

    return kept.mapInPandas(assign, "vec_id long, cluster int, distance long"), centroids


def cluster_report(vectors: DataFrame) -> DataFrame:
    """Every vector's cluster and squared distance, with the sums over its cluster and over all."""
    spark = vectors.sparkSession
    assigned, centroids = cluster(vectors)
    assigned = materialize(assigned)
    total = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a centroid
    every = sum(int(r.s) for r in total)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = [(r.cluster, min(int(r.s), MOST), min(every, MOST), digest[r.cluster]) for r in total]
    return assigned.join(F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
