"""Approximate nearest neighbours on robust-pruned directed graphs, one graph per shard.

Equal vectors are one node that stands for all its ids. Nodes are dealt by hash into
shards of about SHARD_NODES; in a task each shard gets a graph (greedy searches from the
medoid propose neighbours for a batch of nodes, pruning keeps a neighbour unless a kept
one is nearer to it by the factor ALPHA, reverse edges are added and pruned again), and a
beam search of every query runs over it. Shard results are merged by exact cosines.

Queries are a stated set, sent to each shard in blocks. Recall against brute force is
measured in the tests (at least 0.9; the beam is a parameter).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, as queries or candidates; vectors of another length are never
neighbours; of equal scores the smaller id is nearer; null ids take no part; a query has
fewer than k rows only if there are fewer candidates; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD_NODES = 2048
QUERY_BLOCK = 8192
ALPHA, DEGREE, BUILD_BEAM, BEAM = 1.2, 20, 32, 48


def greedy(unit: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: (ids, cosines) by falling cosine, -1 where none."""
    n, q = len(unit), len(queries)
    ids = np.full((q, beam), -1, dtype=np.int64)
    sims = np.full((q, beam), -np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, queries @ unit[start], False
    seen[:, start] = True
    live = np.arange(q)
    while len(live):
        at = np.argmin(done[live], 1)
        more = ~done[live, at]
        live, at = live[more], at[more]
        if not len(live):
            break
        done[live, at] = True
        near = graph[ids[live, at]]
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        s = np.full(near.shape, -np.inf, dtype=np.float32)
        s[r, c] = np.einsum("ij,ij->i", unit[near[r, c]], queries[live[r]])
        all_s = np.concatenate([sims[live], s], 1)
        order = np.argsort(-all_s, 1, kind="stable")[:, :beam]
        sims[live] = np.take_along_axis(all_s, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
        fresh = np.concatenate([done[live], ~new], 1)
        done[live] = np.take_along_axis(fresh, order, 1)
    return ids, sims


def prune(unit: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each node's candidates (rows of pool, -1 for none)."""
    pool = np.where(pool == nodes[:, None], -1, pool)
    pool = np.sort(pool, 1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    own = np.einsum("ijk,ik->ij", unit[np.maximum(pool, 0)], unit[nodes])
    own[pool < 0] = -np.inf
    order = np.argsort(-own, 1, kind="stable")
    pool, own = np.take_along_axis(pool, order, 1), np.take_along_axis(own, order, 1)
    alive = pool >= 0
    out = np.full((len(nodes), degree), -1, dtype=np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        first = np.argmax(alive, 1)
        has = alive[rows, first]
        if not has.any():
            break
        pick = np.where(has, pool[rows, first], -1)
        out[:, k] = pick
        alive[rows, first] = False
        #: squared distances of unit vectors are 2 - 2 cos
        among = np.einsum("ijk,ik->ij", unit[np.maximum(pool, 0)], unit[np.maximum(pick, 0)])
        alive &= ~((alpha * (1 - among) <= (1 - own)) & has[:, None])
    return out


def build(unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 0) -> tuple[np.ndarray, int]:
    """(graph, entry): out-neighbours of every node, -1 for none; the medoid."""
    n = len(unit)
    rng = np.random.default_rng(seed)
    degree = min(degree, max(1, n - 1))
    graph = np.full((n, degree), -1, dtype=np.int64)
    start = int(np.argmax(unit @ unit.mean(0)))
    if n > 1:
        graph[:] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, degree))) % n
    order = rng.permutation(n)
    for first in range(0, n, batch):
        nodes = order[first : first + batch]
        found, _ = greedy(unit, graph, start, unit[nodes], beam)
        graph[nodes] = prune(unit, nodes, np.concatenate([found, graph[nodes]], 1), degree, alpha)
        src = np.repeat(nodes, degree)
        dst = graph[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        targets, at, count = np.unique(dst, return_index=True, return_counts=True)
        back = np.full((len(targets), count.max() if len(count) else 0), -1, dtype=np.int64)
        back[np.repeat(np.arange(len(targets)), count), np.arange(len(dst)) - np.repeat(at, count)] = src
        graph[targets] = prune(unit, targets, np.concatenate([graph[targets], back], 1), degree, alpha)
    return graph, start


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & (x == x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())


def _least_ids(df: DataFrame, key: str, n: int, salts: int = 64) -> DataFrame:
    """The n least ids of each key; hot keys are cut down salt by salt first."""
    salted = Window.partitionBy(key, "salt").orderBy("vec_id")
    whole = Window.partitionBy(key).orderBy("vec_id")
    d = df.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= n)
    return d.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= n).drop("salt", "r")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def search(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: k nearest by cosine of each row for which queries holds."""
    clean = _clean(df, id_col, vec_col).distinct()
    wanted = materialize(_clean(df.where(F.coalesce(queries, F.lit(False))), id_col, vec_col).distinct().withColumnRenamed("vec_id", "query_id"))
    clean = clean.withColumn("key", F.concat_ws("", *[F.hex(F.xxhash64(F.lit(s), "v")) for s in (1, 2)]))
    ids = materialize(_least_ids(clean.select("key", "vec_id"), "key", k + 1))
    firsts = ids.groupBy("key").agg(F.min("vec_id").alias("vec_id"))
    nodes = materialize(clean.join(firsts, ["key", "vec_id"]).select("key", "v").withColumn("dim", F.size("v")))
    total = nodes.count()
    shards = max(1, -(-total // SHARD_NODES))
    nodes_s = nodes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    want = k + 1

    def graph(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", ignore_index=True)
        near, start = build(_unit(group["v"]))
        return pd.DataFrame({"shard": group["shard"], "dim": group["dim"], "key": group["key"], "v": group["v"], "place": np.arange(len(group)), "near": list(near), "start": start})

    graphs = materialize(nodes_s.groupBy("shard", "dim").applyInPandas(graph, "shard int, dim int, key string, v array<double>, place int, near array<int>, start int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    every = wanted.select("query_id", F.col("v").alias("qv"), F.size("v").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "key": pd.Series(dtype="object")})
        left = left.sort_values("place", ignore_index=True)
        found, _ = greedy(_unit(left["v"]), np.stack(left["near"].to_numpy()), int(left["start"].iloc[0]), _unit(right["qv"]), max(beam, want))
        found = found[:, :want]
        r, c = np.nonzero(found >= 0)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[r], "key": left["key"].to_numpy()[found[r, c]]})

    keys = ("shard", "dim", "block")
    hits = graphs.select("*", each).groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(run, "query_id long, key string")
    q = wanted.select("query_id", F.col("v").alias("qv"))
    exact = hits.join(nodes.select("key", "v"), "key").join(q, "query_id").select("query_id", "key", cosine(F.col("qv"), F.col("v")).alias("score"))
    #: nodes of a query first, so that a node with many ids is expanded for few queries
    exact = exact.withColumn("dr", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("dr") <= want)
    rows = exact.join(ids, "key").where("vec_id <> query_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
