"""Exact BM25 top-k: an inverted index with block-max pruning in every shard, merged exactly.

Words are ASCII-lowered, by their 64-bit hashes. Statistics are global: number of texts,
mean length, and document frequencies counted over all texts. A shard is what a task reads,
indexed a chunk at a time; queries come in blocks of bounded size, one job a block.

In a chunk texts are ordered by their most frequent word (languages apart) and stand in
blocks of BLOCK. Lists of the HEADS most frequent query terms carry a largest impact per
block; lists of rarer terms are summed first. A query skips a block when the sum of
its block maxima and the block's largest rare sum is below its k-th best score so far: no
text of it can enter. Other blocks are scored in full. Each task keeps k rows a query; the
k best of these, by global scores, are the exact answer.

score = sum over words of the query (repeats count) of log(1 + (N - df + 0.5) / (df + 0.5)) *
tf (K1 + 1) / (tf + K1 (1 - B + B length / mean)), rounded to 9 digits; ties go to the smaller
doc_id; only scores above 0 are returned.

Defined results: null and empty texts match nothing and, as queries, give no rows; null
ids take no part; of a query's texts the least counts; rows of one id and different texts are rows of their own; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, materialize

K1, B = 1.2, 0.75
HEADS, BLOCK = 256, 64
#: most (query, term) pairs that a block of queries sends to the tasks (one query may be larger)
QUERY_TERMS = 1_000_000
_MERGE_AT = 400_000


def pairs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, tf) of the distinct words of each text, by row."""
    order = np.lexsort((w.hash, w.row))
    h, r = w.hash[order], w.row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(h)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, df) merged within the task up to a bound; the row of h = null counts texts and words."""
    held, texts, words = [], 0, 0

    def merged():
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        u, inverse = np.unique(h, return_inverse=True)
        return u, np.bincount(inverse, c).astype(np.int64)

    def batch_of(h, df, n):
        return pa.RecordBatch.from_arrays([h, pa.array(df, pa.int64()), pa.array(n, pa.int64())], names=["h", "df", "n"])

    for batch in batches:
        for part in chunks(batch, "text"):
            w = Words(part.column("text"))
            texts, words = texts + part.num_rows, words + len(w.hash)
            held.append(np.unique(pairs(w)[1], return_counts=True))
            if sum(len(x[0]) for x in held) > _MERGE_AT:
                held = [merged()]
                if len(held[0][0]) > _MERGE_AT // 2:
                    u, c = held.pop()
                    yield batch_of(pa.array(u.view(np.int64)), c, np.zeros(len(u), np.int64))
    if held:
        u, c = merged()
        yield batch_of(pa.array(u.view(np.int64)), c, np.zeros(len(u), np.int64))
    yield batch_of(pa.array([None], pa.int64()), [texts], [words])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            r, h, tf = pairs(Words(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(r)), pa.array(h.view(np.int64)), pa.array(tf, pa.int64())], names=["query_id", "h", "tf"])


class Queries:
    """A block of queries: dense weights of the head terms, lists of the others by term."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, df: np.ndarray, mean: float, k: int):
        self.ids, q = np.unique(query, return_inverse=True)
        self.terms, t = np.unique(term.view(np.uint64), return_inverse=True)
        self.mean, self.k = mean, k
        common = np.zeros(len(self.terms), dtype=np.int64)
        common[t] = df
        self.head = np.full(len(self.terms), -1)
        top = np.argsort(-common, kind="stable")[:HEADS]
        self.head[top] = np.arange(len(top))
        heads = self.head[t] >= 0
        self.dense = np.zeros((len(self.ids), len(top)))
        self.dense[q[heads], self.head[t[heads]]] = weight[heads]
        order = np.argsort(t[~heads], kind="stable")
        self.query, self.weight = q[~heads][order], weight[~heads][order]
        self.first = np.searchsorted(t[~heads][order], np.arange(len(self.terms) + 1))
        self.best = np.full((len(self.ids), k), -np.inf)
        self.found = np.full((len(self.ids), k), -1, dtype=np.int64)

    def add(self, doc_ids: np.ndarray, w: Words) -> None:
        """Search a chunk of texts and keep each query's k best."""
        row, h, tf = pairs(w)
        length = np.diff(w.first)
        at = np.minimum(np.searchsorted(self.terms, h), max(0, len(self.terms) - 1))
        hit = self.terms[at] == h if len(self.terms) else np.zeros(len(h), dtype=bool)
        #: texts by their most frequent word
        favourite = np.zeros(len(length), dtype=np.uint64)
        order = np.lexsort((h, tf))
        favourite[row[order]] = h[order]
        place = np.empty(len(length), dtype=np.int64)
        by = np.lexsort((doc_ids, favourite))
        place[by] = np.arange(len(length))
        ids = doc_ids[by]
        row, t, tf = place[row[hit]], at[hit], tf[hit]
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[by][row] / self.mean))
        head = self.head[t] >= 0
        dense = np.zeros((self.dense.shape[1], len(length)))
        dense[self.head[t[head]], row[head]] = impact[head]
        row, t, impact = row[~head], t[~head], impact[~head]
        order = np.argsort(row, kind="stable")
        row, t, impact = row[order], t[order], impact[order]
        n = len(self.ids)
        for lo in range(0, len(length), BLOCK):
            hi = min(lo + BLOCK, len(length))
            a, b = np.searchsorted(row, [lo, hi])
            count = self.first[t[a:b] + 1] - self.first[t[a:b]]
            e = np.arange(int(count.sum())) + np.repeat(self.first[t[a:b]] - (np.cumsum(count) - count), count)
            cell = self.query[e] * (hi - lo) + np.repeat(row[a:b] - lo, count)
            rare = np.bincount(cell, self.weight[e] * np.repeat(impact[a:b], count), n * (hi - lo)).reshape(n, hi - lo)
            bound = self.dense @ dense[:, lo:hi].max(1) + rare.max(1)
            live = np.flatnonzero((bound > 0) & (bound >= self.best[:, -1] - 1e-6))
            if not len(live):
                continue
            score = np.round(self.dense[live] @ dense[:, lo:hi] + rare[live], 9)
            score[score <= 0] = -np.inf
            better = score.max(1) >= self.best[live, -1]
            live, score = live[better], score[better]
            every = np.concatenate([self.best[live], score], 1)
            who = np.concatenate([self.found[live], np.broadcast_to(ids[lo:hi], score.shape)], 1)
            order = np.lexsort((who, -every), axis=1)[:, : self.k]
            self.best[live] = np.take_along_axis(every, order, 1)
            self.found[live] = np.take_along_axis(who, order, 1)

    def rows(self) -> pa.RecordBatch:
        q, c = np.nonzero(self.best > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, c]), pa.array(self.best[q, c])], names=["query_id", "doc_id", "score"])


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score. queries: (query_id, text)."""
    spark = docs.sparkSession
    doc = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df = materialize(doc.select("text").mapInArrow(_frequencies, "h long, df long, n long").groupBy("h").agg(F.sum("df").alias("df"), F.sum("n").alias("n")))
    total = df.where("h is null").first()
    texts, mean = (total.df, max(total.n / max(total.df, 1), 1e-9)) if total else (0, 1.0)
    q = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "text").groupBy("query_id").agg(F.min("text").alias("text"))
    terms = q.mapInArrow(_query_terms, "query_id long, h long, tf long").join(df.select("h", "df"), "h")
    idf = F.log(1 + (F.lit(float(texts)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = materialize(terms.select("query_id", "h", "df", (F.col("tf") * idf).alias("weight")))
    #: blocks by running number of terms; coarse parts first, so that no task orders all queries
    sizes = terms.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(1024)))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.join(parts, "part").select("query_id", F.floor((F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))) / QUERY_TERMS).alias("block"))
    terms = materialize(terms.join(blocks, "query_id"))
    last = terms.agg(F.max("block")).first()[0]
    best = None
    for block in range(-1 if last is None else last + 1):
        t = terms.where(F.col("block") == block).toArrow()  # QUERY_TERMS rows, and the last query's
        shared = spark.sparkContext.broadcast(tuple(t.column(c).to_numpy() for c in ("query_id", "h", "weight", "df")))
        del t

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Queries(*shared.value, mean, k)
            for batch in batches:
                for part in chunks(batch, "text"):
                    found.add(part.column("doc_id").to_numpy(zero_copy_only=False), Words(part.column("text")))
            yield found.rows()

        #: a block's hits are written before the next block's terms come to the driver
        hits = materialize(doc.mapInArrow(run, "query_id long, doc_id long, score double"))
        shared.destroy()
        best = hits if best is None else best.unionByName(hits)
    if best is None:
        best = spark.createDataFrame([], "query_id long, doc_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
