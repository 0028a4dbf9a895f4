"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the stems of all words (runs of letters and digits, lower-cased): their first STEM
characters, whole where shorter, known by 64-bit hashes; none is left out. Held out on
labelled rows, stems of 4 tell toxic texts better than whole words with or without stems
(area under the curve 0.988 against 0.933 and 0.971). Document frequencies are counted over all documents by
Spark. Examples are a bounded sample of labelled training rows (FIT_ROWS, by a hash of
doc_id). Texts are TF-IDF vectors, (1 + log tf) * idf, unit length; words of a document
that no example has count in its length, by a shuffled join with the frequencies.

The examples stand, by their most frequent term, in blocks of BLOCK. Lists of the HEADS
most frequent terms carry a largest weight per block; lists of all other terms are summed
first. The block's largest such sum and its block maxima bound a block; a query visits blocks
by falling bound and skips those whose bound is below the NEIGHBOURS-th product it has
found: the neighbours are exact (found in single precision with a margin, then scored in
double). Votes weigh by cosine, are shrunk to the
share of label 1, and calibrated by a logistic fit on leave-one-out votes. Evidence: ids
and cosines.

A document that shares no term with an example has no neighbours; its score is the
calibrated vote of none. Whole texts are read; lang, source and doc_id are no inputs.

Defined results: null and empty texts are scored like texts without terms; without labels
of both kinds all scores are the one kind's share (no labels: 0); doubled labels of an id
count once, the larger one; repeated rows score alike; extra columns pass through
``drop_toxic``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, list_array, materialize, semi

FIT_ROWS, STEM = 20_000, 4
NEIGHBOURS, BLOCK, HEADS, QUERIES, SHRINK = 15, 64, 768, 128, 1.0
#: blocks of largest bound that a query visits first
FIRST = 16
_MERGE_AT = 1_000_000
SLICES = 8
#: more than single precision can be off by
_MARGIN = 1e-4
_WORD = re.compile(r"\w+")


def stems(text: str | None) -> list[str]:
    return [w[:STEM] for w in _WORD.findall((text or "").lower())]


def term_id(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms a text, hash, tf) of the distinct terms of each text, by row, then hash."""
    number: dict[str, int] = {}
    found = [[number.setdefault(w, len(number)) for w in stems(text)] for text in column.to_pylist()]
    every, at = np.unique(np.fromiter((term_id(w) for w in number), dtype=np.uint64, count=len(number)), return_inverse=True)
    size = np.array([len(x) for x in found], dtype=np.int64)
    w = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(size.sum()))
    n = max(1, len(every))
    cell, tf = np.unique(np.repeat(np.arange(len(found)), size) * n + at[w], return_counts=True)
    return np.bincount(cell // n, minlength=len(found)), every[cell % n], tf


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, df) merged within the task up to a bound; the row of h = null counts texts."""
    held, texts = [], 0

    def merged():
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        u, inverse = np.unique(h, return_inverse=True)
        return u, np.bincount(inverse, c).astype(np.int64)

    def batch_of(h, df):
        return pa.RecordBatch.from_arrays([h, pa.array(df, pa.int64())], names=["h", "df"])

    for batch in batches:
        for part in chunks(batch, "text"):
            texts += part.num_rows
            held.append(np.unique(terms(part.column("text"))[1], return_counts=True))
            if sum(len(x[0]) for x in held) > _MERGE_AT:
                held = [merged()]
                if len(held[0][0]) > _MERGE_AT // 2:
                    u, c = held.pop()
                    yield batch_of(pa.array(u.view(np.int64)), c)
    if held:
        u, c = merged()
        yield batch_of(pa.array(u.view(np.int64)), c)
    yield batch_of(pa.array([None], pa.int64()), [texts])


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            size, h, tf = terms(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), list_array(h.view(np.int64), size, pa.int64()), list_array(tf, size, pa.int32())], names=["doc_id", "y", "h", "c"])


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


class Index:
    """Examples (rows of term: count, or sizes, terms and counts end to end) with labels."""

    def __init__(self, rows: list[dict[int, int]] | tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, ids: np.ndarray, idf: np.ndarray):
        if not isinstance(rows, tuple):
            rows = tuple(np.array(x, dtype=np.int64) for x in ([len(r) for r in rows], [t for r in rows for t in r], [c for r in rows for c in r.values()]))
        self.size, self.t, self.c = rows[0], rows[1].astype(np.int32), rows[2].astype(np.int32)
        self.first = np.cumsum(self.size) - self.size
        self.labels, self.ids, self.idf = labels.astype(float), ids, idf
        self.prior = float(labels.mean()) if len(ids) else 0.0
        self.norm = np.sqrt(np.bincount(np.repeat(np.arange(len(ids)), self.size), self.weigh(self.t, self.c) ** 2, len(ids)))
        self.a, self.b, self.one_kind = 0.0, 1.0, True
        self.ready = False

    def weigh(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (1 + np.log(c)) * self.idf[t]

    def vector(self, row: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(row), dtype=np.int64)
        w = self.weigh(t, np.array([row[x] for x in t.tolist()], dtype=float)) if len(t) else np.zeros(0)
        return t, w / np.linalg.norm(w) if len(t) else w

    def slices(self, n: int = 1024) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        """Examples lo to hi, their cells and each cell's example: what is made of cells is held for a slice at a time."""
        for lo in range(0, len(self.ids), n):
            hi = min(lo + n, len(self.ids))
            yield lo, hi, slice(int(self.first[lo]), int(self.first[hi - 1] + self.size[hi - 1])), np.repeat(np.arange(lo, hi, dtype=np.int32), self.size[lo:hi])

    def build(self) -> None:
        """The lists, once in every process that searches."""
        n = len(self.ids)
        df = np.bincount(self.t, minlength=len(self.idf))
        top = np.argsort(-df, kind="stable")[:HEADS]
        self.head = np.full(len(self.idf), -1, dtype=np.int16)
        self.head[top] = np.arange(len(top))
        #: each example's most frequent term, the commoner one of equals
        favourite = np.full(n, -1)
        for lo, hi, cells, row in self.slices():
            best = self.c[cells].astype(np.int64) * (len(self.t) + 1) + df[self.t[cells]]
            full = np.flatnonzero(self.size[lo:hi] > 0)
            largest = np.zeros(hi - lo, dtype=np.int64)
            if len(full):
                largest[full] = np.maximum.reduceat(best, self.first[lo:hi][full] - cells.start)
            hit = np.flatnonzero(best == largest[row - lo])
            favourite[row[hit]] = self.t[cells][hit]
        self.by = np.lexsort((np.arange(n), favourite))
        place = np.empty(n, dtype=np.int32)
        place[self.by] = np.arange(n)
        blocks = max(1, -(-n // BLOCK))
        w = np.empty(len(self.t), dtype=np.float32)
        at = np.empty(len(self.t), dtype=np.int32)
        dense = np.zeros((blocks * BLOCK, len(top)), dtype=np.float32)
        idf, norm = self.idf.astype(np.float32), np.maximum(self.norm, 1e-300).astype(np.float32)
        for _, _, cells, row in self.slices():
            v = np.log(self.c[cells]).astype(np.float32) + np.float32(1)
            v *= idf[self.t[cells]]
            v /= norm[row]
            h = self.head[self.t[cells]]
            heads = np.flatnonzero(h >= 0)
            w[cells], at[cells] = v, place[row]
            dense[at[cells][heads], h[heads]] = v[heads]
        self.dense = dense.reshape(blocks, BLOCK, -1)
        self.top = self.dense.max(1)
        rest = np.flatnonzero(self.head[self.t] < 0).astype(np.int32)
        rest = rest[np.argsort(self.t[rest], kind="stable")]
        self.at, self.weight = at[rest], w[rest]
        del w, at
        self.list = np.searchsorted(self.t[rest], np.arange(len(self.idf) + 1))
        self.scratch = np.zeros(len(self.idf))
        self.ready = True

    def search(self, size: np.ndarray, t: np.ndarray, c: np.ndarray, without: np.ndarray | None = None, k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the k largest products above 0 of its vector, of length not yet 1,
        with examples, ties to the earlier example: (products, examples).

        Rare terms are summed by their lists. Blocks are then visited by falling bound, FIRST
        of them before the rest: what these find sets the floor that the rest must reach.
        """
        if not self.ready:
            self.build()
        first = np.cumsum(size) - size
        w = self.weigh(t, c)
        blocks = self.dense.shape[0]
        seat = None
        if without is not None:
            seat = np.empty(len(self.ids), dtype=np.int64)
            seat[self.by] = np.arange(len(self.by))
        for lo in range(0, len(size), QUERIES):
            part = range(lo, min(lo + QUERIES, len(size)))
            sums = np.zeros((len(part), blocks * BLOCK), dtype=np.float32)
            heads = np.zeros((len(part), self.dense.shape[2]), dtype=np.float32)
            scale = np.zeros(len(part))
            for i, q in enumerate(part):
                x, y = t[first[q] : first[q] + size[q]], w[first[q] : first[q] + size[q]]
                scale[i] = np.linalg.norm(y)
                h = self.head[x]
                heads[i, h[h >= 0]] = y[h >= 0]
                x, y = x[h < 0], y[h < 0]
                a, b = self.list[x], self.list[x + 1]
                lists = [slice(*e) for e in zip(a.tolist(), b.tolist(), strict=True)]
                if lists:
                    weight = np.concatenate([self.weight[e] for e in lists])
                    weight *= np.repeat(y.astype(np.float32), b - a)
                    sums[i] = np.bincount(np.concatenate([self.at[e] for e in lists]), weight, sums.shape[1])
            if without is not None:  # what is left out may not raise the floor
                gone = np.flatnonzero(without[part] >= 0)
                sums[gone, seat[without[part][gone]]] = -np.inf
            cells = sums.reshape(len(part), blocks, BLOCK)
            most = cells.max(2)
            bound = heads @ self.top.T + most
            margin = _MARGIN * scale
            visited = np.zeros((len(part), blocks), dtype=bool)
            kth = max(0, blocks - k)
            for turn in range(2):
                #: the k-th largest of the blocks' maxima, each of another example, is no more than the k-th product
                floor = np.maximum(np.partition(most, kth, axis=1)[:, kth] if blocks >= k else 0, 0) - margin
                live = (bound > 0) & (bound >= floor[:, None]) & ~visited
                if not turn and blocks > FIRST:
                    live &= bound >= np.partition(bound, blocks - FIRST, axis=1)[:, blocks - FIRST, None]
                for b in np.flatnonzero(live.any(0)).tolist():
                    q = np.flatnonzero(live[:, b])
                    sums[q, b * BLOCK : (b + 1) * BLOCK] += heads[q] @ self.dense[b].T
                    most[q, b] = cells[q, b].max(1)
                visited |= live
            floor = np.maximum(np.partition(most, kth, axis=1)[:, kth] if blocks >= k else 0, 0) - margin
            for i, q in enumerate(part):
                near = np.flatnonzero((sums[i] > 0) & (sums[i] >= floor[i]))
                if len(near) > k:
                    s = sums[i, near]
                    near = near[s >= np.partition(s, len(s) - k)[len(s) - k] - margin[i]]
                near = np.sort(self.by[near])
                yield self.exact(t[first[q] : first[q] + size[q]], w[first[q] : first[q] + size[q]], near, k)

    def exact(self, t: np.ndarray, w: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(near):
            return np.zeros(0), near
        self.scratch[t] = w
        a, n = self.first[near], self.size[near]
        rows = [slice(*e) for e in zip(a.tolist(), (a + n).tolist(), strict=True)]
        x, c = (np.concatenate([v[e] for e in rows]) for v in (self.t, self.c))
        y = self.scratch[x]
        hit = np.flatnonzero(y)
        row = np.repeat(np.arange(len(near)), n)[hit]
        s = np.bincount(row, y[hit] * self.weigh(x[hit], c[hit]), len(near)) / self.norm[near]
        self.scratch[t] = 0
        order = np.lexsort((near, -s))[:k]
        order = order[s[order] > 0]
        return s[order], near[order]

    def nearest(self, row: dict[int, int], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k largest cosines above 0, ties to the earlier example."""
        t, w = self.vector(row)
        if not len(t):
            return []
        s, i = next(self.search(np.array([len(t)]), t, np.array([row[x] for x in t.tolist()]), np.array([without]), k))
        norm = np.linalg.norm(self.weigh(t, np.array([row[x] for x in t.tolist()])))
        return [(float(a) / norm, int(b)) for a, b in zip(s, i, strict=True)]

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in near)
        return (sum(s * self.labels[i] for s, i in near) + SHRINK * self.prior) / (total + SHRINK)

    def calibrate(self, votes: np.ndarray) -> None:
        """Logistic fit of labels on leave-one-out votes by Newton steps, with a small ridge."""
        y = self.labels
        if not len(y) or y.min() == y.max():
            return
        v = np.clip(votes, 1e-4, 1 - 1e-4)
        x = np.stack([np.ones(len(v)), np.log(v / (1 - v))], 1)
        beta = np.array([0.0, 1.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-x @ beta))
            beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), x.T @ (y - p) - 1e-2 * (beta - [0, 1]))
        self.a, self.b = float(beta[0]), float(beta[1])
        self.one_kind = False

    def score(self, vote: Column) -> Column:
        if self.one_kind:
            return F.lit(self.prior)
        v = F.least(F.greatest(vote, F.lit(1e-4)), F.lit(1 - 1e-4))
        return 1 / (1 + F.exp(-self.a - self.b * F.log(v / (1 - v))))


def fold(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = FIT_ROWS):
    """The calibrated index, its broadcast with the hashes of its terms, all terms' (h, idf). labels: (doc_id, toxic)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    if train is not None:
        known = known.where(train)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = text.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # at most FIT_ROWS labels; of an id's texts the least
    sample = materialize(sample.mapInArrow(_example_terms, "doc_id long, y int, h array<long>, c array<int>"))
    counted = materialize(text.select("text").mapInArrow(_frequencies, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")))
    n = counted.where("h is null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    idf = counted.where("h is not null").select("h", F.log((F.lit(n) + 1) / F.col("df")).alias("idf"))
    mine = sample.select(F.explode("h").alias("h")).distinct()
    got = idf.join(mine, "h").toArrow()  # the terms of FIT_ROWS rows
    vocab, weight = got.column("h").to_numpy().view(np.uint64), got.column("idf").to_numpy()
    order = np.argsort(vocab)
    vocab, weight = vocab[order], weight[order]
    #: FIT_ROWS rows, a slice at a time, so that the driver holds one slice of hashes
    parts = []
    for k in range(SLICES):
        got = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == k).toArrow()
        if got.num_rows:
            h = got.column("h").combine_chunks()
            parts.append((got.column("doc_id").to_numpy(), got.column("y").to_numpy(), np.diff(h.offsets.to_numpy()), np.searchsorted(vocab, h.flatten().to_numpy().view(np.uint64)).astype(np.int32), got.column("c").combine_chunks().flatten().to_numpy().astype(np.int32)))
            del got, h
    ids, y, size, t, c = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=k) for k in (np.int64, np.int32, np.int64, np.int32, np.int32))
    order, first = np.argsort(ids), np.cumsum(size) - size
    cells = spans(first[order], size[order])
    index = Index((size[order], t[cells], c[cells]), y[order], ids[order], weight)
    del parts, t, c, cells
    shared = docs.sparkSession.sparkContext.broadcast((index, vocab))  # bounded by FIT_ROWS

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, vocab = shared.value
        for batch in batches:
            at = np.searchsorted(idx.ids, batch.column("doc_id").to_numpy())
            t, c = (np.concatenate([x[idx.first[i] : idx.first[i] + idx.size[i]] for i in at]) if len(at) else x[:0] for x in (idx.t, idx.c))
            found = idx.search(idx.size[at], t, c, at)
            v = [idx.vote(list(zip(s / max(idx.norm[i], 1e-300), near, strict=True))) for i, (s, near) in zip(at, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(v, pa.float64())], names=["at", "vote"])

    if len(index.ids) and 0 < index.prior < 1:
        got = sample.select("doc_id").repartition(24).mapInArrow(votes, "at long, vote double").toArrow()  # FIT_ROWS rows
        v = np.zeros(len(index.ids))
        v[got.column("at").to_numpy()] = got.column("vote").to_numpy()
        index.calibrate(v)
    return index, shared, idf


def score(docs: DataFrame, index: Index, shared, idf: DataFrame) -> DataFrame:
    """The columns but text, score, evidence (array of id and cosine) for every row, in any order."""
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, vocab = shared.value
        row_no = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, "text"):
                size, h, tf = terms(part.column("text"))
                row = np.repeat(np.arange(len(size)), size)
                at = np.minimum(np.searchsorted(vocab, h), max(0, len(vocab) - 1))
                hit = vocab[at] == h if len(vocab) else np.zeros(len(h), dtype=bool)
                known = np.bincount(row[hit], minlength=len(size))
                t, c = at[hit], tf[hit]
                square = np.bincount(row[hit], idx.weigh(t, c) ** 2, len(size)) if len(t) else np.zeros(len(size))
                found = list(idx.search(known, t, c)) if len(idx.ids) else [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(size)
                near = np.concatenate([np.zeros(0, dtype=np.int64), *(i for _, i in found)])
                n = np.array([len(i) for _, i in found])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in rest), pa.array(np.arange(len(size)) + row_no), pa.array(square),
                     list_array(np.concatenate([np.zeros(0), *(s for s, _ in found)]), n, pa.float64()), list_array(idx.labels[near], n, pa.float64()), list_array(idx.ids[near], n, pa.int64()),
                     list_array(h[~hit].view(np.int64), size - known, pa.int64()), list_array(tf[~hit], size - known, pa.int32())],
                    names=[*(f.name for f in rest), "_row", "_square", "_s", "_y", "_id", "_h", "_c"],
                )
                row_no += len(size)

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "_row long, _square double, _s array<double>, _y array<double>, _id array<long>, _h array<long>, _c array<int>"])
    rows = materialize(docs.mapInArrow(run, kinds))
    new = rows.select("_row", F.explode(F.arrays_zip("_h", "_c")).alias("x")).select("_row", F.col("x._h").alias("h"), F.col("x._c").alias("c"))
    more = new.join(idf, "h").groupBy("_row").agg(F.sum(F.pow((1 + F.log("c")) * F.col("idf"), 2)).alias("_more"))
    out = rows.drop("_h", "_c").join(more, "_row", "left")
    norm = F.greatest(F.sqrt(F.col("_square") + F.coalesce("_more", F.lit(0.0))), F.lit(1e-300))
    out = out.withColumn("_norm", norm).withColumn("_s", F.transform("_s", lambda x: x / F.col("_norm")))
    plus = lambda a, x: a + x
    votes = F.aggregate(F.zip_with("_s", "_y", lambda s, y: s * y), F.lit(0.0), plus) + SHRINK * index.prior
    vote = votes / (F.aggregate("_s", F.lit(0.0), plus) + SHRINK)
    evidence = F.slice(F.zip_with("_id", "_s", lambda i, s: F.struct(i.alias("doc_id"), s.alias("cosine"))), 1, 3)
    return out.select(*[F.col(f"`{f.name}`") for f in rest], index.score(vote).alias("_score"), evidence.alias("_evidence"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence; learned from rows not held out."""
    index, shared, idf = fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), index, shared, idf).withColumnsRenamed({"_score": "score", "_evidence": "evidence"})
    return out.select("doc_id", (F.coalesce(fold(F.col("doc_id"), 5), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold."""
    index, shared, idf = fit(docs, labels)
    key = (F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"))
    toxic = score(docs.select(*key, "text"), index, shared, idf).where(F.col("_score") >= threshold).select(F.col("k").alias("tk"), F.col("h").alias("th")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *key)
    return semi(row, materialize(toxic), F.col("k").eqNullSafe(F.col("tk")) & (F.col("h") == F.col("th")), "left_anti").select("d.*")
