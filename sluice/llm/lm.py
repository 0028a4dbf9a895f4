"""Language-model scores: a log-bilinear neural model fitted by noise-contrastive estimation.

Tokens are ASCII-lowered words and one end per text. Counts of all training tokens are
exact and distributed; the COMMON most frequent ones (a fixed bound) travel to the tasks,
rarer ones are looked up by a shuffled join on a 64-bit word hash.

Every token has a symbol: the end, one of the VOCABULARY most frequent words, each with
vectors of its own, or, for rarer words, one of TAILS endings (a hash of the last two bytes).
Symbols by falling count form classes of CLASS. The model is log-bilinear in the two symbols
before: r = a[w1] + b[w2]; P(w) = P(class | r) P(w | class, r), either part a softmax of
r . t + bias, so that batched products over one class normalise it. Within an ending a word
has probability (c + 1) / (its tokens + its words + 1): with one unseen word for each ending
the model is a distribution.

Both parts are fitted by noise-contrastive estimation on sampled noise: CLASS_NOISE classes a
batch and WORD_NOISE words of the same class a token, by their counts. All training tokens
take part once, in ROUNDS parts of the documents: in a round every task starts from the same
vectors and makes steps of BATCH tokens on what it reads; Spark sums the tasks' changes by
row, weighted by the root of the tokens that touched it (so that no sum outgrows a long), and
the means are the next round's start. Sums are of integers, so reruns over the same
partitions agree. The vectors are bounded by
the symbols; what they are fitted on is the whole corpus.

Defined results: null and empty texts have one token, the end; without training rows all
counts are 0 (base_score is then -n log10(1)); null doc_id: neither held out nor trained
on; repeated rows are scored each; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, list_array, materialize, mix
from .toxicity import fold

COMMON = 200_000
VOCABULARY, TAILS, CLASS = 16_319, 64, 128
#: symbols: the end is 0, then the endings, then words by falling count
FIRST_WORD = 1 + TAILS
SYMBOLS = FIRST_WORD + VOCABULARY
CLASSES = SYMBOLS // CLASS
DIM, CLASS_NOISE, WORD_NOISE = 16, 32, 4
ROUNDS, BATCH, RATE = 2, 2048, 0.15
#: bytes of text that a task turns to tokens, and tokens that it scores, at a time
PART_BYTES, SLICE = 1 << 20, 1 << 11
#: the hash that stands for the end
END_HASH = 0x3C6EF372FE94F82B
_MERGE_AT = 400_000


class Tokens(Words):
    """Word hashes of a chunk with an end after each text; tail classes of the words."""

    def __init__(self, column: pa.Array):
        super().__init__(column)
        n = len(self.offsets) - 1
        last = self.data[self.end - 1].astype(np.uint64)
        before = np.where(self.end - self.start > 1, self.data[np.maximum(self.end - 2, 0)], 0).astype(np.uint64)
        tail = (mix(last * np.uint64(257) + before) % np.uint64(TAILS)).astype(np.int64)
        self.size = np.diff(self.first) + 1
        self.at = np.cumsum(self.size) - self.size
        total = len(self.hash) + n
        is_end = np.zeros(total, dtype=bool)
        is_end[self.at + self.size - 1] = True
        self.token = np.full(total, END_HASH, dtype=np.uint64)
        self.token[~is_end] = self.hash
        self.tail = np.full(total, -1)
        self.tail[~is_end] = tail


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, tail, c) of the chunks' training tokens, merged within the task up to a bound."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        h, t, c = (np.concatenate(x) for x in zip(*held, strict=True))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return u, t[first], np.bincount(inverse, c).astype(np.int64)

    def batch_of(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1], pa.int32()), pa.array(x[2], pa.int64())], names=["h", "tail", "c"])

    for batch in batches:
        for part in chunks(batch, "text"):
            k = Tokens(part.column("text"))
            u, first, c = np.unique(k.token, return_index=True, return_counts=True)
            held.append((u, k.tail[first], c))
            if sum(len(x[0]) for x in held) > _MERGE_AT:
                held = [merged()]
                if len(held[0][0]) > _MERGE_AT // 2:
                    yield batch_of(held[0])
                    held = []
    if held:
        yield batch_of(merged())


class Symbols:
    """Word hash -> symbol and count, for the common words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        """By falling count; the end is not among them."""
        order = np.argsort(hashes)
        self.hash, self.count = hashes[order], counts[order]
        symbol = np.full(len(hashes), -1)
        symbol[:VOCABULARY] = FIRST_WORD + np.arange(min(VOCABULARY, len(hashes)))
        self.symbol = symbol[order]

    def of(self, k: Tokens, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: symbol, count, whether common."""
        n = len(k.token)
        at = np.minimum(np.searchsorted(self.hash, k.token), max(0, len(self.hash) - 1))
        known = self.hash[at] == k.token if len(self.hash) else np.zeros(n, dtype=bool)
        count = np.where(known, self.count[at], 0) if len(self.hash) else np.zeros(n, dtype=np.int64)
        word = np.where(known, self.symbol[at], -1) if len(self.hash) else np.full(n, -1)
        end = k.token == np.uint64(END_HASH)
        symbol = np.where(end, 0, np.where(word >= 0, word, 1 + k.tail))
        return symbol, np.where(end, ends, count), known | end


def before(k: Tokens, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each token; the end stands before a text."""
    one, two = np.zeros_like(symbol), np.zeros_like(symbol)
    one[1:], two[2:] = symbol[:-1], symbol[:-2]
    one[k.at] = two[k.at] = 0
    two[(k.at + 1)[k.size > 1]] = 0
    return one, two


class Model:
    """Rows of theta: contexts one before, contexts two before, symbols, classes; the last column is the bias."""

    def __init__(self, counts: np.ndarray, dim: int = DIM, seed: int = 0):
        """counts: training tokens of each symbol, the end first; those past the last are not in the model."""
        self.symbols = len(counts)
        n = np.zeros(SYMBOLS)
        n[: len(counts)] = counts + 1.0
        of_class = n.reshape(CLASSES, CLASS).sum(1)
        self.class_share = of_class / of_class.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_class = np.log(self.class_share).astype(np.float32)
            self.log_share = np.log(n / np.repeat(of_class, CLASS)).astype(np.float32)
        self.cumulative = np.concatenate([[0.0], np.cumsum(n)])
        theta = np.random.default_rng(seed).normal(0, 0.1, (3 * SYMBOLS + CLASSES, dim + 1)).astype(np.float32)
        theta[: 2 * SYMBOLS, -1] = 0
        theta[2 * SYMBOLS : 3 * SYMBOLS, -1] = np.where(n > 0, self.log_share, -np.inf)
        theta[3 * SYMBOLS :, -1] = np.where(of_class > 0, self.log_class, -np.inf)
        self.theta, self.squares = theta, np.full(len(theta), 1e-2, dtype=np.float32)

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        r = _rows(self.theta, one)
        r += _rows(self.theta, SYMBOLS + two)
        r[:, -1] = 1
        return r

    def within(self, c: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The last symbol of class c whose cumulative count is x at most, by halving the class."""
        at = np.broadcast_to(c * CLASS, x.shape).copy()
        half = CLASS // 2
        while half:
            at += half * (self.cumulative[at + half] <= x)
            half //= 2
        return at

    def step(self, one: np.ndarray, two: np.ndarray, symbol: np.ndarray, rng: np.random.Generator, touched: np.ndarray, rate: float = RATE) -> None:
        """One step of the objective on a batch; touched counts the tokens of each row."""
        theta, n = self.theta, len(symbol)
        r = self.hidden(one, two)
        c = symbol // CLASS
        noise_c = rng.choice(CLASSES, CLASS_NOISE, p=self.class_share)
        low, high = self.cumulative[c * CLASS], self.cumulative[np.minimum((c + 1) * CLASS, SYMBOLS)]
        noise = self.within(c, low + rng.random((WORD_NOISE, n)) * (high - low))
        noise = np.clip(noise, c * CLASS, np.minimum((c + 1) * CLASS, self.symbols) - 1)
        sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        #: classes: a token's own, and the batch's noise
        own, fake = _rows(theta, 3 * SYMBOLS + c), theta[3 * SYMBOLS + noise_c]
        g_own = 1 - sigma((r * own).sum(1) - self.log_class[c] - math.log(CLASS_NOISE))
        g_fake = -sigma(r @ fake.T - self.log_class[noise_c] - math.log(CLASS_NOISE))
        g_r = g_own[:, None] * own + g_fake @ fake
        #: words of the class: the token's, and noise of its own
        word, others = _rows(theta, 2 * SYMBOLS + symbol), _rows(theta, 2 * SYMBOLS + noise)
        h_own = 1 - sigma((r * word).sum(1) - self.log_share[symbol] - math.log(WORD_NOISE))
        h_fake = -sigma(np.einsum("nd,knd->kn", r, others) - self.log_share[noise] - math.log(WORD_NOISE))
        g_r += h_own[:, None] * word + np.einsum("kn,knd->nd", h_fake, others)
        g_r[:, -1] = 0
        small = np.min_scalar_type(len(theta))  # small integers sort by radix
        rows = np.concatenate([one, SYMBOLS + two, 2 * SYMBOLS + symbol, 2 * SYMBOLS + noise.ravel(), 3 * SYMBOLS + c, 3 * SYMBOLS + noise_c])
        grads = np.empty((len(rows), r.shape[1]), dtype=np.float32)
        grads[:n], grads[n : 2 * n], low = g_r, g_r, (3 + WORD_NOISE) * n
        np.multiply(h_own[:, None], r, out=grads[2 * n : 3 * n])
        np.multiply(h_fake[:, :, None], r, out=grads[3 * n : low].reshape(WORD_NOISE, n, -1))
        np.multiply(g_own[:, None], r, out=grads[low : low + n])
        grads[low + n :] = g_fake.T @ r
        order = np.argsort(rows.astype(small), kind="stable")
        rows = rows[order]
        at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        grad, rows = np.add.reduceat(_rows(grads, order), at), rows[at]
        squares = self.squares[rows] + (grad * grad).mean(1)
        self.squares[rows] = squares
        grad *= (rate / np.sqrt(squares))[:, None]
        theta[rows] = _rows(theta, rows) + grad
        touched[rows] += np.diff(np.append(at, len(order)))

    def log10(self, one: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 P(symbol | one, two), normalised over classes and then within the class."""
        words, classes = self.theta[2 * SYMBOLS : 3 * SYMBOLS], self.theta[3 * SYMBOLS :]
        #: what a context says of the classes is computed once for all tokens behind it
        context, of = np.unique(one * SYMBOLS + two, return_inverse=True)
        hidden = self.hidden(context // SYMBOLS, context % SYMBOLS)
        total = np.concatenate([_log_sum(hidden[lo : lo + SLICE] @ classes.T) for lo in range(0, len(hidden), SLICE)] or [np.zeros(0)])
        c = symbol // CLASS
        out = np.empty(len(symbol))
        order = np.argsort(c.astype(np.min_scalar_type(CLASSES)), kind="stable")
        first = np.searchsorted(c[order], np.arange(CLASSES + 1))
        for i in np.flatnonzero(np.diff(first)).tolist():
            for lo in range(first[i], first[i + 1], SLICE):
                mine = order[lo : min(lo + SLICE, first[i + 1])]
                r = _rows(hidden, of[mine])
                x = r @ words[i * CLASS : (i + 1) * CLASS].T
                own = x[np.arange(len(mine)), symbol[mine] - i * CLASS] + r @ classes[i]
                out[mine] = own - _log_sum(x) - total[of[mine]]
        return out / np.log(10)


def _rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[at]; every index is a row of x."""
    return np.take(x, at, axis=0, mode="clip")


def _log_sum(x: np.ndarray) -> np.ndarray:
    """The logarithm of each row's sum of exponentials; x is overwritten."""
    top = x.max(1)
    if len(top) and not (np.abs(top) < 60).all():
        x -= top[:, None]
    else:
        top = 0
    return top + np.log(np.exp(x, out=x) @ np.ones(x.shape[1], dtype=x.dtype))


#: changes, times their weights, are summed as integers of this fraction
_UNIT = float(1 << 16)


@dataclass
class Fitted:
    symbols: Symbols
    model: Model
    #: tokens and words of each ending
    size: np.ndarray
    ends: int
    tokens: int
    types: int
    counts: DataFrame


def fit(train: DataFrame) -> Fitted:
    """Count and fit the training texts: (doc_id, text)."""
    spark = train.sparkSession
    counts = materialize(train.select("text").mapInArrow(_counts, "h long, tail int, c long").groupBy("h", "tail").agg(F.sum("c").alias("c")))
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    ends = counts.where(F.col("tail") < 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top = counts.where("tail >= 0").orderBy(F.desc("c"), "h").limit(COMMON).select("h", "c").toPandas()  # COMMON rows of 16 bytes
    symbols = Symbols(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64))
    words = spark.createDataFrame(top[["h"]][:VOCABULARY], "h long")
    tails = counts.where("tail >= 0").join(F.broadcast(words), "h", "left_anti").groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    size, of_tail = np.zeros(TAILS), np.zeros(TAILS)
    for r in tails:
        size[r.tail], of_tail[r.tail] = r.c + r.v, r.c
    model = Model(np.concatenate([[ends], of_tail, top["c"].to_numpy(float)[:VOCABULARY]]))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((symbols, model))  # COMMON entries, and the vectors of SYMBOLS

        def changes(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            symbols, start = shared.value
            mine = Model.__new__(Model)
            mine.__dict__.update(start.__dict__, theta=start.theta.copy(), squares=start.squares.copy())
            touched = np.zeros(len(mine.theta), dtype=np.int64)
            rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
            for batch in batches:
                for part in chunks(batch, "text", PART_BYTES):
                    k = Tokens(part.column("text"))
                    symbol, _, _ = symbols.of(k, 0)
                    one, two = before(k, symbol)
                    order = rng.permutation(len(symbol))
                    for lo in range(0, len(order), BATCH):
                        i = order[lo : lo + BATCH]
                        mine.step(one[i], two[i], symbol[i], rng, touched)
            rows = np.flatnonzero(touched)
            w = np.ceil(np.sqrt(touched[rows]))
            change = mine.theta[rows].astype(np.float64) - start.theta[rows]
            change = np.column_stack([change, np.log(mine.squares[rows].astype(np.float64) / start.squares[rows])])
            if not (np.abs(change) < 1e4).all():
                raise ValueError("the fit diverged")
            columns = np.rint(change * w[:, None] * _UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(w.astype(np.int64)), *map(pa.array, columns.T.copy())], names=["row", "n", *_COLUMNS])

        of_round = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn).select("text")
        schema = "row int, n long, " + ", ".join(f"{c} long" for c in _COLUMNS)
        mean = [(F.sum(c) / F.sum("n")).alias(c) for c in _COLUMNS]
        merged = of_round.mapInArrow(changes, schema).groupBy("row").agg(*mean).toArrow()  # one row for each of theta, at most
        rows = merged.column("row").to_numpy()
        change = np.stack([merged.column(c).to_numpy() for c in _COLUMNS], 1) / _UNIT
        model.theta[rows] += change[:, :-1].astype(np.float32)
        model.squares[rows] *= np.exp(change[:, -1]).astype(np.float32)
        shared.destroy()
    return Fitted(symbols, model, size, ends, n.tokens, n.types, counts)


_COLUMNS = [f"d{i}" for i in range(DIM + 1)] + ["squares"]


def score(doc: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of (doc_id, text, held_out)."""
    shared = doc.sparkSession.sparkContext.broadcast((fitted.symbols, fitted.model, fitted.size, fitted.ends))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, model, size, ends = shared.value
        inside = np.log10(size + 1)
        row_no = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, "text", PART_BYTES):
                k = Tokens(part.column("text"))
                symbol, count, common = symbols.of(k, ends)
                text = np.repeat(np.arange(len(k.size)), k.size)
                add = lambda w: np.bincount(text, w, len(k.size))
                tail = (symbol > 0) & (symbol < FIRST_WORD)
                s = model.log10(*before(k, symbol), symbol) - np.where(tail, inside[np.clip(symbol - 1, 0, TAILS - 1)], 0)
                logc = np.where(common, np.log10(count + 1), 0)
                rare = ~common
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(k.size)) + row_no), part.column("doc_id"), part.column("held_out"), pa.array(k.size, pa.int64()), pa.array(add(common & (count > 0)).astype(np.int64)),
                     pa.array(add(logc)), pa.array(add(s + np.where(tail, logc, 0))), list_array(k.token[rare].view(np.int64), add(rare).astype(np.int64), pa.int64())],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "logc", "s", "rare"],
                )
                row_no += len(k.size)

    rows = materialize(doc.mapInArrow(sums, "row long, doc_id long, held_out boolean, n_tokens long, known long, logc double, s double, rare array<long>"))
    rare = rows.select("row", F.explode("rare").alias("h"))
    found = rare.join(fitted.counts.select("h", F.log10(F.col("c") + 1).alias("l")), "h").groupBy("row").agg(F.sum("l").alias("more"), F.count("*").alias("k"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(fitted.tokens).cast("long").alias("train_tokens"),
        (F.col("logc") + more - F.col("n_tokens") * float(np.log10(fitted.tokens + fitted.types + 1))).alias("base_score"), (F.col("s") + more).alias("score"),
    )


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Fit on the rows outside the held fold and score every row."""
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.coalesce(fold(F.col("doc_id"), folds), F.lit(-1)) == held).alias("held_out"))
    return score(doc, fit(doc.where("not held_out and doc_id is not null")))
