"""Language of texts: a bidirectional gated recurrent network over bytes.

Texts (A-Z folded) are read as UTF-8 bytes in windows of STEPS bytes, MARGIN of them shared
with the window before and after, so that every byte is labelled with context on both sides
and a text of any length takes bounded memory. Two gated recurrent layers of HIDDEN units run
over a window, one from either end; at every byte both states give the probabilities of all
languages through one softmax. A document's probabilities are the mean over its bytes that
belong to letters (ASCII letters and all bytes beyond ASCII); the likeliest language
wins (ties: the first by code point) and its mean probability is the score.

The network is trained in numpy, in one task, by backpropagation through time over whole
windows, with the cross-entropy of every byte's label and Adam. It learns from a bounded
sample: about FIT_TEXTS distinct texts a language, chosen by hash out of all training rows,
and of each at most FIT_WINDOWS windows of FIT_STEPS bytes at places chosen by hash. The
sample is cut on the executors; its size depends only on the number of languages. The fit is
seeded and its rows are sorted, so reruns agree.

Defined results: `und` and score 0 for texts that are null, empty or without a letter, and for
all where no training row holds a language and a letter. With one language all others get it
with score 1. Null doc_id: neither held out nor trained on. Repeated rows are scored each, but
count once in the fit. A text's score does not depend on other rows. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, chunks, mix, text_bytes
from .toxicity import fold

STEPS, MARGIN, HIDDEN = 256, 8, 12
FIT_TEXTS, FIT_WINDOWS, FIT_STEPS = 400, 4, 64
EPOCHS, BATCH, RATE = 4, 128, 0.02
#: windows that a task runs side by side, and bytes of text that it cuts at a time
LANES, PART_BYTES = 1024, 1 << 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def bent(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the squashing function of states; its slope is (1 - |y|) squared."""
    x /= np.abs(x) + 1
    return x


def gate(x: np.ndarray) -> np.ndarray:
    """(1 + bent(x)) / 2 in place: between 0 and 1; its slope is 2 min(y, 1 - y) squared."""
    bent(x)
    x += 1
    x *= 0.5
    return x


class Layer:
    """One direction: a table by byte and recurrent weights for either gate (z, r) and the candidate (c).

    z, r = gate(table[byte] + h U); c = bent(table[byte] + (r h) U); h' = h + z (c - h).
    """

    def __init__(self, rng: np.random.Generator, hidden: int = HIDDEN):
        near = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.tables, self.inner = [near(256, hidden) for _ in "zrc"], [near(hidden, hidden) for _ in "zrc"]

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both gates, the candidate and the next state."""
        z, r, c = (np.take(t, byte, axis=0) for t in self.tables)
        z += h @ self.inner[0]
        r += h @ self.inner[1]
        c += (gate(r) * h) @ self.inner[2]
        new = bent(c) - h
        new *= gate(z)
        new += h
        return z, r, c, new

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each column of bytes (windows, steps), and what backward needs."""
        h = np.zeros((len(x), len(self.inner[0])), dtype=np.float32)
        states, kept = np.empty((x.shape[1], *h.shape), dtype=np.float32), []
        for t in range(x.shape[1]):
            z, r, c, new = self.step(x[:, t], h)
            kept.append((h, z, r, c))
            states[t] = h = new
        return states, kept

    def backward(self, x: np.ndarray, kept: list, out: np.ndarray) -> list[np.ndarray]:
        """Gradients of weights, given those of the states from above."""
        inner = [np.zeros_like(u) for u in self.inner]
        within = np.empty((3, *out.shape), np.float32)
        dh = np.zeros_like(out[0])
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, c = kept[t]
            dh = dh + out[t]
            dc = dh * z * (1 - np.abs(c)) ** 2
            drh = dc @ self.inner[2].T
            dz = dh * (c - h) * 2 * np.minimum(z, 1 - z) ** 2
            dr = drh * h * 2 * np.minimum(r, 1 - r) ** 2
            for k, (into, d) in enumerate(((h, dz), (h, dr), (r * h, dc))):
                inner[k] += into.T @ d
                within[k, t] = d
            dh = dh * (1 - z) + drh * r + dz @ self.inner[0].T + dr @ self.inner[1].T
        #: gradients of the tables: rows of one byte are added up after a sort by byte
        flat = x.T.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
        tables = [np.zeros_like(t) for t in self.tables]
        for table, d in zip(tables, within, strict=True):
            table[flat[order][first]] = np.add.reduceat(d.reshape(-1, d.shape[2])[order], first, axis=0)
        return [*tables, *inner]

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.inner]


class Network:
    """Both directions and the softmax over languages at every byte."""

    def __init__(self, languages: int, seed: int = 13, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Layer(rng, hidden), Layer(rng, hidden)
        self.out = (rng.standard_normal((2 * hidden, languages)) * 0.3).astype(np.float32)
        self.bias = np.zeros(languages, dtype=np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights, *self.back.weights, self.out, self.bias]

    def loss(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy a byte of windows (windows, steps), and its gradients in the order of weights."""
        turned = x[:, ::-1]
        f, kept_f = self.ahead.forward(x)
        b, kept_b = self.back.forward(turned)
        both = np.concatenate([f, b[::-1]], axis=2)
        p = softmax(both @ self.out + self.bias)
        n = x.size
        at = (np.arange(x.shape[1])[:, None], np.arange(len(x))[None], label[None])
        value = float(-np.log(p[at] + 1e-12).mean())
        p[at] -= 1
        p /= n
        flat = p.reshape(-1, p.shape[2])
        up = p @ self.out.T
        k = f.shape[2]
        grads = self.ahead.backward(x, kept_f, up[:, :, :k]) + self.back.backward(turned, kept_b, up[::-1, :, k:])
        return value, [*grads, both.reshape(-1, 2 * k).T @ flat, flat.sum(axis=0)]

    def probabilities(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(t, windows still open at t, their probabilities there) of windows data[start:end], longest first."""
        size = end - start
        k = len(self.ahead.inner[0])
        steps = int(size[0])
        live = np.searchsorted(-size, -np.arange(steps), "left")  # windows longer than t
        states = np.empty((steps, len(size), k), dtype=np.float32)
        h = np.zeros((len(size), k), dtype=np.float32)
        for t in range(steps):
            n = live[t]
            states[t, :n] = h = self.ahead.step(data[start[:n] + t], h[:n])[-1]
        h = np.zeros((len(size), k), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            h[:n] = self.back.step(data[start[:n] + t], h[:n])[-1]
            yield t, n, softmax(states[t, :n] @ self.out[:k] + h[:n] @ self.out[k:] + self.bias)


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def train(windows: np.ndarray, label: np.ndarray, languages: int, epochs: int = EPOCHS, seed: int = 13) -> Network:
    """Adam over shuffled batches; the rate falls to nothing along a cosine."""
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    mean = [np.zeros_like(w) for w in net.weights]
    square = [np.zeros_like(w) for w in net.weights]
    batches = -(-len(windows) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), BATCH):
            i = order[lo : lo + BATCH]
            _, grads = net.loss(windows[i], label[i])
            length = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / (epochs * batches + 1)))
            for w, g, m, q in zip(net.weights, grads, mean, square, strict=True):
                g = g / max(1.0, length)
                m += 0.1 * (g - m)
                q += 0.01 * (g * g - q)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


# ---------------------------------------------------------------- sample
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most FIT_WINDOWS windows of a text, at hashed places; short texts are filled up with spaces."""
    for batch in batches:
        for part in chunks(batch, "text", PART_BYTES):
            data, at = text_bytes(part.column("text"))
            data = _LOWER[data]
            out = []
            for j, (lang, h) in enumerate(zip(part.column("lang").to_pylist(), part.column("h").to_pylist(), strict=True)):
                size = int(at[j + 1] - at[j])
                room = max(size - FIT_STEPS, 0) + 1
                n = min(FIT_WINDOWS, -(-size // FIT_STEPS))
                place = mix(np.array([h], np.int64).view(np.uint64) + np.arange(n, dtype=np.uint64)) % np.uint64(room)
                for p in sorted(set(place.tolist())):
                    out.append((lang, h, data[at[j] + p : min(at[j] + p + FIT_STEPS, at[j + 1])].tobytes().ljust(FIT_STEPS)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["lang", "h", "window"])


def sample(known: DataFrame) -> DataFrame:
    """(lang, h, window) of about FIT_TEXTS distinct texts a language, out of all training rows (lang, text)."""
    rows = known.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    share = rows.groupBy("lang").agg((F.lit(float(FIT_TEXTS)) / F.approx_count_distinct("h")).alias("share"))  # a row a language
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("h", F.lit(13)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    return chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).mapInArrow(_windows, "lang string, h long, window binary")


def fit(known: DataFrame) -> tuple[list[str], Network | None]:
    """Languages in order of their code points, and the network that tells them apart; trained in one task on the sample."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "window")), strict=True))
        languages = sorted({r[0] for r in rows})
        if languages:
            windows = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(-1, FIT_STEPS)
            net = train(windows, np.array([languages.index(r[0]) for r in rows]), len(languages))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((languages, net))], pa.binary())], names=["fitted"])

    got = sample(known).repartition(1).mapInArrow(learn, "fitted binary").collect()  # one row, or none
    return pickle.loads(bytes(got[0].fitted)) if got else ([], None)


# ---------------------------------------------------------------- labels
def cut(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts with offsets at: their text, start and end, and the part that is their own to label."""
    size = np.diff(at)
    step = STEPS - 2 * MARGIN
    n = -(-size // step)
    text = np.repeat(np.arange(len(size)), n)
    mine = at[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    until = np.minimum(mine + step, at[text + 1])
    return text, np.maximum(mine - MARGIN, at[text]), np.minimum(until + MARGIN, at[text + 1]), mine, until


def pooled(net: Network, languages: int, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the probabilities over the letters of every text."""
    text, start, end, mine, until = cut(at)
    counts = _LETTER[data]
    data = _LOWER[data].astype(np.intp)
    total = np.zeros((len(at) - 1, languages))
    order = np.argsort(start - end, kind="stable")
    for lo in range(0, len(order), LANES):
        i = order[lo : lo + LANES]
        own = np.zeros((len(i), languages), dtype=np.float32)
        for t, n, p in net.probabilities(data, start[i], end[i]):
            where = start[i[:n]] + t
            p *= (counts[where] & (where >= mine[i[:n]]) & (where < until[i[:n]]))[:, None]
            own[:n] += p
        np.add.at(total, text[i], own)
    return total


def predict(docs: DataFrame, languages: list[str], net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of (doc_id, text, held_out, lettered)."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, net))

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, net = shared.value
        for batch in batches:
            for part in chunks(batch, "text", PART_BYTES):
                data, at = text_bytes(part.column("text"))
                total = pooled(net, len(names), data, at) if net else np.zeros((part.num_rows, 1))
                letters = part.column("lettered").to_numpy(zero_copy_only=False) & (total.sum(axis=1) > 0)
                best = total.argmax(axis=1)
                score = np.where(letters, total[np.arange(len(best)), best] / np.maximum(total.sum(axis=1), 1e-30), 0.0)
                pred = [names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(labels, "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows outside the held fold and label every row."""
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (F.coalesce(fold(F.col("doc_id"), folds), F.lit(-1)) == held).alias("held_out"))
    languages, net = fit(doc.where("not held_out and doc_id is not null").select("lang", "text"))
    return predict(doc.select("doc_id", "text", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")), languages, net)
