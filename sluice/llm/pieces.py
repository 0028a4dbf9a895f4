"""SentencePiece encoding and decoding with Gumbel top-k sampled segmentations.

The vocabulary of a SentencePiece model (its path is a parameter) spans a lattice over each
text: the dummy prefix space is added, a space is the piece mark, characters outside the
vocabulary are bytes. A path's weight is the product of its pieces' probabilities, Zipf's
law over their ranks in the model. Texts fall into spans (a run of spaces with what
follows it; line breaks and tabs alone) that no piece crosses, so the lattice of a text is
the chain of its spans' lattices, and equal spans are built once a chunk.

Sampling without replacement: every path has a Gumbel-perturbed log-probability, and the k
largest are wanted. Backward sums give every set of paths that shares a prefix its mass, so
the maximum of a set is drawn from the set's own Gumbel, truncated at its parent's. An
A-star search keeps the sets in a queue by these maxima: the best set yields its best path,
and splits into the sets that leave this path at each of its pieces. The maxima are exact
bounds, so the paths come in order and are distinct. kappa, the bound of the set that would
come next, gives each path its inclusion score 1 - exp(-exp(log p - kappa)).

All draws are hashes of seed, row key, sample, place: runs agree whatever the batches.

Defined results: null and empty texts have the one empty segmentation; a text with fewer
than k segmentations yields them all, with inclusion 1; a null key counts as 0; repeated
rows agree; whole texts are encoded, in chunks, a longer one alone; extra columns pass
through ``encode``; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, list_array, mix, prefix_hash, span_hash, text_bytes, uniform

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
ZIPF_SHIFT = 50.0
#: most nodes of kept lattices in a task: some 40 MB with their edges
KEEP = 400_000
#: bytes of text whose segmentations are sampled together
CHUNK = 1 << 18
#: no draw of `uniform` gives a standard Gumbel above this
HIGHEST = 38.0
_BITS = 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)]


_INT = [int(x) for x in _C]
_MASK = (1 << 64) - 1


def _mix_int(x: int) -> int:
    """``mix`` of one number."""
    x &= _MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.raw = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int64)
        usable = []
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:-1], 16)
                self.raw[i], self.byte_id[value] = bytes([value]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = sp.id_to_piece(i).replace("▁", " ").encode()
                usable.append(i)
        rank = np.array([-sp.get_score(i) for i in usable])
        weight = 1 / (ZIPF_SHIFT + rank)
        self.byte_log = float(np.log(1 / (ZIPF_SHIFT + n) / (weight.sum() + 256 / (ZIPF_SHIFT + n))))
        log_p = np.log(weight / (weight.sum() + 256 / (ZIPF_SHIFT + n)))
        flat = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.length = np.array([len(x) for x in self.raw])
        self.begin = np.cumsum(self.length) - self.length
        self.flat = flat
        use = np.array(usable)
        key = span_hash(prefix_hash(flat), self.begin[use], self.begin[use] + self.length[use])
        order = np.argsort(key)
        self.key, self.id, self.log_p = key[order], use[order], log_p[order]
        #: by leading bits of a hash: where its keys begin, and whether there are any
        bucket = (self.key >> np.uint64(64 - _BITS)).astype(np.int64)
        self.slot = np.searchsorted(bucket, np.arange(1 << _BITS)).astype(np.int32)
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[bucket] = True
        self.depth = int(np.bincount(bucket).max())
        self.lengths = sorted({int(x) for x in self.length[use]})
        long_bytes = {b for i in usable if len(self.raw[i]) > 1 for b in self.raw[i]}
        self.alone = np.zeros(256, dtype=bool)
        self.alone[[b for b in (9, 10, 13) if b not in long_bytes]] = True
        #: spans start at spaces only if no piece has a space after another character
        self.spans = not any(b" " in self.raw[i].lstrip(b" ") for i in usable)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Lattices of distinct spans, end to end: a span of n bytes has n + 1 nodes.

    Edges are sorted by source, longest first (as integers, so that all runs agree): dst, ids (-1: bytes of a character), p and
    cum (conditional probability and its running sum), log (its logarithm).
    """

    def __init__(self, v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        offset = np.cumsum(size) - size
        kind = np.repeat(np.arange(len(size)), size)
        self.data = tb = data[np.arange(int(size.sum())) + np.repeat(start - offset, size)]
        stop = np.repeat(offset + size, size)
        self.first_node = offset + np.arange(len(size))
        self.last_node = self.first_node + size
        nodes = len(tb) + len(size)
        chars = np.flatnonzero((tb & 0xC0) != 0x80)
        h = prefix_hash(tb)
        src, length, ids, logs = [], [], [], []
        wide = chars
        room = stop[chars] - chars
        for n in v.lengths:
            fits = room >= n
            wide, room = wide[fits], room[fits]
            if not len(wide):
                break
            at = wide
            key = span_hash(h, at, at + n)
            bucket = (key >> np.uint64(64 - _BITS)).astype(np.int64)
            may = np.flatnonzero(v.filter[bucket])
            at, key, slot = at[may], key[may], v.slot[bucket[may]]
            for _ in range(v.depth - 1):
                slot = np.where(v.key[slot] < key, np.minimum(slot + 1, len(v.key) - 1), slot)
            hit = v.key[slot] == key
            at, slot = at[hit], slot[hit]
            src.append(at)
            length.append(np.full(len(at), n))
            ids.append(v.id[slot])
            logs.append(v.log_p[slot])
        width = np.diff(np.append(chars, len(tb)))
        single = np.zeros(len(tb), dtype=bool)
        of_char = np.zeros(len(tb), dtype=np.int64)
        of_char[chars] = width
        for a, n in zip(src, length, strict=True):
            single[a[of_char[a] == n]] = True
        bare = chars[~single[chars]]
        src.append(bare)
        length.append(of_char[bare])
        ids.append(np.full(len(bare), -1))
        logs.append(of_char[bare] * v.byte_log)
        src, length, ids, logs = (np.concatenate(x) for x in (src, length, ids, logs))
        pos = src
        src = src + kind[src]
        dst = src + length
        left = self.last_node[kind[pos]] - src
        order = np.argsort(left * nodes + src)
        src, dst, ids, logs, left = (x[order] for x in (src, dst, ids, logs, left))
        beta = np.full(nodes, -np.inf)
        beta[self.last_node] = 0.0
        cut = np.flatnonzero(np.diff(left, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(left)], strict=True):
            value = logs[a:b] + beta[dst[a:b]]
            group = np.flatnonzero(np.diff(src[a:b], prepend=-1))
            top = np.maximum.reduceat(value, group)
            top = np.where(np.isfinite(top), top, 0.0)
            count = np.diff(np.append(group, b - a))
            with np.errstate(divide="ignore"):
                beta[src[a:b][group]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), group))
        with np.errstate(invalid="ignore"):
            log = logs + beta[dst] - beta[src]
        log = np.where(np.isfinite(log), log, -np.inf)
        order = np.lexsort((src - dst, src))
        self.src, self.dst, self.ids = (x[order].astype(np.int32) for x in (src, dst, ids))
        self.log = log[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.src, minlength=nodes))])
        total = np.concatenate([[0.0], np.cumsum(np.exp(self.log))])
        self.cum = total[1:] - total[self.begin[self.src]]

    def walk(self, kinds: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One path through each of many spans: (edges end to end, number per span)."""
        n = len(kinds)
        node, goal = self.first_node[kinds], self.last_node[kinds]
        live = np.arange(n)
        count = np.zeros(n, dtype=np.int64)
        steps = []
        step = 0
        while len(live):
            u = uniform(base[live] + np.uint64(int(_C[3]) * (step + 1) % 2**64))
            e, last = self.begin[node], self.begin[node + 1] - 1
            more = np.flatnonzero((u > self.cum[e]) & (e < last))
            while len(more):
                e[more] += 1
                more = more[(u[more] > self.cum[e[more]]) & (e[more] < last[more])]
            steps.append((live, e))
            node = self.dst[e]
            count[live] += 1
            on = node != goal[live]
            live, node = live[on], node[on]
            step += 1
        out = np.zeros(int(count.sum()), dtype=np.int64)
        first = np.cumsum(count) - count
        for k, (who, e) in enumerate(steps):
            out[first[who] + k] = e
        return out, count


class Store(Lattice):
    """Lattices end to end in buffers that grow in place: what is kept, then one chunk's."""

    PARTS = (("data", np.uint8, 0), ("first_node", np.int64, 0), ("last_node", np.int64, 0), ("src", np.int32, 0), ("dst", np.int32, 0), ("ids", np.int32, 0), ("log", np.float64, 0), ("cum", np.float64, 0), ("begin", np.int64, 1))

    def __init__(self):
        self.buffers = {name: np.zeros(extra, dtype=kind) for name, kind, extra in self.PARTS}
        self.cut({name: extra for name, _, extra in self.PARTS})

    def sizes(self) -> dict[str, int]:
        return {name: len(getattr(self, name)) for name, _, _ in self.PARTS}

    def cut(self, sizes: dict[str, int]) -> None:
        """Keep the first entries of every part; what came later is given up."""
        for name, n in sizes.items():
            setattr(self, name, self.buffers[name][:n])

    def append(self, other: Lattice) -> None:
        nodes, edges = len(self.begin) - 1, len(self.src)
        shift = {"first_node": nodes, "last_node": nodes, "src": nodes, "dst": nodes, "begin": edges}
        for name, kind, extra in self.PARTS:
            more, n = getattr(other, name)[extra:], len(getattr(self, name))
            if n + len(more) > len(self.buffers[name]):
                grown = np.empty(n + len(more) + n // 4, dtype=kind)
                grown[:n] = self.buffers[name][:n]
                self.buffers[name] = grown
            np.add(more, shift.get(name, 0), out=self.buffers[name][n : n + len(more)], casting="same_kind") if name in shift else np.copyto(self.buffers[name][n : n + len(more)], more)
            setattr(self, name, self.buffers[name][: n + len(more)])


class Spans:
    """Lattices of the spans that a task has met, kept up to KEEP nodes.

    Beyond that a chunk's new spans stand behind the kept ones for that chunk alone.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.hash, self.place, self.lattice = v, np.zeros(0, np.uint64), np.zeros(0, np.int64), Store()
        self.kept = self.lattice.sizes()

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, Lattice]:
        """(number of each span in the lattice, the lattice); the lattice holds until the next call."""
        self.lattice.cut(self.kept)
        distinct, one, which = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, distinct), max(0, len(self.hash) - 1))
        known = self.hash[at] == distinct if len(self.hash) else np.zeros(len(distinct), dtype=bool)
        number = np.zeros(len(distinct), dtype=np.int64)
        if known.any():
            number[known] = self.place[at[known]]
        new = one[~known]
        number[~known] = len(self.lattice.first_node) + np.arange(len(new))
        if len(new):
            self.lattice.append(Lattice(self.v, data, start[new], end[new]))
            if len(self.lattice.begin) <= KEEP:
                self.kept = self.lattice.sizes()
                h, p = np.concatenate([self.hash, distinct[~known]]), np.concatenate([self.place, number[~known]])
                order = np.argsort(h)
                self.hash, self.place = h[order], p[order]
        return number[which], self.lattice


def gumbel(u: float) -> float:
    return -math.log(-math.log(u))


class Sampler:
    """Top-k paths of the texts of one chunk."""

    def __init__(self, v: Vocabulary, column: pa.Array, keys: np.ndarray, k: int, spans: Spans | None = None):
        self.v, self.k = v, k
        spans = spans or Spans(v)
        raw, at = text_bytes(column)
        size = np.diff(at)
        full = size > 0
        #: every text that isn't empty gets the dummy prefix
        self.at = np.concatenate([[0], np.cumsum(size + full)])
        data = np.full(int(self.at[-1]), 32, dtype=np.uint8)
        row = np.repeat(np.arange(len(size)), size)
        data[np.arange(len(raw)) + np.cumsum(full)[row]] = raw
        self.data, self.raw, self.raw_at = data, raw, at
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[self.at[:-1]] = True
        if v.spans and len(data):
            space, alone = data == 32, v.alone[data]
            begins[1:-1] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        begins = begins[: len(data)]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data)) if len(start) else start
        self.first = np.searchsorted(start, self.at)
        if len(start):
            key = span_hash(prefix_hash(data), start, end)
            self.kinds, self.lattice = spans.of(data, start, end, key)
            self.opens = np.zeros(len(self.lattice.begin), dtype=bool)
            self.opens[self.lattice.first_node] = True
        text = np.repeat(np.arange(len(size)), np.diff(self.first))
        self.keys = mix(keys)
        self.int_keys = self.keys.tolist()
        place = np.arange(len(start)) - self.first[text]
        self.base = self.keys[text] + _C[1] * place.astype(np.uint64)

    def _draw(self, row: int, *places: int) -> float:
        x = self.int_keys[row]
        for c, p in zip(_INT, places, strict=False):
            x = _mix_int(x + c * (p + 1))
        return ((_mix_int(x) >> 11) + 0.5) * 2.0**-53

    def _fresh(self, sample: int) -> tuple[np.ndarray, np.ndarray]:
        return self.lattice.walk(self.kinds, self.base + np.uint64(int(_C[0]) * (sample + 1) % 2**64))

    def sample(self) -> list[list[tuple[np.ndarray, float, float]]]:
        """For every text its paths (edges, log probability, inclusion), best first."""
        n = len(self.at) - 1
        out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in range(n)]
        if not len(self.data):
            return [[(np.zeros(0, np.int64), 0.0, 1.0)] for _ in range(n)]
        runs = []
        for s in range(self.k):
            edges, count = self._fresh(s)
            runs.append((edges, np.concatenate([[0], np.cumsum(count)])))
        old = np.seterr(over="ignore")
        for row in range(n):
            a, b = int(self.first[row]), int(self.first[row + 1])
            out[row] = self._text(row, a, b, runs) if b > a else [(np.zeros(0, np.int64), 0.0, 1.0)]
        np.seterr(**old)
        return out

    def _leave(self, row: int, s: int, path: np.ndarray, since: int, bound: float, spent: float, queue: list, needed: int) -> None:
        """Queue the sets that leave a path at its pieces from since on (mass before: spent).

        Only the best ``needed`` of them can ever be taken. The search along the path ends
        where no set further on can beat those.
        """
        seed = mix(self.keys[row] + _C[0] * np.uint64(s + 1))
        kept: list[tuple[float, int, float]] = []
        for lo in range(since, len(path), 512):
            part = path[lo : lo + 512]
            after = spent + np.cumsum(self.lattice.log[part])
            before = np.concatenate([[spent], after[:-1]])
            rest = -np.expm1(self.lattice.log[part])
            with np.errstate(divide="ignore"):
                loc = before + np.log(np.where(rest > 1e-13, rest, 0.0))
            u = uniform(seed + _C[2] * np.arange(lo + 1, lo + len(part) + 1, dtype=np.uint64))
            g = -np.logaddexp(-bound, np.log(-np.log(u)) - loc)
            for i in np.argpartition(-g, min(needed, len(g)) - 1)[:needed].tolist():
                if loc[i] > -np.inf:
                    kept.append((float(g[i]), lo + i, float(before[i])))
            kept = heapq.nlargest(needed, kept)
            spent = float(after[-1])
            if len(kept) == needed and spent + HIGHEST < kept[-1][0]:
                break
        for g, at, before in kept:
            heapq.heappush(queue, (-g, s, at, (int(path[at]),), before))

    def _text(self, row: int, a: int, b: int, runs: list) -> list[tuple[np.ndarray, float, float]]:
        lat, k = self.lattice, self.k
        edges, ptr = runs[0]
        paths = [edges[ptr[a] : ptr[b]]]
        best = [gumbel(self._draw(row, 0, 0))]
        queue: list = []
        self._leave(row, 0, paths[0], 0, best[0], 0.0, queue, k)
        while queue and len(paths) < k:
            top, parent, at, used, before = heapq.heappop(queue)
            bound, s = -top, len(paths)
            old = paths[parent]
            node = int(lat.src[old[at]])
            lo, hi = int(lat.begin[node]), int(lat.begin[node + 1])
            free = [e for e in range(lo, hi) if e not in used and lat.log[e] > -math.inf]
            weights = [math.exp(lat.log[e]) for e in free]
            mass = sum(weights)
            if mass <= 0:
                continue
            u, pick = self._draw(row, s, at, 1) * mass, len(free) - 1
            for i, w in enumerate(weights):
                if u <= w:
                    pick = i
                    break
                u -= w
            head, tail = [free[pick]], int(lat.dst[free[pick]])
            #: the rest of this span, piece by piece, then the sample's own run of later spans
            kind = int(np.searchsorted(lat.first_node, node, "right")) - 1
            while tail != lat.last_node[kind]:
                u, e = self._draw(row, s, at + len(head), 2), int(lat.begin[tail])
                while u > lat.cum[e] and e < lat.begin[tail + 1] - 1:
                    e += 1
                head.append(e)
                tail = int(lat.dst[e])
            #: spans that begin at or before this piece
            spans = a + int(self.opens[lat.src[old[: at + 1]]].sum())
            edges, ptr = runs[s]
            path = np.concatenate([old[:at], head, edges[ptr[spans] : ptr[b]]])
            paths.append(path)
            best.append(bound)
            rest = mass - weights[pick]
            if rest > 1e-13 and len(free) > 1:
                loc = before + math.log(rest)
                g = -float(np.logaddexp(-bound, math.log(-math.log(self._draw(row, s, at, 3))) - loc))
                heapq.heappush(queue, (-g, parent, at, (*used, free[pick]), before))
            self._leave(row, s, path, at + 1, bound, before + float(lat.log[free[pick]]), queue, k - len(paths) + 1)
        kappa = -queue[0][0] if queue else -math.inf
        logs = [float(lat.log[p].sum()) for p in paths]
        return [(p, x, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(x - kappa, 700.0)))) for p, x in zip(paths, logs, strict=True)]

    def ids(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of paths, end to end, and their numbers."""
        lat = self.lattice if len(self.data) else None
        size = np.array([len(p) for p in paths], dtype=np.int64)
        if lat is None or not size.sum():
            return np.zeros(0, np.int64), size
        e = np.concatenate(paths)
        ids = lat.ids[e]
        width = np.where(ids < 0, lat.dst[e] - lat.src[e], 1)
        rep = np.repeat(np.arange(len(e)), width)
        out = ids[rep]
        byte = out < 0
        if byte.any():
            step = np.arange(len(rep)) - (np.cumsum(width) - width)[rep]
            src = lat.src[e[rep[byte]]]
            kind = np.searchsorted(lat.first_node, src, "right") - 1
            out[byte] = self.v.byte_id[lat.data[src - kind + step[byte]]]
        owner = np.repeat(np.arange(len(size)), size)
        return out, np.bincount(owner, width, len(size)).astype(np.int64)


def decode_ids(v: Vocabulary, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of id lists, without the dummy prefix: (bytes, lengths)."""
    width = v.length[ids]
    at = np.repeat(v.begin[ids] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    data = v.flat[at]
    owner = np.repeat(np.arange(len(size)), size)
    length = np.bincount(owner, width, len(size)).astype(np.int64)
    first = np.cumsum(length) - length
    drop = first[(length > 0)]
    drop = drop[data[drop] == 32]
    keep = np.ones(len(data), dtype=bool)
    keep[drop] = False
    who = np.repeat(np.arange(len(size)), length)
    return data[keep], length - np.bincount(who[~keep], minlength=len(size))


def _encoder(model: str, k: int, seed: int, key: str, lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        spans = Spans(v)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                keys = part.column(key).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                sampler = Sampler(v, part.column("text"), mix(keys.view(np.uint64) + np.uint64(seed % 2**64)), k, spans)
                found = sampler.sample()
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                every = [x for f in found for x in f]
                ids, size = sampler.ids([x[0] for x in every])
                data, length = decode_ids(v, ids, size)
                same = _equal(data, length, sampler.raw, np.diff(sampler.raw_at), row)
                rank = np.concatenate([np.arange(1, len(f) + 1) for f in found])
                cells = [part.column(c).take(pa.array(row)) for c in part.schema.names if lists or c != "text"]
                first = np.cumsum(size) - size
                mixed = mix(ids.astype(np.uint64) + _C[0] * (np.arange(len(ids)) - np.repeat(first, size)).astype(np.uint64))
                total = np.zeros(len(size), dtype=np.uint64)
                np.add.at(total, np.repeat(np.arange(len(size)), size), mixed)
                names = [c for c in part.schema.names if lists or c != "text"]
                extra = [pa.array(rank, pa.int32()), pa.array(size), pa.array([x[1] for x in every]), pa.array([x[2] for x in every]), pa.array(same), pa.array(total.view(np.int64))]
                names += ["rank", "n_pieces", "log_prob", "inclusion", "decoded", "ids_hash"]
                if lists:
                    extra.append(list_array(ids.astype(np.int32), size, pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([*cells, *extra], names=names)

    return run


def _equal(data: np.ndarray, length: np.ndarray, raw: np.ndarray, raw_length: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each decoded text is the text of its row."""
    begin = (np.cumsum(raw_length) - raw_length)[row].tolist()
    first = (np.cumsum(length) - length).tolist()
    size = length.tolist()
    same = (length == raw_length[row]).tolist()
    data, raw = memoryview(np.ascontiguousarray(data)), memoryview(np.ascontiguousarray(raw))
    return np.array([ok and data[a : a + n] == raw[b : b + n] for ok, a, b, n in zip(same, first, begin, size, strict=True)], dtype=bool)


RESULT = "rank int, n_pieces long, log_prob double, inclusion double, decoded boolean, ids_hash long"


def encode(docs: DataFrame, k: int = K, seed: int = 0, model: str = MODEL, key: str = "doc_id") -> DataFrame:
    """A row per document and sampled segmentation: its columns, rank, log_prob, inclusion, ids.
    Columns of docs with the names of the result's own are replaced."""
    taken = {"rank", "n_pieces", "log_prob", "inclusion", "decoded", "ids_hash", "ids"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_encoder(model, k, seed, key, True), f"{fields}, {RESULT}, ids array<int>")


def encode_report(docs: DataFrame, k: int = K, seed: int = 0, model: str = MODEL) -> DataFrame:
    """doc_id, rank, n_pieces, log_prob, inclusion, decoded (exact round trip), ids_hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(model, k, seed, "doc_id", False), f"doc_id long, {RESULT}")


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL, into: str = "decoded_text") -> DataFrame:
    """df with the texts of its id lists; ids outside the vocabulary and nulls are skipped."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            lists = [[i for i in x or () if i is not None and 0 <= i < len(v.raw)] for x in batch.column(ids).to_pylist()]
            size = np.array([len(x) for x in lists], dtype=np.int64)
            data, length = decode_ids(v, np.array([i for x in lists for i in x], dtype=np.int64), size)
            at = np.concatenate([[0], np.cumsum(length)])
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return df.mapInArrow(run, f"{fields}, `{into}` string")
