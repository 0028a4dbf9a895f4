"""MinHash near-duplicate documents with tensored banding.

A document's set holds its distinct 5-word shingles (ASCII-lowered words; fewer words:
the whole sequence as one; no words: empty, linked with nothing). Documents are linked
when 100 * |intersection| >= 75 * |union|.

Tensored banding: two collections, A and B, hold SIDE short hashes each (ROWS minhashes
a hash). The SIDE * SIDE table keys are the pairs (A_i, B_j), so 2 * SIDE * ROWS minhashes
serve SIDE**2 tables of 2 * ROWS minhashes each. At similarity 0.75 a pair misses every
key with probability below 2e-4 (12 a side, 2 rows).

1. Equal sets are one class (128-bit set hash); only its least doc_id goes on.
2. A class goes on if some A_i and some B_j of it occur elsewhere; its keys are made.
3. Classes that share a key are candidates. A class more than a quarter of whose
   shingles occur in no other candidate cannot reach 0.75 with any: it is set aside.
4. Each bucket has a leader (first the class with least own shingles, then by hash).
   A class is first checked on full sets against the best leader of its buckets, then,
   where components still differ, against all of them; links are joined by union-find.
   Pairs inside a component need no check. What is left, pairs of one bucket in different
   components whose sizes and shared parts allow 0.75, is checked pair by pair.
   Before sets are compared, parities of the hashed items (``parity_sketch``) bound the
   difference of the two sets from below: a pair that cannot reach 0.75 is left out.

Nothing is capped: a large bucket costs its size in each leader round.

Defined results: null or empty text has an empty set; a null doc_id is never linked and
keeps its row; repeated rows fall in one class; rows of one doc_id with
different texts are one node of the graph; extra columns pass through ``near_dedup``; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, connected_components, list_array, materialize, mix, release, semi

SHINGLE, PERCENT = 5, 75
SIDE, ROWS = 12, 2
LEADER_ROUNDS = 2
#: pairs whose full sets one task compares, where few are left
VERIFIED_ROWS = 5_000
PARITY_BITS = 1024
_rng = np.random.default_rng(77)
_MULT = _rng.integers(1, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)
_STEP = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): the sorted distinct shingle hashes of every text, end to end."""
    w = Words(column)
    n = np.diff(w.first)
    m = len(w.hash)
    rolled = np.zeros(max(0, m - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        rolled += w.hash[k : m - SHINGLE + 1 + k] * _STEP[k]
    rolled = mix(rolled)
    parts, sizes = [], np.zeros(len(n), dtype=np.int64)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b - a >= SHINGLE:
            got = np.unique(rolled[a : b - SHINGLE + 1])
        elif b > a:
            got = mix((w.hash[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            continue
        parts.append(got)
        sizes[i] = len(got)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def minhash(hashes: np.ndarray, sizes: np.ndarray, mult: np.ndarray, add: np.ndarray, rows: int) -> np.ndarray:
    """Short hashes (rows minhashes each) of the non-empty sets: one row a set."""
    at = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]]).astype(np.int64)
    if not (sizes > 0).any():
        return np.zeros((0, len(mult) // rows), dtype=np.uint64)
    least = np.stack([np.minimum.reduceat(hashes * a + b, at) for a, b in zip(mult, add, strict=True)], 1)
    least = mix(least.reshape(len(at), -1, rows) + np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = least.sum(2, dtype=np.uint64)
    return mix(least + np.arange(least.shape[1], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            hashes, sizes = shingle_sets(part.column("text"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            h1 = np.zeros(len(sizes), dtype=np.uint64)
            h2 = np.zeros(len(sizes), dtype=np.uint64)
            np.add.at(h1, row, hashes)
            np.add.at(h2, row, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
            short = minhash(hashes, sizes, _MULT, _ADD, ROWS)
            width = np.where(sizes > 0, SIDE, 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(mix(h1).view(np.int64)), pa.array(mix(h2).view(np.int64)),
                 list_array(short[:, :SIDE].ravel().view(np.int64), width, pa.int64()), list_array(short[:, SIDE:].ravel().view(np.int64), width, pa.int64())],
                names=["doc_id", "n", "h1", "h2", "a", "b"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            hashes, sizes = shingle_sets(part.column("text"))
            total = np.zeros(len(sizes), dtype=np.uint64)
            np.add.at(total, np.repeat(np.arange(len(sizes)), sizes), hashes)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total.view(np.int64)), pa.array(sizes), parity_sketch(hashes, sizes), list_array(hashes.view(np.int64), sizes, pa.int64())], names=["id", "h", "n", "odd", "body"])


def parity_sketch(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Per set, PARITY_BITS bits: whether an odd number of its items fall on the bit.

    Two sets differ in at least as many items as their sketches differ in bits.
    """
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    parts = [np.zeros(0, dtype=np.int64)]
    for first in range(0, len(sizes), 1024):
        last = min(first + 1024, len(sizes))
        row = np.repeat(np.arange(last - first), sizes[first:last])
        bit = (hashes[at[first] : at[last]] % np.uint64(PARITY_BITS)).astype(np.int64)
        count = np.bincount(row * PARITY_BITS + bit, minlength=(last - first) * PARITY_BITS)
        parts.append(np.packbits((count & 1).astype(np.uint8)).view(np.int64))
    return list_array(np.concatenate(parts), np.full(len(sizes), PARITY_BITS // 64), pa.int64())


def may_link(n1: Column, odd1: Column, n2: Column, odd2: Column) -> Column:
    """False only for sets whose sizes and sketches keep them below the similarity."""
    bits = [F.bit_count(odd1[i].bitwiseXOR(odd2[i])) for i in range(PARITY_BITS // 64)]
    apart = F.greatest(sum(bits[1:], bits[0]), F.abs(n1 - n2))
    return apart * (100 + PERCENT) <= (n1 + n2) * (100 - PERCENT)


def overlap(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Sizes of the intersections of sorted distinct lists, row by row."""
    n = len(left)
    values, rows = [], []
    for side in (left, right):
        values.append(side.flatten().to_numpy(zero_copy_only=False))
        rows.append(np.repeat(np.arange(n), side.value_lengths().to_numpy(zero_copy_only=False)))
    v, r = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    same = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[1:][same], minlength=n)


def _linked(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, body, other), bodies being sets of items, that reach the similarity."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            both = overlap(part.column("body"), part.column("other"))
            sizes = sum(part.column(c).value_lengths().to_numpy(zero_copy_only=False) for c in ("body", "other"))
            ok = pa.array(100 * both >= percent * (sizes - both))
            yield part.select(["x", "y"]).filter(ok)


def verified(pairs: DataFrame, sets: DataFrame, linked=_linked) -> DataFrame:
    """Those of the pairs (x, y) whose sets (id, n, odd, body) reach the similarity."""
    one, two = (sets.select(F.col("id").alias(k), F.col("n").alias("n" + k), F.col("odd").alias("odd" + k)) for k in "xy")
    able = pairs.join(one, "x").join(two, "y").where(may_link(F.col("nx"), F.col("oddx"), F.col("ny"), F.col("oddy"))).select("x", "y")
    j = able.join(sets.select(F.col("id").alias("x"), "body"), "x").join(sets.select(F.col("id").alias("y"), F.col("body").alias("other")), "y")
    return j.select("x", "y", "body", "other").mapInArrow(linked, "x long, y long")


def cluster(buckets: DataFrame, sets: DataFrame, linked=_linked, own: DataFrame | None = None) -> DataFrame:
    """(node, component) of all linked ids. buckets: (key, id), sets: (id, n, odd, body).

    Step 4 of the module's text; own (id, own) has numbers of items that no other set holds.
    """
    able = sets.select("id", "n")
    if own is None:
        able = able.withColumn("own", F.lit(0))
    else:
        able = able.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(f"100 * (n - own) >= {PERCENT} * n")
    able = materialize(able)
    size = buckets.count()
    live = materialize(buckets.join(able, "id").select("key", "id", "n", "own"), size)
    links, done, labels = None, None, None
    for r in range(LEADER_ROUNDS):
        at = _apart(live, labels, size)
        rank = F.struct((F.col("own") / F.col("n")).alias("r"), "id", "c") if not r else F.struct(F.xxhash64(F.lit(r), "id").alias("r"), "id", "c")
        lead = at.groupBy("key").agg(F.min(rank).alias("lead")).select("key", "lead")
        if not r:  # a large group has a leader in each of its buckets: one check a class first
            pairs = at.join(lead, "key").where("c <> lead.c").groupBy("id").agg(F.min("lead").alias("lead")).select("id", F.col("lead.id").alias("other"))
        else:
            far = lead.select("key", F.col("lead.id").alias("id"), F.col("lead.c").alias("cl")).join(sets.select("id", "n", "odd"), "id").select("key", "cl", F.col("id").alias("other"), F.col("n").alias("nl"), F.col("odd").alias("oddl"))
            near = at.select("key", "id", "c", "n").join(sets.select("id", "odd"), "id")
            pairs = near.join(far, "key").where((F.col("c") != F.col("cl")) & may_link(F.col("n"), F.col("odd"), F.col("nl"), F.col("oddl")))
        pairs = pairs.select(F.least("other", "id").alias("x"), F.greatest("other", "id").alias("y")).distinct()
        pairs = materialize(pairs if done is None else pairs.join(done, ["x", "y"], "left_anti"), size)
        done = pairs if done is None else done.unionByName(pairs)
        new = materialize(verified(pairs, sets, linked), pairs.count(), VERIFIED_ROWS)
        if labels is not None and not new.count():
            continue  # no new link: the components stand
        links = new if links is None else links.unionByName(new)
        labels = connected_components(links, "x", "y")
    at = _apart(live, labels, size)
    #: a pair is met at the least key it shares
    keys = at.groupBy("id").agg(F.collect_set("key").alias("keys")).join(sets.select("id", "odd"), "id")
    at = materialize(at.join(keys, "id"), size)
    one, two = (at.select("key", *[F.col(k).alias(k + s) for k in ("id", "n", "own", "c", "keys", "odd")]) for s in ("1", "2"))
    shared = F.least(F.col("n1") - F.col("own1"), F.col("n2") - F.col("own2"))
    able = (100 * shared >= PERCENT * (F.col("n1") + F.col("n2") - shared)) & may_link(F.col("n1"), F.col("odd1"), F.col("n2"), F.col("odd2"))
    first = F.col("one.key") == F.array_min(F.array_intersect("keys1", "keys2"))
    on = (F.col("one.key") == F.col("two.key")) & (F.col("id1") < F.col("id2")) & (F.col("c1") != F.col("c2")) & able & first
    rest = one.alias("one").join(two.alias("two"), on).select(F.col("id1").alias("x"), F.col("id2").alias("y")).join(done, ["x", "y"], "left_anti")
    new = materialize(verified(rest, sets, linked))
    return connected_components(links.unionByName(new), "x", "y") if new.count() else labels


def _apart(live: DataFrame, labels: DataFrame | None, size: int) -> DataFrame:
    """Rows of the buckets that hold more than one component, with their component c."""
    if labels is None:
        at = live.withColumn("c", F.col("id"))
    else:
        at = live.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    spread = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return materialize(at.join(spread, "key"), size)


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class (hash of the set) for every row."""
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(doc.mapInArrow(_sketch, "doc_id long, n long, h1 long, h2 long, a array<long>, b array<long>"))
    written = []
    full = sketch.where("n > 0 and doc_id is not null")
    reps = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"))
    own = full.join(reps.withColumnRenamed("id", "doc_id"), ["h1", "h2", "doc_id"]).dropDuplicates(["h1", "h2"])
    own = materialize(own.select(F.col("doc_id").alias("id"), "n", "h1", "h2", "a", "b"))
    again = own
    for side in ("a", "b"):
        keys = again.select("id", F.explode(side).alias("key"))
        twice = materialize(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key"))
        met = materialize(semi(keys, twice, "key").select("id").distinct())
        written += [twice, met]
        again = semi(again, met, "id")
    again = materialize(again)
    keys = again.select("id", F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))).alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key"))
    buckets = materialize(semi(keys, shared, "key"))
    release(shared)
    wanted = materialize(buckets.select("id").distinct())
    texts = semi(doc.where("doc_id is not null").withColumnRenamed("doc_id", "id"), wanted, "id")
    sets = materialize(texts.mapInArrow(_sets, "id long, h long, n long, odd array<long>, body array<long>").dropDuplicates(["id", "h"]).drop("h"))
    items = sets.select("id", F.explode("body").alias("item"))
    alone = items.groupBy("item").agg(F.count("*").alias("df"), F.min("id").alias("id")).where("df = 1").groupBy("id").agg(F.count("*").alias("own"))
    found = materialize(cluster(buckets, sets, own=alone).withColumnRenamed("node", "id"))
    release(buckets, sets, wanted, again, *written)
    #: classes of one document and no link need no row: their documents stand for themselves
    copied = full.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    classes = semi(own.select("h1", "h2", "id"), found, "id", "left").join(copied, ["h1", "h2"]).where("copies > 1 or component is not null")
    classes = materialize(classes.select("h1", "h2", F.coalesce("component", "id").alias("cid")))
    release(own, found)
    out = semi(sketch, classes, ["h1", "h2"], "left")
    cid = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("cid", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"), "h1", "h2")


def dedup_report(docs: DataFrame) -> DataFrame:
    return near_groups(docs).drop("h1", "h2")


#: nodes of an id's further texts stand above all ids
_FURTHER = 1 << 62


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group: of its least doc_id, by its text. Rows without
    doc_id or text are linked with nothing and all stay, but rows equal in id and text are one.
    An id with unlike texts is a document for each of them."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"), F.xxhash64("text").alias("h"))
    several = row.where("id is not null").groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    several = materialize(several.select(F.col("id").alias("si"), "lo"))
    further = F.col("si").isNotNull() & (F.col("h") != F.col("lo"))
    row = semi(row, several, F.col("id") == F.col("si"), "left").withColumn("node", F.when(further, F.lit(_FURTHER) + F.pmod("h", F.lit(_FURTHER >> 1))).otherwise(F.col("id"))).drop("si", "lo")
    gone = materialize(near_groups(row.select(F.col("node").alias("doc_id"), F.col("t").alias("text"))).where("not kept").select(F.col("doc_id").alias("node")).distinct())
    left = semi(row, gone, "node", "left_anti")
    twice = materialize(left.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select("id", "h"))
    marked = semi(left, twice.select(F.col("id").alias("ti"), F.col("h").alias("th")), F.col("id").eqNullSafe(F.col("ti")) & (F.col("h") == F.col("th")), "left")
    copies = marked.where("th is not null").groupBy("id", "h").agg(F.first("d").alias("d")).select("d")
    return marked.where("th is null").select("d").unionByName(copies).select("d.*")
