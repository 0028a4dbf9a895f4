"""Fuzzy line deduplication: MinHash over character shingles, banding, exact check, union-find.

A line is compared after Unicode lower-casing and collapsing of white space; blank lines are
never touched. Its set holds its SHINGLE-character windows (a shorter line: itself). Two lines
are linked when the exact Jaccard similarity of their sets is 0.75 or more.

Signatures for the banding are taken over wider windows of WIDE characters (a shorter line:
itself), BANDS bands of ROWS minhashes: unrelated lines of one language share many windows of
5 characters and hardly one of 8, so they rarely meet in a band and candidates do not grow
with the square of the lines. What that costs in recall, for pairs exactly at 0.75: one changed
run of letters leaves 0.675 of the wide windows (missed with 2e-3), scattered single changes
0.63 (missed with 9e-3); both fall fast above 0.75. Candidates are verified on the full sets,
links joined by distributed union-find. Of each component the first occurrence stays, by
doc_id, then position; all other occurrences go. A changed letter inside a line is a link from
39 characters on, a changed word of six letters from 74 on.

Equal lines are one by a 128-bit hash. Bands are dealt in PASSES, each a scan of the texts:
the keys of many lines are shuffled as one binary row for each partition, and the partition
that owns a key meets the lines that share it. A key of at most PAIRED different lines gives
all their pairs, which are verified one by one; the lines of larger keys are clustered by
leaders (``dedup.cluster``), without a cap. Links of both are joined. Where two texts of
lines agree in 64 bits of their hash, the second is compared by equality only.

Defined results: null or empty text has no lines and stays; a null doc_id comes first in
order; repeated rows are one document and keep the same lines; a document all of whose lines
go leaves ``dedup_lines``; extra columns pass through, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import chunks, connected_components, drop_shuffles, materialize, mix, release, semi
from .dedup import PERCENT, VERIFIED_ROWS, cluster, parity_sketch, verified

SHINGLE, WIDE, BANDS, ROWS = 5, 8, 28, 4
PASSES, PAIRED = 2, 16
#: keys of lines that a task holds before it deals them out
HELD = 1 << 19
#: rows whose windows are sorted together: their number takes 12 of 64 bits, a window 51
SORTED = 1 << 12
#: white space but the space itself and the end of a line
_BLANK = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: windows whose minhashes are taken together; what a pass touches stays in a core's cache
BLOCK = 1 << 16
_rng = np.random.default_rng(91)
_MULT = _rng.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32)
_STEP = _rng.integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def compared(line: str) -> str:
    return " ".join(line.lower().split())


def compared_lines(text: str) -> list[str]:
    """``compared`` of every line; a text that has no white space but single spaces is not split into words."""
    low = text.lower()
    if "  " in low or any(c in low for c in _BLANK):
        return [" ".join(x.split()) for x in low.split("\n")]
    return [x.strip(" ") for x in low.split("\n")]


def windows(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the windows of width (5 or 8) characters of non-empty lines, not yet distinct."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    count = np.maximum(size - width + 1, 1)
    if len(cp) >= width:  # windows of 2, 4, then 5 or 8 characters at every position
        two = cp[:-1] * _STEP[0] + cp[1:]
        four = two[:-2] * _STEP[1] + two[2:]
        window = mix(four[:-1] * _STEP[2] + cp[4:]) if width == 5 else mix(four[:-4] * _STEP[3] + four[4:])
        inside = np.ones(len(window), dtype=bool)
        across = (np.cumsum(size)[:, None] - np.arange(1, width)).ravel()
        inside[across[(across >= 0) & (across < len(window))]] = False
        window = window[inside]
    else:
        window = np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero(size < width)
    if not len(short):
        return window, count
    hashes = np.empty(int(count.sum()), dtype=np.uint64)
    whole = np.zeros(len(hashes), dtype=bool)
    whole[(np.cumsum(count) - count)[short]] = True
    hashes[whole] = np.array([line_id(lines[i])[0] for i in short], dtype=np.uint64)
    hashes[~whole] = window
    return hashes, count


def line_keys(lines: list[str], bands: range = range(BANDS)) -> np.ndarray:
    """Keys of the bands, of ROWS 32-bit minhashes each, a row for every line."""
    ends = np.cumsum([len(x) for x in lines])
    parts, first = [np.zeros((0, len(bands)), dtype=np.uint64)], 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
        hashes, count = windows(lines[first:last], WIDE)
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum(count) - count
        least = np.empty((len(count), len(bands) * ROWS), dtype=np.uint32)
        work = np.empty_like(h)
        for i, k in enumerate(b * ROWS + r for b in bands for r in range(ROWS)):
            np.multiply(h, _MULT[k], out=work)
            np.add(work, _ADD[k], out=work)
            least[:, i] = np.minimum.reduceat(work, at)
        key = np.array(bands, dtype=np.uint64)[None, :]
        for pair in np.moveaxis(least.view(np.uint64).reshape(len(count), len(bands), ROWS // 2), 2, 0):
            key = mix(key * _STEP[0] + pair)
        parts.append(key)
        first = last
    return np.concatenate(parts)


def line_id(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return h >> 64, h & ((1 << 64) - 1)


def line_ids(lines: list[str]) -> tuple[pa.Array, pa.Array]:
    ids = np.array([line_id(x) for x in lines], dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.array(ids[:, 0]), pa.array(ids[:, 1])


def _cells(lines: list[str], side: int = 0) -> np.ndarray:
    """At most SORTED lines' windows, not yet distinct: 12 bits of the line's number, 51 of the window, one of the side."""
    hashes, count = windows(lines, SHINGLE)
    return (np.repeat(np.arange(len(lines), dtype=np.uint64), count) << np.uint64(52)) | (hashes >> np.uint64(13) << np.uint64(1)) | np.uint64(side)


def _distinct(cells: np.ndarray) -> np.ndarray:
    cells.sort()
    new = np.ones(len(cells), dtype=bool)
    np.not_equal(cells[1:], cells[:-1], out=new[1:])
    return cells[new]


def line_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted distinct window hashes (51 bits) of every line, end to end."""
    parts, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for first in range(0, len(lines), SORTED):
        part = lines[first : first + SORTED]
        cell = _distinct(_cells(part))
        parts.append((cell & np.uint64((1 << 52) - 1)) >> np.uint64(1))
        sizes.append(np.bincount((cell >> np.uint64(52)).astype(np.int64), minlength=len(part)))
    return np.concatenate(parts), np.concatenate(sizes)


def similar(one: list[str], two: list[str]) -> np.ndarray:
    """Whether the sets of one[i] and two[i], of at most SORTED lines each, reach the similarity."""
    cell = _distinct(np.concatenate([_cells(one), _cells(two, 1)]))
    row = (cell >> np.uint64(52)).astype(np.int64)
    both = np.bincount(row[1:][cell[1:] >> np.uint64(1) == cell[:-1] >> np.uint64(1)], minlength=len(one))
    return 100 * both >= PERCENT * (np.bincount(row, minlength=len(one)) - both)


def _of_part(part: pa.RecordBatch) -> Iterator[tuple[int, int, str]]:
    """(row, position, compared text) of the lines that are not blank."""
    for i, text in enumerate(part.column("text").to_pylist()):
        for p, c in enumerate(compared_lines(text) if text else ()):
            if c:
                yield i, p, c


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line."""
    for batch in batches:
        for part in chunks(batch, "text"):
            found = list(_of_part(part))
            if not found:
                continue
            row, pos, line = zip(*found, strict=True)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("doc").take(at), part.column("rid").take(at), pa.array(pos, pa.int32()), *line_ids(line)], names=["doc", "rid", "pos", "h", "g"])


def _dealt(key: np.ndarray, h: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row (b, keys, lines) for each partition b that owns some of the keys."""
    b = (key % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(b, kind="stable")
    b = b[order]
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    at = pa.py_buffer((np.append(first, len(b)) * 8).astype(np.int32))
    cells = [pa.Array.from_buffers(pa.binary(), len(first), [None, at, pa.py_buffer(x[order])]) for x in (key, h)]
    return pa.RecordBatch.from_arrays([pa.array(b[first], pa.int32()), *cells], names=["b", "key", "h"])


def _keys(bands: range, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                lines = list({c: None for _, _, c in _of_part(part)})
                held.append((line_keys(lines, bands).ravel(), np.repeat(line_ids(lines)[0].to_numpy(), len(bands))))
                n += len(held[-1][0])
                if n >= HELD:
                    yield _dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)
                    held, n = [], 0
        if n:
            yield _dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the keys that different lines share: their pairs (null, x, y), x < y; for keys of more than PAIRED lines (key, x, null)."""
    held = [[], []]
    for batch in batches:
        for c, to in zip(("key", "h"), held, strict=True):
            col = batch.column(c).cast(pa.large_binary())
            at = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
            if len(col) and at[-1] > at[0]:
                to.append(np.frombuffer(col.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].copy().view(np.int64))
    if not held[0]:
        return
    key, h = (np.concatenate(x) for x in held)
    del held
    order = np.argsort(key)
    key = key[order]
    again = np.zeros(len(key) + 1, dtype=bool)
    again[1:-1] = key[1:] == key[:-1]
    again = again[1:] | again[:-1]
    key, h = key[again], h[order[again]]
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    key, h = key[new], h[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(first, len(key)))
    xs, ys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for q in range(2, PAIRED + 1):
        group = h[first[size == q][:, None] + np.arange(q)]
        one, two = np.triu_indices(q, 1)
        xs.append(group[:, one].ravel())
        ys.append(group[:, two].ravel())
    x, y = np.concatenate(xs), np.concatenate(ys)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    large = np.repeat(size > PAIRED, size)
    names = ["key", "x", "y"]
    for k, a, b in ((None, x[new], y[new]), (key[large], h[large], None)):
        for i in range(0, len(a), 100_000):
            none = pa.nulls(len(a[i : i + 100_000]), pa.int64())
            yield pa.RecordBatch.from_arrays([none if c is None else pa.array(c[i : i + 100_000]) for c in (k, a, b)], names=names)


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines (position, id) at the seats of each text, with their sets' sizes and sketches."""
    for batch in batches:
        for part in chunks(batch, "text"):
            found: dict[int, str] = {}
            seats = part.column("seats")
            ids, pos = (seats.flatten().field(c).to_pylist() for c in ("id", "pos"))
            at = np.concatenate([[0], np.cumsum(seats.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            for i, text in enumerate(part.column("text").to_pylist()):
                all_lines = text.split("\n")
                found.update((k, compared(all_lines[p])) for k, p in zip(ids[at[i] : at[i + 1]], pos[at[i] : at[i + 1]], strict=True))
            if not found:
                continue
            lines = list(found.values())
            hashes, sizes = line_sets(lines)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(sizes), parity_sketch(hashes, sizes), pa.array(lines, pa.string())], names=["id", "n", "odd", "body"])


def _linked_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, body, other), bodies being lines, whose sets reach the similarity."""
    for batch in batches:
        for part in chunks(batch, "body"):
            for first in range(0, part.num_rows, SORTED):
                rows = part.slice(first, SORTED)
                yield rows.select(["x", "y"]).filter(pa.array(similar(*(rows.column(c).to_pylist() for c in ("body", "other")))))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text"), F.xxhash64("doc_id", "text").alias("rid"))


def _near_lines(lines: DataFrame, doc: DataFrame) -> DataFrame:
    """(h, g, component) of the lines that are linked with others."""
    spark = doc.sparkSession
    parts, met = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    for k in range(PASSES):
        keys = doc.select("text").mapInArrow(_keys(range(k, BANDS, PASSES), parts), "b int, key binary, h binary")
        met.append(materialize(keys.repartitionById(parts, "b").mapInArrow(_met, "key long, x long, y long")))
        del keys
        drop_shuffles(spark)
    hits = met[0]
    for more in met[1:]:
        hits = hits.unionByName(more)
    pairs = materialize(hits.where("y is not null").select("x", "y").distinct())
    large = materialize(hits.where("y is null").select("key", F.col("x").alias("id")))
    release(*met)
    ids = pairs.select(F.explode(F.array("x", "y")).alias("h")).unionByName(large.select(F.col("id").alias("h")))
    wanted = materialize(ids.distinct())
    few = wanted.count()
    #: each wanted line is read at one place
    places = materialize(semi(lines, wanted, "h").dropDuplicates(["h"]), few)
    seats = places.groupBy("doc", "rid").agg(F.collect_list(F.struct("pos", F.col("h").alias("id"))).alias("seats")).select(F.col("doc").alias("sd"), F.col("rid").alias("sr"), "seats")
    seats = materialize(seats, few)
    read = semi(doc, seats, F.col("doc").eqNullSafe(F.col("sd")) & (F.col("rid") == F.col("sr")), "inner").select("text", "seats")
    sets = materialize(read.mapInArrow(_wanted_lines, "id long, n long, odd array<long>, body string").dropDuplicates(["id"]), few)
    release(seats, wanted)
    links = materialize(verified(pairs, sets, _linked_lines), pairs.count(), VERIFIED_ROWS)
    every = links
    if large.limit(1).count():
        every = links.unionByName(cluster(large, sets, _linked_lines).select(F.col("node").alias("x"), F.col("component").alias("y")))
    found = connected_components(every, "x", "y").withColumnRenamed("node", "h")
    out = materialize(found.join(places.select("h", "g"), "h").select("h", "g", "component"), few)
    release(pairs, large, sets, links, places)
    return out


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc, rid, removed): for each document that loses lines, their positions in order."""
    doc = _documents(docs)
    lines = materialize(doc.mapInArrow(_lines, "doc long, rid long, pos int, h long, g long"))
    near = _near_lines(lines, doc)
    #: only lines that occur again or are linked go on
    again = lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g", F.lit(None).cast("long").alias("component"))
    kinds = materialize(near.unionByName(again).groupBy("h", "g").agg(F.max("component").alias("component")))
    #: a class is a component, or an equal line; components are ids, and g = null tells them apart
    classed = semi(lines, kinds, ["h", "g"], "inner")
    classed = materialize(classed.select(F.coalesce("component", "h").alias("c"), F.when(F.col("component").isNull(), F.col("g")).alias("d"), F.struct("doc", "rid", "pos").alias("at")))
    release(lines, near, kinds)
    keepers = classed.groupBy("c", "d").agg(F.min("at").alias("keep"), F.max("at").alias("last")).where("not keep <=> last").select(F.col("c").alias("kc"), F.col("d").alias("kd"), "keep")
    keepers = materialize(keepers)
    gone = semi(classed, keepers, (F.col("c") == F.col("kc")) & F.col("d").eqNullSafe(F.col("kd")), "inner").where("not at <=> keep").select("at.doc", "at.rid", "at.pos").distinct()
    out = materialize(gone.groupBy("doc", "rid").agg(F.sort_array(F.collect_list("pos")).alias("removed")))
    release(classed, keepers)
    return out


def _with_removed(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(d, a struct of the columns of docs; removed, null where nothing goes)."""
    gone = gone.select(F.col("doc").alias("gd"), F.col("rid").alias("gr"), "removed")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("doc_id", "text").alias("rid"))
    return semi(row, gone, F.col("doc").eqNullSafe(F.col("gd")) & (F.col("rid") == F.col("gr")), "left").select("d", "removed")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, removed (positions in the text) for every row."""
    docs = docs.select("doc_id", "text")
    #: the white space that ``compared`` collapses: a line of it alone is blank
    n = F.size(F.filter(F.split(F.coalesce(F.col("d.text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\s\p{Z}\x1c-\x1f\x85]")))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return _with_removed(docs, repeated_lines(docs)).select("d.doc_id", n.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


@F.pandas_udf(StringType())
def _without(text: pd.Series, removed: pd.Series) -> pd.Series:
    def kept(t: str | None, gone) -> str | None:
        if t is None:
            return None
        gone = set(gone)
        return "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)

    return pd.Series([kept(t, r) for t, r in zip(text, removed, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines; those left without any text go."""
    hit = F.col("removed").isNotNull()
    j = _with_removed(docs, repeated_lines(docs)).withColumn("t", _without(F.when(hit, F.col("d.text")), "removed"))
    j = j.where(~hit | F.col("t").rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"))
    new = {"text": F.when(hit, F.col("t")).otherwise(F.col("d.text")), "n_chars": F.when(hit, F.length("t").cast("long")).otherwise(F.col("d").getField("n_chars").cast("long")) if "n_chars" in docs.columns else None}
    return j.select(*[(new[c] if c in new else F.col("d").getField(c)).alias(c) for c in docs.columns])
