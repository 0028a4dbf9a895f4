"""Merkle manifest: a tree of digests over ordered rows, with proofs.

Leaves are hashed by Spark, dealt to partitions by ranges of (tree, order) and numbered:
a task counts its rows by tree, and running sums over these counts give every partition's
first position. Each indexed partition then streams its leaves over a stack of levels: the
fanout-th child of a run carries into its parent, whose digest goes one level up, and the run
is emitted as a node record. Runs that the partition holds only in part leave their
children behind as peaks. The peaks of all partitions (at most fanout at either edge
of a level) merge level by level: grouped by run, hashed in order, without padding,
however short the last run is. Every job is a shuffle by key, so tree and table may be of
any size; the driver reads one number, the greatest height.

A path is the list of a leaf's runs from its own to the root's. Paths are built from the
root down by joins of node records, so a level costs a fanout-th of the one below.
Folding replaces in each run the child on the way by what came from below.

Defined results: every row is a leaf, equal rows as often as they stand. Rows of a tree order
by the order column, null first, then by digest. A null tree is a tree of its own before all
others. One leaf is its own root. An empty table has no rows and no roots. Rows with null
doc_id are never tampered with. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, semi

FANOUT = 8
#: characters of a digest
WIDE = 64
#: leaves in an indexed partition, about
PART_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value so that no two rows concatenate alike: `-`, or its bytes, `:` and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def tree_key(c: Column) -> Column:
    """A key without nulls that sorts as the column does, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def div(a: Column, b: Column) -> Column:
    """Whole quotient of two longs."""
    return F.call_function("div", a, b)


# ---------------------------------------------------------------- positions
def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number sorted rows within their partition and tree."""
    from pyspark import TaskContext

    part, tree, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        i = []
        for t in batch.column("tree").to_pylist():
            at = at + 1 if t == tree else 0
            tree = t
            i.append(at)
        n = len(i)
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(i, pa.int64()), *batch.columns], names=["part", "i", *batch.schema.names])


def positions(leaves: DataFrame) -> DataFrame:
    """Written leaves (tree, ord, leaf, ...) with their tree's size, their partition and their position in the tree."""
    n = leaves.count()
    parts = max(8, -(-n // PART_ROWS))
    #: equal leaves may stand in any order, so a row number spreads them
    keyed = leaves.withColumn("tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(parts, "tree", "ord", "leaf", "tie").sortWithinPartitions("tree", "ord", "leaf", "tie").drop("tie")
    schema = "part int, i long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    rows = materialize(dealt.mapInArrow(_numbered, schema))
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("m"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy("tree")).alias("size"))
    return rows.join(starts, ["tree", "part"]).withColumn("pos", F.col("start") + F.col("i")).drop("i", "start")


# ---------------------------------------------------------------- stacks
def _height(size: int, fanout: int) -> int:
    h = 0
    while fanout**h < size:
        h += 1
    return h


def height(size: Column, fanout: int) -> Column:
    """The least h with fanout**h >= size."""
    steps = [F.when(size > fanout**h, h + 1) for h in range(62) if fanout**h < 1 << 62]
    return F.coalesce(*reversed(steps), F.lit(0))


class Stack:
    """Open runs of one stretch of leaves: for each level the position of its first child and the children so far."""

    def __init__(self, fanout: int):
        self.fanout, self.open = fanout, []

    def push(self, pos: int, leaf: str) -> Iterator[tuple[int, int, str, str]]:
        """Add a leaf; yields (level, idx, digest, children) of each run that it completes."""
        level, idx, node = 0, pos, leaf
        while True:
            if level == len(self.open):
                self.open.append((idx, []))
            first, kids = self.open[level]
            kids.append(node)
            if (idx + 1) % self.fanout or first % self.fanout:
                if not (idx + 1) % self.fanout:
                    yield from self.left(level)
                return
            run = "".join(kids)
            self.open[level] = (idx + 1, [])
            level, idx, node = level + 1, idx // self.fanout, hashlib.sha256(run.encode()).hexdigest()
            yield level, idx, node, run

    def left(self, level: int) -> Iterator[tuple[int, int, str, None]]:
        """The children of a run that this stretch can't complete: peaks."""
        first, kids = self.open[level]
        for j, node in enumerate(kids):
            yield level, first + j, node, None
        self.open[level] = (first + len(kids), [])

    def peaks(self) -> Iterator[tuple[int, int, str, None]]:
        for level in range(len(self.open)):
            yield from self.left(level)


def _stacked(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("node", pa.string()), ("run", pa.string())])
        key, stack, out, due = None, None, [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for tree, size, pos, leaf in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "pos", "leaf")), strict=True):
                if key != (tree, size) or pos != due:
                    if stack:
                        out += [(*key, *n) for n in stack.peaks()]
                    key, stack = (tree, size), Stack(fanout)
                due = pos + 1
                out += [(*key, *n) for n in stack.push(pos, leaf)]
            if len(out) > 20_000:
                yield flush()
                out = []
        if stack:
            out += [(*key, *n) for n in stack.peaks()]
        if out:
            yield flush()

    return run


NODES = "tree string, size long, level int, idx long, node string, run string"


def nodes(placed: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """Node records of the trees over placed leaves (tree, part, size, pos, leaf), and the greatest height.

    A record is (tree, size, level, idx, node, run): run holds the children's digests, node is its digest.
    """
    dealt = placed.select("tree", "size", "pos", "leaf", "part").repartition("part").sortWithinPartitions("part", "tree", "pos").drop("part")
    stacked = materialize(dealt.mapInArrow(_stacked(fanout), NODES))
    top = _height(stacked.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0], fanout)
    #: a completed run's node is a peak too where its parent was not completed beside it
    complete = stacked.where("run is not null")
    peaks = stacked.where("run is null")
    found, merged = [complete], []
    for level in range(top):
        waiting = reduce(DataFrame.unionByName, [peaks.where(F.col("level") == level), *merged[-1:]])
        waiting = waiting.where(height(F.col("size"), fanout) > level)
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda k: k["node"]), "")  # at most fanout children
        up = waiting.groupBy("tree", "size", div(F.col("idx"), F.lit(fanout)).alias("up")).agg(run.alias("run"))
        up = materialize(up.select("tree", "size", F.lit(level + 1).cast("int").alias("level"), F.col("up").alias("idx"), F.sha2("run", 256).alias("node"), "run"))
        merged.append(up)
        found.append(up)
    out = materialize(reduce(DataFrame.unionByName, found))
    release(stacked, *merged)
    return out, top


def roots(placed: DataFrame, records: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, root): the record at its tree's height, or the lone leaf itself."""
    high = records.where(F.col("level") == height(F.col("size"), fanout)).select("tree", F.col("node").alias("root"))
    return high.unionByName(placed.where("size = 1").select("tree", F.col("leaf").alias("root")))


def paths(records: DataFrame, top: int, fanout: int = FANOUT) -> DataFrame:
    """(tree, up, path): for every run of leaves, the runs from it to its root."""
    of = lambda level: records.where(F.col("level") == level).select("tree", "idx", "run")
    path = of(top).select("tree", "idx", F.array("run").alias("path")) if top else None
    for level in range(top - 1, 0, -1):
        above = path.select("tree", F.col("idx").alias("up"), F.col("path").alias("rest"))
        here = of(level).withColumn("up", div(F.col("idx"), F.lit(fanout)))
        path = here.join(above, ["tree", "up"], "left").select("tree", "idx", F.concat(F.array("run"), F.coalesce("rest", F.array().cast("array<string>"))).alias("path"))
    if path is None:
        return records.select("tree", F.col("idx").alias("up"), F.array("run").alias("path"))
    return path.withColumnRenamed("idx", "up")


# ---------------------------------------------------------------- proofs
def _at(pos: Column, level: Column, fanout: int) -> Column:
    """Where in its run, counted from the leaves up, the leaf's ancestor stands."""
    return (div(pos, F.pow(F.lit(fanout), level).cast("long")) % fanout).cast("int")


def siblings(path: Column, pos: Column, fanout: int = FANOUT) -> Column:
    """All siblings on the way to the root, from left to right, level by level."""
    cut = lambda run, i: F.concat(F.substring(run, F.lit(1), _at(pos, i, fanout) * WIDE), F.substring(run, _at(pos, i, fanout) * WIDE + WIDE + 1, F.lit(fanout * WIDE)))
    return F.array_join(F.transform(path, cut), "")


def folded(leaf: Column, path: Column, pos: Column, fanout: int = FANOUT) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    runs = F.transform(path, lambda run, i: F.struct(run.alias("run"), _at(pos, i, fanout).alias("at")))
    put = lambda node, r: F.sha2(F.concat(F.substring(r["run"], F.lit(1), r["at"] * WIDE), node, F.substring(r["run"], r["at"] * WIDE + WIDE + 1, F.lit(fanout * WIDE))), 256)
    return F.aggregate(runs, leaf, put)


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over written leaves (tree, ord, leaf, ...): the leaves with (size, pos, path), node records, (tree, root)."""
    placed = materialize(positions(leaves))
    records, top = nodes(placed, fanout)
    rows = placed.withColumn("up", div(F.col("pos"), F.lit(fanout))).join(paths(records, top, fanout), ["tree", "up"], "left").drop("up", "part")
    return rows.withColumn("path", F.coalesce("path", F.array().cast("array<string>"))), records, roots(placed, records, fanout)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, ord, leaf, tampered): digests of documents, and of what tampering makes of them."""
    of = lambda text: digest(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = of(F.col("text"))
    changed = F.when(hit & F.col("text").rlike("[A-Z]"), of(F.translate("text", UPPER, LOWER)))
    return docs.select(tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("ord"), leaf.alias("leaf"), changed.alias("tampered")).withColumn("tampered", F.coalesce("tampered", "leaf"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """A tree for each lang and one over their roots: every document's proof, and what it says of the tampered row."""
    rows, _, subroots = manifest(materialize(document_leaves(docs)))
    above, _, _ = manifest(materialize(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("ord"), F.col("root").alias("leaf")), 0))
    above = materialize(above.select(F.col("ord").alias("tree"), F.col("leaf").alias("subroot"), F.col("pos").alias("top_pos"), F.col("path").alias("top_path")), 0)
    both = semi(rows, above, "tree", "inner")  # a row a tree
    pos, path, top_pos, top_path = (F.col(c) for c in ("pos", "path", "top_pos", "top_path"))
    root = F.when(F.size(top_path) == 0, F.col("subroot")).otherwise(F.sha2(F.element_at(top_path, -1), 256))
    proof = F.sha2(F.concat(siblings(path, pos), siblings(top_path, top_pos)), 256)
    back = folded(folded(F.col("tampered"), path, pos), top_path, top_pos)
    out = both.select(F.col("ord").alias("doc_id"), "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
