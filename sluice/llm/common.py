"""What the training-data operators share: written tables, vectorised words, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 21


# ---------------------------------------------------------------- written tables
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there.

    Where a bound on its rows is known, small tables are dealt to fewer writers (8 at
    least, then one for every per_file rows); the joins before keep their own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}"
    (df if rows is None or rows > 64 * per_file else df.repartition(max(8, rows // per_file))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sluice_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads, and let Spark drop the shuffles behind them.

    Spark deletes the files of a shuffle when the driver's garbage collector finds that no
    plan holds it; without a collection they would stay until the end of the query.
    """
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._sluice_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no plan holds any more."""
    gc.collect()
    spark._jvm.System.gc()


#: most rows of a written key table that are broadcast (some tens of MB); beyond it, a shuffled join
BROADCAST_ROWS = 400_000


def semi(df: DataFrame, keys: DataFrame, on: str | list[str] | Column, how: str = "left_semi") -> DataFrame:
    """Join with a written table of keys, broadcast only if its counted rows are few."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


# ---------------------------------------------------------------- words, without objects
_rng = np.random.default_rng(20240601)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles inside (0, 1)."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POW.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["up"], _POW["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i], brought to position 0, the hash of data[i:j]."""
    up, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64))


def string_hash(word: bytes) -> int:
    data = np.frombuffer(word, dtype=np.uint8)
    return int(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Parts of a batch with about limit bytes of text each; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of a chunk of texts: where they stand, whose they are, their 64-bit hashes."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = text_bytes(column)
        self.data = _LOWER[raw]
        n = len(raw)
        space = _SPACE[raw]
        first = np.zeros(n + 1, dtype=bool)
        first[self.offsets] = True
        word = ~space
        begins, ends = word.copy(), word.copy()
        if n:
            begins[1:] &= space[:-1] | first[1:n]
            ends[:-1] &= space[1:] | first[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.hash = span_hash(prefix_hash(self.data), self.start, self.end)
        #: words of row i are first[i] : first[i + 1]
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, type=kind))


# ---------------------------------------------------------------- components
def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Least node reachable, for every node of an edge list: (node, component).

    Distributed union-find: each round every node with a smaller neighbour hangs on its least
    one, pointer jumping brings it to the root of its tree, and edges go on between roots only,
    so that a large group is gone after few rounds. Tables are written to the shared folder;
    edges and labels never reach the driver.
    """
    a, b = F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")
    e = materialize(edges.select(a, b).where("a <> b").distinct())
    n, labels = e.count(), None
    most = n
    while n:
        up = materialize(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), n)
        while True:
            far = up.select(F.col("node").alias("component"), F.col("component").alias("further"))
            new = materialize(up.join(far, "component", "left").select("node", F.coalesce("further", "component").alias("component"), F.col("further").isNotNull().alias("changed")), n)
            changed = new.where("changed").limit(1).count()
            release(up)
            up = new.select("node", "component")
            up._sluice_path = new._sluice_path
            if not changed:
                break
        root = up.withColumnRenamed("component", "root")
        one, two = root.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), root.withColumnRenamed("node", "b").withColumnRenamed("root", "rb")
        left = e.join(one, "a", "left").join(two, "b").select(F.coalesce("ra", "a").alias("a"), F.col("rb").alias("b"))  # every b has a root
        left = materialize(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n)
        release(e)
        e, n = left, left.count()
        if labels is None:
            labels = up
        else:  # roots of the rounds before now hang on others
            moved = labels.join(root.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            both = materialize(moved.unionByName(up), most)
            release(labels, up)
            labels = both
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    release(e)
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
