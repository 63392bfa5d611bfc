"""Scratch tables, Arrow helpers and connected components shared by the operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numeric kernel handles at once; its temporary arrays are some 60 times as large.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset on a local master, a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="gridmoments-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Tables of one operator call in the shared folder. They are removed by drop() or at the end of the driver."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gridmoments-{name}-{uuid.uuid4().hex}"
        atexit.register(self._quiet_drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str | int) -> DataFrame:
        """Writes df, which cuts its lineage, and reads it back."""
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished jobs now; else they stay until the driver happens to collect garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _quiet_drop(self) -> None:
        try:
            self.drop()
        except Exception:  # the session may have ended
            if self.root.startswith("file:"):
                import shutil

                shutil.rmtree("/" + self.root[5:].lstrip("/"), ignore_errors=True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most so many bytes in a text column; a larger row comes alone. Then Arrow gives back memory that is free, which idle workers would hold."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, nulls as empty, and the offsets of its values."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of values[bounds[i]:bounds[i + 1]] as bytes."""
    raw = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((np.asarray(bounds, np.int64) * raw.itemsize).tobytes()), pa.py_buffer(raw.tobytes())]
    ).cast(pa.binary())


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def rolling(raw: np.ndarray) -> np.ndarray:
    """Prefix sums s of a polynomial hash: (s[b] - s[a]) * inverse**a identifies the bytes a to b - 1, wherever they stand."""
    s = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw))[0], out=s[1:])
    return s


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges a-b, and of each the smallest vertex that these edges reach."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every vertex of the edges (a, b), component the smallest id that it reaches.

    Each round joins what a partition's edges connect, points every vertex to its smallest neighbour, jumps pointers
    and contracts the edges; rounds end when no edge is left. A vertex with very many edges is dealt by aggregates that
    combine in the mappers and by joins that Spark can split.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x, y = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1))
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a) > 400_000:
                a, b = local_forest(a, b)
                a, b = a[a != b], b[a != b]
                if len(a) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = a[:0], b[:0]
        if len(a):
            a, b = local_forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = scratch.write(edges.mapInArrow(contract, "a long, b long"), f"{name}-edges0")
    labels, k = None, 0
    while not edges.isEmpty():
        k += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p"))
        parent = scratch.write(low, f"{name}-low{k}")
        jump = parent.select(F.col("id").alias("p"), F.col("p").alias("q"))
        parent = parent.join(jump, "p").select("id", F.col("q").alias("p"))
        jump = parent.select(F.col("id").alias("p"), F.col("p").alias("q"))
        parent = scratch.write(parent.join(jump, "p").select("id", F.col("q").alias("p")), f"{name}-parent{k}")
        scratch.drop(f"{name}-low{k}")
        to = parent.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        step = edges.join(to, "a").select(F.col("pa").alias("a"), F.col("b"))
        to = parent.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        step = step.join(to, "b").select("a", F.col("pb").alias("b")).where("a <> b")
        after = scratch.write(step.mapInArrow(contract, "a long, b long").distinct(), f"{name}-edges{k}")
        if labels is None:
            labels = parent.select("id", F.col("p").alias("component"))
        else:
            moved = parent.select(F.col("id").alias("component"), F.col("p").alias("to"))
            labels = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = scratch.write(labels, f"{name}-labels{k}")
        edges = after
    return labels if labels is not None else spark.createDataFrame([], "id long, component long")
