"""Whitening of vectors: blockwise TSQR of the centred rows, one-sided Jacobi rotations of the columns of R."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .vectors import unpacked, whole_numbers

#: The largest component that counts; larger ones count as this, so that sums over a batch stay whole.
LIMIT = 1 << 48
#: Bytes of the triangles that one task stacks at a time, and of the rows that it factors at a time.
STACK_BYTES, ROWS_BYTES = 64 << 20, 8 << 20
#: Rotations are done when no two columns' cosine is above TINY; columns below NONE of the longest have no variance.
TINY, NONE, SWEEPS = 1e-15, 1e-13, 60


@dataclass
class Whitening:
    """n distinct rows, their sums S (exact), and unit components in the columns of `axes` with eigenvalues, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def projection(self, most: int) -> np.ndarray:
        """The matrix that whitens centred rows, for the components that have variance; NaN in the columns of the others."""
        e = self.values[:most]
        return self.axes[:, :most] / np.sqrt(np.where(e > 0, e, np.nan))


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def rotated(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, v): plane rotations v that make the columns of r @ v orthogonal, and their lengths, the longest first.

    Every sweep meets all pairs of columns, disjoint pairs of a round at once; the pairs of a round come from turning one
    half of the columns against the other. Each pair is rotated by the angle that makes its inner product zero.
    """
    d = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    a, v = r[:, order].T.copy(), np.eye(d)[order]  # columns as rows
    ring = np.arange(d + d % 2)  # with an odd number one column rests in each round
    half = len(ring) // 2
    least = (NONE * np.linalg.norm(r)) ** 2  # what rounding leaves of a column without variance is not turned
    for _ in range(SWEEPS if d > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            p, q = ring[:half], ring[half:][::-1]
            real = np.maximum(p, q) < d
            p, q = p[real], q[real]
            alpha, beta, gamma = (a[p] ** 2).sum(1), (a[q] ** 2).sum(1), (a[p] * a[q]).sum(1)
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = (np.abs(gamma) > TINY * size) & (np.minimum(alpha, beta) > least)
            if turn.any():
                worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
                p, q = p[turn], q[turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = (c * t)[:, None]
                c = c[:, None]
                for m in (a, v):
                    x, y = m[p], m[q]
                    m[p], m[q] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])
        if worst <= 4 * TINY * math.sqrt(d):
            break
    lengths = np.linalg.norm(a, axis=1)
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[order].T


def tsqr(spark: SparkSession, centred: DataFrame, width: int, scratch: C.Scratch) -> np.ndarray:
    """R of the rows of a column `x` of packed doubles: each task factors its rows block by block, then triangles are stacked and factored in rounds until one is left."""
    step = max(width, ROWS_BYTES // (8 * width))
    fan = max(2, STACK_BYTES // (8 * width * width))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            x = C.flat(batch.column("x"))[0].view(np.float64).reshape(len(batch), width)
            for at in range(0, len(x), step):
                r = triangle(np.concatenate([r, x[at : at + step]]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["x"])

    def merge(table: pa.Table) -> pa.Table:
        r = np.zeros((0, width))
        for x in sorted(table.column("x").to_pylist()):
            r = triangle(np.concatenate([r, np.frombuffer(x, np.float64).reshape(-1, width)]))
        return pa.table({"x": pa.array([r.tobytes()], pa.binary())})

    left = scratch.write(centred.mapInArrow(local, "x binary"), "triangles0")
    level, count = 0, left.count()
    while count > 1:
        level += 1
        groups = -(-count // fan)
        left = scratch.write(left.withColumn("g", F.pmod(F.xxhash64("x"), F.lit(groups))).groupBy("g").applyInArrow(merge, "x binary"), f"triangles{level}")
        after = left.count()
        if after >= count:  # no two shared a group
            left, after = scratch.write(left.coalesce(1).mapInArrow(local, "x binary"), f"triangles{level}-last"), 1
        count = after
    first = left.first()
    return np.frombuffer(first["x"], np.float64).reshape(-1, width) if first else np.zeros((0, width))


class Whitener:
    """The fit of one table; see whiten()."""

    def __init__(self, vectors: DataFrame, scale: int):
        self.spark = vectors.sparkSession
        self.scratch = C.Scratch(self.spark, "whitening")
        width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
        self.width = max(width, 0)
        self.rows = self.scratch.write(whole_numbers(vectors, scale, self.width, LIMIT, {"id": "long"}).select("id", "x"), "rows")
        self.fit = self.scratch.write(self.rows.select("x").distinct(), "fit")

    def centred(self, mean: np.ndarray) -> DataFrame:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unpacked(batch.column("x"), width) - mean
                yield pa.RecordBatch.from_arrays([C.binaries(x.ravel(), np.arange(len(x) + 1) * width)], ["x"])

        return self.fit.mapInArrow(run, "x binary")

    def sums(self) -> tuple[int, list[int]]:
        """The number of distinct rows and their exact sums, one for each dimension."""
        width = self.width

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unpacked(batch.column("x"), width)
                for at in range(0, len(x), 1 << 14):
                    part = x[at : at + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(part.sum(0))], ["dim", "s"])

        parts = self.fit.mapInArrow(add, "dim int, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        known = {r["dim"]: int(r["s"]) for r in parts.collect()}  # one row for each dimension
        return self.fit.count(), [known[k] for k in range(width)] if known else [0] * width

    def model(self) -> Whitening | None:
        n, sums = self.sums()
        if not n or not self.width:
            return None
        out = Whitening(n, sums, np.zeros(0), np.zeros((self.width, 0)))
        lengths, axes = rotated(tsqr(self.spark, self.centred(out.mean), self.width, self.scratch))
        lengths = np.where(lengths > NONE * lengths.max(initial=0) * math.sqrt(self.width), lengths, 0)
        sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        return Whitening(n, sums, lengths * lengths / n, axes * np.where(sign == 0, 1, sign))


def projected(rows: DataFrame, model: Whitening, most: int, width: int) -> DataFrame:
    """(id, z, deviation): the whitened coordinates and the exact sum over dimensions of (n * x - S)^2 of every row."""
    n, sums, mean, turn = model.n, model.sums, model.mean, model.projection(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("x"), width)
            z = (x - mean) @ turn
            bound = max((n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)) ** 2 * width, 1)
            if bound < 1 << 63:
                far = ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
            else:
                whole = (n * x.astype(object) - np.array(sums, object)) ** 2
                far = np.array([min(int(v), (1 << 63) - 1) for v in whole.sum(1)], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(far, pa.int64())], ["id", "z", "deviation"])

    return rows.mapInArrow(run, "id long, z array<double>, deviation long")


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component.

    A component x of a vector counts as floor(scale * x). The fit takes each distinct vector once: n of them, with sums S. The
    components are the unit eigenvectors of their covariance (divisor n), by falling eigenvalue e; whitened is the centred
    row's coordinate over sqrt(e), explained e over all variance, identity_error the largest entry of the whitened
    coordinates' covariance less the identity, deviation the sum over dimensions of (n * x - S)^2 (at most the largest long).
    The sign of a component makes its largest entry positive.

    Vectors that are null or hold null or non-finite entries are left out; a null id stays. Shorter vectors end in zeros,
    entries beyond LIMIT count as LIMIT. Repeated rows and ids have rows of their own. There are no more components than
    dimensions; one without variance has null for whitened and 0 explained (null if nothing varies), and does not count for
    identity_error. An empty table, or one of vectors without entries, gives no rows. Other columns are ignored.

    Centred rows become one triangle R by QR factors of blocks, merged in rounds (tsqr); only R, the sums and the result of
    the rotations, of the size of the width squared, reach the driver. Rotations of R's columns (rotated) give components
    and standard deviations without forming the covariance, so that small ones are as accurate as large ones.
    """
    form = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whitener = Whitener(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), scale)
    model = whitener.model()
    if model is None:
        return vectors.sparkSession.createDataFrame([], form)
    most = min(components, whitener.width)
    varied = [k for k in range(most) if model.values[k] > 0] if len(model.values) else []
    values = np.pad(model.values, (0, max(0, most - len(model.values))))
    z = projected(whitener.fit.withColumn("id", F.lit(None).cast("long")), model, most, whitener.width).select(*(F.col("z")[k].alias(f"z{k}") for k in range(most)))
    pairs = [(a, b) for a in varied for b in varied if a <= b]
    entries = z.agg(*(F.covar_pop(f"z{a}", f"z{b}").alias(f"c{a}_{b}") for a, b in pairs)).first() if pairs else []
    error = max((abs(c - (a == b)) for (a, b), c in zip(pairs, entries)), default=None)
    total = model.values.sum()
    share = F.array(*(F.lit(float(values[k] / total) if total > 0 else None).cast("double") for k in range(most)))
    rows = projected(whitener.rows, model, most, whitener.width).select("id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return rows.select("id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
