"""Exact top-k search by inner product through a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .vectors import matrix, rows_of

#: Pivots, rows of the sample they and the annuli's bounds are fitted on, annuli of a pivot, bytes of queries in a pass.
PIVOTS, SAMPLE, ANNULI, PASS_BYTES = 64, 8192, 16, 16 << 20
#: Annuli, nearest first, that a query has met at the end of each wave of a pass; the last wave goes to the end.
WAVES = (2, 32)
#: Below every score.
LOW = -(1 << 63) + 1
FOUND = "query long, vec_id long, score long"
RESULT = "query_id long, rank int, vec_id long, score long"


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of vectors of any width; those beyond 64 bits become the largest or smallest long."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    if most < 1 << 53:  # every partial sum is a whole double
        return np.rint(queries @ rows.T).astype(np.int64)
    if most < 1 << 62:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    whole = np.array([[int(x) for x in q] for q in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape).T
    return np.clip(whole, LOW + 1, (1 << 63) - 1).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def _augmenter(length: float):
    return lambda m: np.concatenate([m, np.sqrt(np.maximum(length - (m * m).sum(1), 0))[:, None]], 1)


def _most(reach: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The largest score that a gap leaves, with room for the rounding of the distances and within 64 bits as scores are."""
    most = (reach[:, None] - gap * gap) / 2
    return np.maximum(most + 1 + 1e-9 * np.abs(reach[:, None]), float(LOW))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query, ties to the smaller id.

    A component x counts as floor(scale * x). Queries are the rows whose id is divisible by `every`; a query's own row is
    no candidate. Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; a
    shorter vector counts as ended by zeros. Equal vectors and rows of a repeated id are rows of their own, as candidates
    and as queries. Other columns are ignored.

    The index holds every row under its nearest pivot and its distance from it, where a further component gives all
    rows one length M, so that the largest inner product is the smallest distance: |q - x|^2 = |q|^2 + M^2 - 2 q.x.
    Rows of a pivot are cut into annuli by distance. Pivots and the bounds of the annuli come from a sample of at most
    SAMPLE rows; every row is indexed. By the triangle inequality no row of an annulus is nearer to a query than the
    annulus is to the query's distance from its pivot. A query expands its annuli in the ascending order of that gap, in
    waves, and stops at the first that cannot reach its k-th score so far. A wave reads only the annuli that some query
    of the pass still asks for. Queries of near annuli share a pass, of bounded size, and are broadcast.
    """
    return TopK(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), k, every, scale).result()


class TopK:
    """The index of one call and how many pairs of a query and an annulus there are and were met; see top_k()."""

    def __init__(self, vectors: DataFrame, k: int, every: int, scale: int):
        self.spark, self.k, self.every = vectors.sparkSession, k, every
        self.scratch = C.Scratch(self.spark, "topk")
        self.pairs = self.met = 0
        rows = vectors.where("id is not null and v is not null")
        widest = self.widest = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                valid, values, bounds = rows_of(batch.column("v"))
                at = np.flatnonzero(valid)
                m = np.floor(scale * matrix(values, bounds, at, widest))
                who = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(who), batch.column("id").take(who), C.binaries(m.ravel(), np.arange(len(at) + 1) * widest), pa.array((m * m).sum(1))], ["row", "id", "m", "norm"]
                )

        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        self.numbers = self.scratch.write(numbered.mapInArrow(whole, "row long, id long, m binary, norm double"), "numbers")
        stats = self.numbers.agg(F.count("*").alias("n"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("m"), F.coalesce(F.sum((F.col("id") % every == 0).cast("long")), F.lit(0)).alias("q")).first()
        self.number, self.length, self.queries = stats["n"], stats["m"], stats["q"]

    def fit(self) -> None:
        """Pivots, each the farthest of the sample from those before, and the bounds of their annuli."""
        sample = self.numbers.orderBy(F.xxhash64("id"), "row").limit(SAMPLE).select("m").collect()
        wide = _augmenter(self.length)(np.array([np.frombuffer(r["m"], np.float64) for r in sample]).reshape(len(sample), self.widest))
        chosen, far = [0], np.full(len(wide), np.inf)
        while len(chosen) < min(PIVOTS, len(wide)):
            far = np.minimum(far, distances(wide, wide[chosen[-1:]])[:, 0])
            chosen.append(int(far.argmax()))
        self.pivots = wide[chosen]
        d = distances(wide, self.pivots)
        near = d.argmin(1)
        self.edges = np.stack([np.quantile(d[near == p, p], np.linspace(0, 1, ANNULI + 1)[1:-1]) if (near == p).any() else np.zeros(ANNULI - 1) for p in range(len(self.pivots))])

    def build(self) -> None:
        """The index, sorted by annulus and distance, and each annulus' least and largest distance (PIVOTS * ANNULI rows at most)."""
        widest, pivots, edges, augmented = self.widest, self.pivots, self.edges, _augmenter(self.length)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = C.flat(batch.column("m"))[0].view(np.float64).reshape(len(batch), widest)
                d = distances(augmented(m), pivots)
                p = d.argmin(1)
                d = d[np.arange(len(p)), p]
                ring = (d[:, None] > edges[p]).sum(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "m")), pa.array(p * ANNULI + ring), pa.array(d)], ["row", "id", "m", "ring", "d"])

        keys = self.numbers.mapInArrow(keyed, "row long, id long, m binary, ring long, d double")
        order = ["ring", "d", "row"]
        self.index = self.scratch.write(keys.repartitionByRange(C.parallelism(self.spark), *order).sortWithinPartitions(*order), "index")
        self.scratch.drop("numbers")
        rings = self.index.groupBy("ring").agg(F.min("d").alias("low"), F.max("d").alias("high")).orderBy("ring").collect()
        self.rings, self.low, self.high = (np.array([r[c] for r in rings]) for c in ("ring", "low", "high"))

    def search(self, block: object):
        """Candidates of a block of queries from the annuli that each asks for."""
        widest, pivots, length, k = self.widest, self.pivots, self.length, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, kth, rings, asks = block.value
            dq = distances(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots)
            reach = (q * q).sum(1) + length
            best_score = np.full((len(q), k), LOW)
            best_id = np.full((len(q), k), np.iinfo(np.int64).max)
            bound = kth.copy()
            for batch in batches:
                m = C.flat(batch.column("m"))[0].view(np.float64).reshape(len(batch), widest)
                row, who, ring, d = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("row", "id", "ring", "d"))
                cut = np.append(np.flatnonzero(np.append(True, ring[1:] != ring[:-1])), len(ring)) if len(ring) else np.zeros(1, np.int64)
                low, high, pivot = d[cut[:-1]], d[cut[1:] - 1], ring[cut[:-1]] // ANNULI
                gap = np.maximum(np.maximum(low - dq[:, pivot], dq[:, pivot] - high), 0)
                most = _most(reach, gap)
                for j in np.argsort(gap.min(0, initial=np.inf), kind="stable"):
                    active = np.flatnonzero(asks[:, np.searchsorted(rings, ring[cut[j]])] & (most[:, j] >= bound))
                    for a in range(cut[j], cut[j + 1], 2048):
                        b = min(a + 2048, cut[j + 1])
                        for part in np.array_split(active, max(1, len(active) // 1024)):
                            if not len(part):
                                continue
                            score = _scores(q[part], m[a:b])
                            score[ids[part][:, None] == row[a:b]] = LOW
                            score = np.concatenate([best_score[part], score], 1)
                            label = np.concatenate([best_id[part], np.broadcast_to(who[a:b], (len(part), b - a))], 1)
                            if score.shape[1] > 4 * k:
                                least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                                width = int((score >= least[:, None]).sum(1).max())  # k, and ties with the k-th
                                top = np.argpartition(score, score.shape[1] - width, axis=1)[:, score.shape[1] - width :]
                                score, label = np.take_along_axis(score, top, 1), np.take_along_axis(label, top, 1)
                            order = np.lexsort((label, -score), axis=1)[:, :k]
                            best_score[part], best_id[part] = np.take_along_axis(score, order, 1), np.take_along_axis(label, order, 1)
                            bound[part] = np.maximum(bound[part], best_score[part, k - 1])
            some = (best_score > LOW) & (best_score >= kth[:, None])
            i, col = np.nonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(best_id[i, col]), pa.array(best_score[i, col])], ["query", "vec_id", "score"])

        return run

    def result(self) -> DataFrame:
        if not self.number or not self.queries:
            return self.spark.createDataFrame([], RESULT)
        self.fit()
        self.build()
        passes = -(-self.queries * (8 * self.widest + len(self.rings) + 16) // PASS_BYTES)
        asked = self.index.where(F.col("id") % self.every == 0).select("row", "id", "m", "ring", "d").repartitionByRange(passes, "ring", "d", "row")
        asked = self.scratch.write(asked.select("row", "id", "m", F.spark_partition_id().alias("pass")), "asked")
        by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        found = None
        for b in range(passes):
            own = asked.where(F.col("pass") == b).select("row", "m").collect()
            ids = np.array([r["row"] for r in own], np.int64)
            q = np.array([np.frombuffer(r["m"], np.float64) for r in own]).reshape(len(own), self.widest)
            pivot = self.rings // ANNULI
            dq = distances(np.concatenate([q, np.zeros((len(q), 1))], 1), self.pivots)[:, pivot]
            gap = np.maximum(np.maximum(self.low - dq, dq - self.high), 0)
            most = _most((q * q).sum(1) + self.length, gap)
            place = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1, kind="stable")
            kth, mine = np.full(len(ids), LOW), None
            self.pairs += place.size
            for wave, (start, end) in enumerate(zip((0, *WAVES), (*WAVES, place.shape[1]))):
                asks = (place >= start) & (place < end) & (most >= kth[:, None])
                if not asks.any():
                    continue
                self.met += int(asks.sum())
                shared = self.spark.sparkContext.broadcast((ids, q, kth, self.rings, asks))
                met = self.index.where(F.col("ring").isin(self.rings[asks.any(0)].tolist())).mapInArrow(self.search(shared), FOUND)
                met = self.scratch.write(met.withColumn("r", F.row_number().over(by)).where(F.col("r") <= self.k).drop("r"), f"found{b}-{wave}")
                shared.unpersist()
                mine = met if mine is None else mine.unionByName(met)
                known = dict(mine.withColumn("r", F.row_number().over(by)).where(F.col("r") == self.k).select("query", "score").toLocalIterator())
                kth = np.array([known.get(i, LOW) for i in ids.tolist()], np.int64)
            found = mine if found is None else found.unionByName(mine) if mine is not None else found
        if found is None:
            return self.spark.createDataFrame([], RESULT)
        ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= self.k)
        return ranked.join(asked.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
