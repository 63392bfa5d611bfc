"""Hard negatives by bit-sliced integer inner products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .vectors import unpacked, whole_numbers

#: Candidates of a block and their bytes at most, anchors of a group and their bytes at most, bytes of the blocks that meet a group in one task.
BLOCK, BLOCK_BYTES, GROUP, GROUP_BYTES, STRIPE_BYTES = 4096, 4 << 20, 512, 4 << 20, 64 << 20
#: Share of the pairs of a group and a block below which those that are left are handled one by one.
SPARSE = 0.04
FOUND = "anchor long, place int, row long, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def limit_of(width: int) -> int:
    """The largest component for which every inner product is a long."""
    return 1 << int((61 - math.log2(max(width, 1))) // 2)


def sliced(x: np.ndarray, planes: int) -> bytes:
    """The bit planes of two's complement integers, the sign's first, each packed to whole bytes."""
    return b"".join(np.packbits((x >> j & 1).astype(np.uint8).ravel()).tobytes() for j in range(planes - 1, -1, -1))


class Best:
    """For each anchor and each of its windows [low, high] the k highest scores found so far, ties to the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.kth = np.full(low.shape, np.iinfo(np.int64).min)
        z = np.zeros(0, np.int64)
        self.found = (z, z, z, z)  # anchor * windows + window, score, id, row
        self.dropped = [0, 0]  # pairs, and those that were dropped before their last plane

    def floor(self) -> np.ndarray:
        return np.maximum(self.low, self.kth)

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        n, parts = self.low.shape[1], [self.found]
        for w in range(n):
            fits = np.flatnonzero((score >= self.floor()[anchor, w]) & (score <= self.high[anchor, w]))
            parts.append((anchor[fits] * n + w, score[fits], ids[fits], rows[fits]))
        key, score, ids, rows = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((rows, ids, -score, key))
        key, score = key[order], score[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        self.kth.ravel()[key[rank == self.k - 1]] = score[rank == self.k - 1]
        held = rank < self.k
        self.found = (key[held], score[held], ids[order][held], rows[order][held])


def tightened(best: Best, anchor: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of each anchor and window the k-th highest lower bound of pairs that are surely inside, or what is known already."""
    kth = best.floor()
    for w in range(kth.shape[1]):
        sure = np.flatnonzero((least >= kth[anchor, w]) & (most <= best.high[anchor, w]))
        order = sure[np.lexsort((-least[sure], anchor[sure]))]
        own = anchor[order]
        at = order[np.arange(len(own)) - np.searchsorted(own, own) == best.k - 1]
        kth[anchor[at], w] = np.maximum(kth[anchor[at], w], least[at])
    return kth


def search(a: np.ndarray, best: Best, block: tuple[np.ndarray, np.ndarray, bytes], allowed: np.ndarray, planes: int) -> None:
    """Holds the anchors a to a block (rows, ids, bit planes) and adds what qualifies to best; allowed tells the pairs that count.

    After the planes down to bit j a score is known up to what the lower bits can add, from (2**j - 1) times the sum of the
    anchor's negative components to as much of its positive ones. A pair goes once this interval lies outside of every
    window or below the k-th highest lower bound of the pairs that are surely inside.
    """
    rows, ids, packed = block
    width, size = a.shape[1], -(-len(rows) * a.shape[1] // 8)
    bound = int(np.abs(a).sum(1).max(initial=0)) << planes
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    factor = a.astype(np.float32 if bound < 1 << 24 else np.float64)
    down, up = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
    alive, cols = allowed, np.arange(len(rows))
    score: np.ndarray = np.zeros(allowed.shape, kind)
    pairs = None
    best.dropped[0] += int(allowed.sum())
    for j in range(planes - 1, -1, -1):
        start = (planes - 1 - j) * size
        bits = np.unpackbits(np.frombuffer(packed, np.uint8, size, start))[: len(rows) * width].reshape(len(rows), width)
        step = -(1 << j) if j == planes - 1 else 1 << j
        rest = (1 << j) - 1
        if pairs is None:
            score += (step * (factor @ bits[cols].astype(factor.dtype).T)).astype(kind)
            least, most = score + (rest * down)[:, None].astype(kind), score + (rest * up)[:, None].astype(kind)
            floor = best.floor()
            if best.low.shape[1] == 1 and score.shape[1] >= best.k:  # one window without an upper end: the k-th lower bound of the block counts too
                own = np.where(alive & (most <= best.high), least, -np.inf if kind != np.int64 else np.iinfo(np.int64).min)
                kth = np.partition(own, own.shape[1] - best.k, axis=1)[:, own.shape[1] - best.k]
                floor = np.maximum(floor, np.where(np.isfinite(kth), kth, -(2.0**62)).astype(np.int64)[:, None])
            # a bound is at least as low, and the floors are, in the scores' own numbers
            alive = alive & (most >= floor.min(1).astype(kind)[:, None]) & (least <= best.high.max(1).astype(kind)[:, None])
            some = alive.any(0)
            if not some.all():
                alive, score, cols = alive[:, some], score[:, some], cols[some]
            if j == 0 or alive.sum() < SPARSE * alive.size:
                i, c = np.nonzero(alive)
                pairs, score = (i, cols[c]), score[i, c].astype(np.int64)
        else:
            i, c = pairs
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                score[part] += step * np.rint(np.einsum("pd,pd->p", factor[i[part]], bits[c[part]].astype(factor.dtype))).astype(np.int64)
        if pairs is not None and j:
            i, c = pairs
            least, most = score + rest * down[i], score + rest * up[i]
            floor = tightened(best, i, least, most)
            keep = ((most[:, None] >= floor[i]) & (least[:, None] <= best.high[i])).any(1)
            pairs, score = (i[keep], c[keep]), score[keep]
        if (len(pairs[0]) if pairs is not None else alive.size) == 0:
            break
    i, c = pairs if pairs is not None else (np.zeros(0, np.int64),) * 2
    best.dropped[1] += int(allowed.sum()) - len(i)
    best.add(i, score if pairs is not None else np.zeros(0, np.int64), ids[c], rows[c])


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, a row whose id is divisible by `every`.

    Scores are inner products of the components floor(scale * x). An anchor's positives are the `positives` other rows of
    its label with the highest scores, its negatives for each of them the first `negatives` rows of other labels whose score
    is low to high percent of the positive's; higher scores come first, ties by the smaller id. All, if there are fewer.

    Rows with a null id or label, and vectors that are null or hold null or non-finite components take no part; shorter
    vectors end in zeros. Components beyond limit_of(width), where products would leave 64 bits, count as that limit. Equal
    vectors and rows of a repeated id are rows of their own. Labels are compared as strings. Other columns are ignored. An
    empty table gives no rows.

    Candidates stand in blocks of one label as bit planes. Groups of anchors meet stripes of blocks in the cells of a grid,
    one task each, of bounded size; a label of very many rows has more cells. The first grid holds anchors to the rows of
    their label, the second, whose windows come from the first one's scores, to those of the others. See search().
    """
    spark = vectors.sparkSession
    scratch = C.Scratch(spark, "mining")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).where("id is not null and label is not null")
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    width = max(width, 0)
    numbers = scratch.write(whole_numbers(rows, scale, width, limit_of(width), {"id": "long", "label": "string"}), "numbers")
    number, largest = numbers.agg(F.count("*"), F.coalesce(F.max("most"), F.lit(0))).first()
    if not number:
        return spark.createDataFrame([], RESULT)
    planes = int(largest).bit_length() + 1
    row_bytes = max(1, width * planes // 8)
    tile = max(1, min(BLOCK, BLOCK_BYTES // row_bytes))
    stripe = min(max(tile, number // (2 * C.parallelism(spark))), max(tile, STRIPE_BYTES // row_bytes))
    group = max(1, min(GROUP, GROUP_BYTES // max(1, 8 * width)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = unpacked(t.column("x").chunk(0), width)
            row, who = (np.asarray(t.column(c).to_numpy(), np.int64) for c in ("row", "id"))
            return pa.RecordBatch.from_arrays([pa.array([t.column("label")[0].as_py()]), pa.array(row[:1]), pa.array([row.tobytes()], pa.binary()), pa.array([who.tobytes()], pa.binary()), pa.array([sliced(x, planes)], pa.binary())], ["label", "first", "rows", "ids", "planes"])

        for batch in batches:
            label = np.array(batch.column("label").to_pylist(), object)
            if not len(label):
                continue
            edges = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and held[0].column("label")[0].as_py() != label[a]:
                    yield block()
                while a < b:
                    n = min(b - a, tile - sum(len(h) for h in held))
                    held.append(batch.slice(a, n))
                    a += n
                    if sum(len(h) for h in held) == tile:
                        yield block()
        if held:
            yield block()

    dealt = numbers.select("row", "id", "label", "x").repartitionByRange(C.parallelism(spark), "label", "row").sortWithinPartitions("label", "row")
    blocks = scratch.write(dealt.mapInArrow(pack, "label string, first long, rows binary, ids binary, planes binary"), "blocks")
    asked = numbers.where(F.col("id") % every == 0).select("row", "label", "x")

    def run(k: int, other: bool):
        def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
            anchors, candidates = anchors.combine_chunks(), candidates.combine_chunks()
            if not len(anchors) or not len(candidates):
                return pa.table({"anchor": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "row": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
            own = np.asarray(anchors.column("row").to_numpy(), np.int64)
            a, labels = unpacked(anchors.column("x").chunk(0), width), np.array(anchors.column("label").to_pylist(), object)
            if other:
                lows, highs = anchors.column("lows").to_pylist(), anchors.column("highs").to_pylist()
                most = max(map(len, lows))
                lo, hi = np.full((len(own), most), 1), np.full((len(own), most), 0)  # what an anchor lacks is an empty window
                for n, (x, y) in enumerate(zip(lows, highs)):
                    lo[n, : len(x)], hi[n, : len(y)] = x, y
            else:
                lo, hi = np.full((len(own), 1), -(1 << 62)), np.full((len(own), 1), 1 << 62)
            best = Best(lo, hi, k)
            for c in candidates.sort_by("first").to_pylist():
                rows, ids = np.frombuffer(c["rows"], np.int64), np.frombuffer(c["ids"], np.int64)
                allowed = np.broadcast_to(((labels != c["label"]) if other else (labels == c["label"]))[:, None], (len(own), len(rows))).copy()
                if not other:
                    allowed &= own[:, None] != rows
                if allowed.any():
                    search(a, best, (rows, ids, c["planes"]), allowed, planes)
            key, score, ids, rows = best.found
            return pa.table({"anchor": own[key // lo.shape[1]], "place": (key % lo.shape[1]).astype(np.int32), "row": rows, "id": ids, "score": score})

        return cell

    def parts(count: str, size: int):
        return F.greatest(F.ceil(F.col(count) / size), F.lit(1)).cast("long")

    cells = numbers.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("a")).where("a > 0")
    cells = cells.select("label", parts("a", group).alias("groups"), parts("n", stripe).alias("stripes"))

    def dealt_to(df: DataFrame, key: str, own: str, own_n, other: str, other_n) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), own_n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), other_n - 1)))

    def grid(anchors: DataFrame, candidates: DataFrame, by: list[str], k: int, other: bool) -> DataFrame:
        found = anchors.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(run(k, other), FOUND)
        rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    near = asked.join(cells, "label"), blocks.join(cells, "label")
    near = dealt_to(near[0], "row", "g", F.col("groups"), "s", F.col("stripes")), dealt_to(near[1], "first", "s", F.col("stripes"), "g", F.col("groups"))
    first = grid(near[0].drop("groups", "stripes"), near[1].drop("groups", "stripes"), ["label", "g", "s"], positives, False)
    first = scratch.write(first.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    whole, rest = F.expr("(positive_score - pmod(positive_score, 100)) div 100"), F.pmod("positive_score", F.lit(100))
    least, most = whole * low + F.ceil(rest * low / 100), whole * high + F.floor(rest * high / 100)  # no product leaves 64 bits
    windows = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", least.cast("long").alias("low"), most.cast("long").alias("high")))).alias("w"))
    windows = windows.select(F.col("anchor").alias("row"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    groups, stripes = (F.lit(n).cast("long") for n in (-(-asked.count() // group) or 1, -(-number // stripe)))
    anchors = dealt_to(asked.join(windows, "row"), "row", "g", groups, "s", stripes)
    second = grid(anchors, dealt_to(blocks, "first", "s", stripes, "g", groups), ["g", "s"], negatives, True)
    second = second.select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = numbers.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")).where(F.col("anchor_id") % every == 0)
    return second.join(first, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
