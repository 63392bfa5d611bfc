"""Near-duplicate vectors through a neighbour graph that NN-descent refines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .vectors import matrix, rows_of

#: Neighbours of a list, rounds of joins before an audit and in all, rows of a block of first neighbours.
LIST, ROUNDS, MOST_ROUNDS, BLOCK = 12, 5, 15, 512
#: Bytes of the vectors that a neighbour join holds, of a block that meets others in tiles, and of an audit's probes.
JOIN_BYTES, BLOCK_BYTES, PROBE_BYTES = 4 << 20, 1 << 20, 16 << 20
#: An audit's first number of probes, the links that it wants to see, and the share of them that must have been found.
PROBES, LINKS, RECALL = 256, 400, 0.995
EDGE = "a long, b long, sim double"
STATE = "row long, component long, full boolean"


def _unit(column: pa.Array, width: int) -> np.ndarray:
    return C.flat(column)[0].view(np.float64).reshape(len(column), width)


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).to_numpy(), np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least the
    threshold. A vector that is null, zero, or holds null or non-finite components links with nothing; one of fewer
    components counts as ended by zeros. n_links counts the other rows linked directly, component_id is the smallest id
    that links reach, kept marks the rows of that id. Rows of a repeated id are vectors of their own; rows with a null
    id are dropped; other columns are ignored.

    1. Equal vectors of a label are one class; its copies are counted, not paired.
    2. Lists of LIST neighbours start from blocks of vectors that fall on the same side of random planes.
    3. Each round joins a vector's neighbours with one another and keeps the best of each list, until hardly any new link
       appears.
    4. A list is saturated when all its places are links. Then it is enlarged by LIST places for vectors of other
       components than its own, which planes and rounds fill in the same way. What it misses within its component, step 6
       counts, so that a dense group needs no list of its own size.
    5. An audit holds probes, chosen by hash, against all vectors of their labels and tells the share of true links that
       lie within one component. Probes are added, PROBE_BYTES of vectors at a time, until LINKS links are seen or all
       vectors have been probes, so that rare links are met too. Below RECALL new planes and more rounds follow. Where MOST_ROUNDS have run without an audit that passed, step 6 takes all
       blocks of a label, which is exact and grows with the square of its vectors.
    6. Vectors lie in blocks, ordered by component. Blocks that share a component meet in tiles, unless the boxes of their
       vectors are further apart than a link is long, and all their links are counted.
    """
    return Descent(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")), threshold).result()


class Descent:
    """The tables of one call; see near_duplicates()."""

    def __init__(self, vectors: DataFrame, threshold: float):
        self.spark, self.threshold = vectors.sparkSession, threshold
        self.scratch = C.Scratch(self.spark, "descent")
        rows = vectors.where("id is not null")
        widest = self.widest = rows.where("label is not null").agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
        self.rounds, self.seeds, self.recall = 0, 0, None

        def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                valid, values, bounds = rows_of(batch.column("v"))
                at = np.flatnonzero(valid & np.asarray(batch.column("label").is_valid()))
                m = matrix(values, bounds, at, widest)
                m /= np.maximum(np.abs(m).max(1, initial=0), 1e-300)[:, None]  # else squares of tiny or huge components vanish or overflow
                norm = np.sqrt((m * m).sum(1))
                good = norm > 0
                at, m = at[good], m[good] / norm[good, None]
                place = np.full(len(batch), -1)
                place[at] = np.arange(len(at))
                u = C.binaries(m.ravel(), np.arange(len(at) + 1) * widest).take(pa.array(place, mask=place < 0))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), u], ["row", "id", "label", "u"])

        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        self.units = self.scratch.write(numbered.mapInArrow(unit, "row long, id long, label string, u binary"), "units")
        self.key = ["label", F.sha2("u", 256).alias("u")]
        some = self.units.where("u is not null")
        self.classes = self.scratch.write(some.groupBy(*self.key).agg(F.min("row").alias("rep"), F.min("id").alias("low"), F.count("*").alias("copies")), "classes")
        self.reps = self.scratch.write(some.drop("id").join(self.classes.select(F.col("rep").alias("row"), "copies"), "row"), "reps")
        self.number = self.reps.count()

    def best(self, edges: DataFrame, k: int, state: DataFrame | None) -> DataFrame:
        """The k best of each list, and of a full one also of its places for other components."""
        edges = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
        part = ["a"]
        if state is not None:
            own = state.select(F.col("row").alias("a"), F.col("component").alias("ca"), "full")
            edges = edges.join(own, "a", "left").join(state.select(F.col("row").alias("b"), F.col("component").alias("cb")), "b", "left")
            edges = edges.withColumn("other", F.coalesce("full", F.lit(False)) & ~F.col("ca").eqNullSafe(F.col("cb")))
            part.append("other")
        by = Window.partitionBy(*part).orderBy(F.desc("sim"), "b")
        return edges.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("a", "b", "sim")

    def placed(self, state: DataFrame | None) -> DataFrame:
        """(row, label, copies, u, component, full) of every class; one without links is a component of its own."""
        if state is None:
            return self.reps.select("row", "label", "copies", "u", F.col("row").alias("component"), F.lit(False).alias("full"), F.lit(True).alias("alone"))
        alone = F.col("component").isNull().alias("alone")
        return self.reps.join(state, "row", "left").select("row", "label", "copies", "u", F.coalesce("component", "row").alias("component"), F.coalesce("full", F.lit(False)).alias("full"), alone)

    def planes(self, state: DataFrame | None) -> DataFrame:
        """Neighbours within blocks of rows in the order of label and random signs."""
        widest, seed = self.widest, self.seeds
        self.seeds += 1

        def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plane = np.random.default_rng(seed).standard_normal((widest, 24))
            for batch in batches:
                bits = (_unit(batch.column("u"), widest) @ plane > 0).astype(np.int64) @ (1 << np.arange(24)[::-1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "label", "u", "component", "full")), pa.array(bits)], ["row", "label", "u", "component", "full", "bits"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                who, label, group = np.asarray(batch.column("row")), np.asarray(batch.column("label").dictionary_encode().indices), np.asarray(batch.column("component"))
                full, u = np.asarray(batch.column("full").cast(pa.int8())).astype(bool), _unit(batch.column("u"), widest)
                for a in range(0, len(who), BLOCK):
                    x, l, w, g, f = (y[a : a + BLOCK] for y in (u, label, who, group, full))
                    k = min(LIST, len(w) - 1)
                    if k < 1:
                        continue
                    sim = x @ x.T
                    sim[(l[:, None] != l) | f[:, None] & (g[:, None] == g)] = -2
                    np.fill_diagonal(sim, -2)
                    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                    s = np.take_along_axis(sim, near, 1)
                    row, col = np.nonzero(s > -2)
                    yield pa.RecordBatch.from_arrays([pa.array(w[row]), pa.array(w[near[row, col]]), pa.array(s[row, col])], ["a", "b", "sim"])

        order = self.placed(state).select("row", "label", "u", "component", "full").mapInArrow(signs, "row long, label string, u binary, component long, full boolean, bits long")
        order = order.repartitionByRange(C.parallelism(self.spark), "label", "bits", "row").sortWithinPartitions("label", "bits", "row")
        return order.mapInArrow(blocks, EDGE)

    def joined(self, graph: DataFrame, state: DataFrame | None) -> DataFrame:
        """Neighbours of neighbours: of each vector, the pairs among those near it that improve a list."""
        widest = self.widest
        both = graph.select("a", "b", "sim").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        points = self.placed(state).select(F.col("row").alias("b"), "u", "component", "full")
        if state is None:
            kept = graph
        else:  # a full list's own places are settled
            kept = graph.join(state.where("full").select(F.col("row").alias("a"), F.col("component").alias("ca")), "a", "left")
            kept = kept.join(state.select(F.col("row").alias("b"), F.col("component").alias("cb")), "b", "left").where("ca is null or cb is null or ca <> cb")
        last = kept.groupBy(F.col("a").alias("b")).agg(F.when(F.count("*") < LIST, -1.0).otherwise(F.min("sim")).alias("last"))
        points = points.join(last, "b", "left").withColumn("last", F.coalesce("last", F.lit(-1.0)))
        near = self.best(both, 2 * LIST, state).join(points, "b").select("a", "b", "u", "last", "component", "full")

        def pairs(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by("a")
            a, b, group = (_longs(table, c) for c in ("a", "b", "component"))
            last, full = table.column("last").to_numpy(), table.column("full").to_numpy().astype(bool)
            u = _unit(table.column("u").combine_chunks(), widest) if len(a) else np.zeros((0, widest))
            out: list[tuple[np.ndarray, ...]] = []
            cut = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
            for x, y in zip(cut[:-1], cut[1:]):
                sim = u[x:y] @ u[x:y].T
                np.fill_diagonal(sim, -2)
                good = sim > last[x:y][:, None]
                if full[x:y].any():
                    good &= ~(full[x:y][:, None] & (group[x:y][:, None] == group[x:y]))
                row, col = np.nonzero(good)
                out.append((b[x:y][row], b[x:y][col], sim[row, col]))
            a, b, s = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.float64)))
            order = np.lexsort((b, -s, a))  # each list takes LIST of them at most, so more need not be sent
            a, b, s = a[order], b[order], s[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
            a, b, s = a[new], b[new], s[new]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            top = rank < 2 * LIST
            return pa.table({"a": a[top], "b": b[top], "sim": s[top]})

        buckets = max(1, self.number * 3 * LIST * 8 * widest // JOIN_BYTES)
        return near.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda t: pairs(t), EDGE)

    def links(self, graph: DataFrame) -> DataFrame:
        return graph.where(F.col("sim") >= self.threshold).select("a", "b")

    def descend(self, graph: DataFrame, state: DataFrame | None) -> DataFrame:
        """Rounds of joins until hardly any new link appears, ROUNDS at most."""
        found = self.links(graph).count()
        for k in range(ROUNDS):
            self.rounds += 1
            more = self.joined(graph, state)
            if k % 2:
                more = more.unionByName(self.planes(state))
            graph = self.scratch.write(self.best(graph.unionByName(more), LIST, state), f"graph{self.rounds}")
            now = self.links(graph).count()
            if now - found <= 0.002 * now:
                break
            found = now
        return graph

    def state(self, graph: DataFrame, before: DataFrame | None) -> DataFrame:
        """(row, component, full) of the vectors with links; components only grow from one state to the next."""
        edges = self.links(graph)
        if before is not None:
            edges = edges.unionByName(before.select(F.col("row").alias("a"), F.col("component").alias("b")))
        name = f"state{self.rounds}"
        labels = C.components(self.spark, edges, self.scratch, name)
        full = self.links(graph).groupBy(F.col("a").alias("id")).agg((F.count("*") >= LIST).alias("full"))
        if before is not None:
            full = full.unionByName(before.where("full").select(F.col("row").alias("id"), "full")).groupBy("id").agg(F.max("full").alias("full"))
        found = labels.join(full, "id", "left").select(F.col("id").alias("row"), "component", F.coalesce("full", F.lit(False)).alias("full"))
        return self.scratch.write(found, name)

    def blocks(self, state: DataFrame | None) -> DataFrame:
        """Rows of one label each: a block's vectors, with their components in ascending order, those without links apart, and their box."""
        widest = self.widest
        place = ["label", "alone", "component", "row"]
        order = self.placed(state).select("row", "label", "copies", "u", "alone", "component")
        order = order.repartitionByRange(C.parallelism(self.spark), *place).sortWithinPartitions(*place)
        most = max(256, BLOCK_BYTES // (8 * max(widest, 1)))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                code = np.asarray(batch.column("label").dictionary_encode().indices).astype(np.int64) * 2 + np.asarray(batch.column("alone").cast(pa.int8()))
                edge = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code)) if len(code) else np.zeros(0, np.int64)
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    for a in range(x, y, most):
                        some = batch.slice(a, min(most, y - a))
                        u, group = _unit(some.column("u"), widest), np.asarray(some.column("component"))
                        held = [np.asarray(some.column(c)).tobytes() for c in ("row", "copies", "component")] + [u.tobytes()]
                        box = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (u.min(0), u.max(0))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([number]), some.column("label").slice(0, 1), some.column("alone").slice(0, 1), pa.array([int(group[0])]), pa.array([int(group[-1])]), *(pa.array([h], pa.binary()) for h in held), *box],
                            ["block", "label", "alone", "first", "last", "rows", "copies", "components", "u", "low", "high"],
                        )
                        number += 1

        form = "block long, label string, alone boolean, first long, last long, rows binary, copies binary, components binary, u binary, low array<double>, high array<double>"
        return self.scratch.write(order.mapInArrow(cut, form), f"blocks{self.rounds}")

    def audit(self, blocks: DataFrame) -> float:
        """The share of the probes' true links within components.

        Probes grow until LINKS links are seen. Where as many as PROBE_BYTES hold see fewer, slices of all vectors by hash, each
        of that size, are the probes one after another, and what they see adds up, until it is enough or all have been probes.
        """
        most, n = max(PROBES, PROBE_BYTES // (8 * max(self.widest, 1))), PROBES
        while True:
            seen, hit = self.links_of(blocks, self.reps.orderBy(F.xxhash64("row", F.lit(self.rounds)), "row").limit(n))
            if seen >= LINKS or n >= self.number:
                return hit / seen if seen else 1.0
            if n >= most:
                break
            n = min(4 * n, most)
        seen = hit = 0
        slices = -(-self.number // most)
        for k in range(slices):
            more = self.links_of(blocks, self.reps.where(F.pmod(F.xxhash64("row", F.lit(self.rounds)), F.lit(slices)) == k))
            seen, hit = seen + more[0], hit + more[1]
            if seen >= LINKS:
                break
        return hit / seen if seen else 1.0

    def links_of(self, blocks: DataFrame, probes: DataFrame) -> tuple[int, int]:
        """How many links to any vector the probes have, and how many of these lie within a component."""
        widest, threshold = self.widest, self.threshold
        probes = probes.select("row", "label", "u").collect()
        u = np.frombuffer(b"".join(r["u"] for r in probes)).reshape(len(probes), widest)
        shared = self.spark.sparkContext.broadcast((np.array([r["row"] for r in probes], np.int64), np.array([r["label"] for r in probes]), u))

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who, label, u = shared.value
            for batch in batches:
                for x in batch.to_pylist():
                    mine = np.flatnonzero(label == x["label"])
                    rows, group = np.frombuffer(x["rows"], np.int64), np.frombuffer(x["components"], np.int64)
                    sim = u[mine] @ np.frombuffer(x["u"]).reshape(len(rows), widest).T
                    probe, row = np.nonzero((sim >= threshold) & (who[mine][:, None] != rows))
                    key, count = np.unique(np.stack([who[mine][probe], group[row]], 1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array(count)], ["probe", "component", "n"])

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who = shared.value[0]
            for batch in batches:
                for x in batch.to_pylist():
                    rows, group = np.frombuffer(x["rows"], np.int64), np.frombuffer(x["components"], np.int64)
                    mine = np.isin(rows, who)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[mine]), pa.array(group[mine])], ["probe", "of"])

        true = blocks.select("label", "rows", "components", "u").mapInArrow(pairs, "probe long, component long, n long").groupBy("probe", "component").agg(F.sum("n").alias("n"))
        mine = blocks.select("rows", "components").mapInArrow(own, "probe long, of long")
        seen, hit = true.join(mine, "probe").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("component") == F.col("of"), F.col("n"))), F.lit(0))).first()
        shared.unpersist()
        return seen, hit

    def counted(self, blocks: DataFrame, whole: bool) -> DataFrame:
        """(a, b, linked): of a class its links within the tiles, and (a, b) the components that a link joins.

        Tiles are the blocks that share a component, or with `whole` all of a label whose boxes are near enough.
        """
        widest, threshold = self.widest, self.threshold
        heads = blocks.select("block", "label", "first", "last", "low", "high") if whole else blocks.where("not alone").select("block", "label", "first", "last", "low", "high")
        far = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors that are no link
        gap = "aggregate(sequence(0, size(l.low) - 1), 0D, (s, k) -> s + pow(greatest(0D, l.low[k] - r.high[k], r.low[k] - l.high[k]), 2))"
        if whole:
            on, left, right = "l.label = r.label and l.block < r.block", heads, heads
        else:  # a component that goes on from a block ends that block and begins the next
            right = heads
            left = heads.withColumn("component", F.col("last"))
            on = "l.component = r.first and l.block < r.block"
        pairs = left.alias("l").join(right.alias("r"), F.expr(f"{on} and {gap} <= {far}")).select(F.col("l.block").alias("i"), F.col("r.block").alias("j"))
        pairs = pairs.unionByName(heads.select(F.col("block").alias("i"), F.col("block").alias("j")))
        near = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        tiles = near.join(blocks.select("block", "rows", "copies", "components", "u"), "block")

        def count(table: pa.Table) -> pa.Table:
            table = table.sort_by("block")
            held = [[np.frombuffer(table.column(c)[k].as_py(), np.int64) for c in ("rows", "copies", "components")] + [np.frombuffer(table.column("u")[k].as_py()).reshape(-1, widest)] for k in range(len(table))]
            (who, copies, group, u), (other, weight, to, v) = held[0], held[-1]
            total, across = np.zeros(len(who), np.int64), np.zeros(len(other), np.int64)
            joins = [np.zeros((0, 2), np.int64)]
            for a in range(0, len(who), BLOCK):
                part = slice(a, a + BLOCK)
                hit = (u[part] @ v.T >= threshold) & (who[part][:, None] != other)
                total[part] += hit @ weight
                across += copies[part] @ hit
                row, col = np.nonzero(hit & (group[part][:, None] != to))
                joins.append(np.unique(np.stack([group[part][row], to[col]], 1), axis=0))
            if len(held) == 2:
                who, total = np.concatenate([who, other]), np.concatenate([total, across])
            some, joined = total > 0, np.unique(np.concatenate(joins), axis=0)
            return pa.table({
                "a": pa.array(np.concatenate([who[some], joined[:, 0]])),
                "b": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(np.ascontiguousarray(joined[:, 1]))]),
                "linked": pa.concat_arrays([pa.array(total[some]), pa.nulls(len(joined), pa.int64())]),
            })

        return self.scratch.write(tiles.groupBy("i", "j").applyInArrow(lambda t: count(t), "a long, b long, linked long"), "counted")

    def search(self) -> tuple[DataFrame | None, DataFrame, bool]:
        """The last state, the blocks by it, and whether an audit has passed them."""
        graph = self.scratch.write(self.best(self.planes(None).unionByName(self.planes(None)), LIST, None), "graph0")
        graph = self.descend(graph, None)
        state = self.state(graph, None)
        while True:
            if not state.where("full").isEmpty():
                graph = self.scratch.write(self.best(graph.unionByName(self.planes(state)), LIST, state), f"wide{self.rounds}")
                graph = self.descend(graph, state)
                state = self.state(graph, state)
            blocks = self.blocks(state)
            self.recall = self.audit(blocks)
            if self.recall >= RECALL or self.rounds >= MOST_ROUNDS:
                return state, blocks, self.recall >= RECALL
            more = self.planes(state).unionByName(self.planes(state))
            graph = self.scratch.write(self.best(graph.unionByName(more), LIST, state), f"again{self.rounds}")
            graph = self.descend(graph, state)
            state = self.state(graph, state)

    def result(self) -> DataFrame:
        scratch = self.scratch
        labels = linked = None
        if self.number > 1:
            state, blocks, passed = self.search()
            counted = self.counted(blocks, not passed)
            linked = counted.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("linked").alias("linked"))
            merged = C.components(self.spark, counted.where("b is not null").select("a", "b"), scratch, "merged")
            labels = self.placed(state).select("row", "component").join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
            labels = labels.select(F.col("row").alias("rep"), F.coalesce("to", "component").alias("component"))
        else:
            labels = self.reps.select(F.col("row").alias("rep"), F.col("row").alias("component"))
            linked = labels.select("rep", F.lit(0).cast("long").alias("linked")).where("false")
        groups = scratch.write(self.classes.join(labels, "rep").join(linked, "rep", "left").select("label", "u", "component", "low", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "groups")
        low = groups.groupBy("component").agg(F.min("low").alias("low"))
        groups = groups.drop("low").join(low, "component")
        result = self.units.select("id", *self.key).join(groups, ["label", "u"], "left")
        own = F.coalesce("low", "id")
        return result.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("id") == own).alias("kept"))
