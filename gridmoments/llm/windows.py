"""Removal of word windows that an earlier document has, behind a count-min sketch of all windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text of a chunk, and of the text whose windows make up one shard of the sketch.
CHUNK, SHARD = 4 << 20, 16 << 20
#: Chunks in a file: Spark's reader decodes a file's rows at once, so that a task's memory would follow the row groups of the input.
FILE_CHUNKS = 8
#: Lines of the sketch; each has for every shard the power of two of counters that is next to its bytes of text.
LINES = 2
#: Windows that are grouped at once.
PART = 1 << 19
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
#: Odd factors of a window's words, one row for each of two independent hashes.
_FACTORS = C.mixed(np.arange(1, 2049, dtype=np.uint64)).reshape(2, 1024) | np.uint64(1)
_SALTS = C.mixed(np.arange(77, 77 + 16, dtype=np.uint64))
_EXACT = np.dtype([("a", "<u8"), ("b", "<u4")])
_PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


def packed_rows(rows: pa.RecordBatch) -> bytes:
    """The rows as one compressed value, so that Spark stores, shuffles and sorts fewer bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_PACKED) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked_rows(data: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unsigned value as groups of seven bits, the lowest first, and the bounds of the values in these bytes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    bounds = np.append(0, np.cumsum(size))
    out = np.zeros(bounds[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        more = (size[some] > k + 1).astype(np.uint8) << 7
        out[bounds[:-1][some] + k] = (values[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out, bounds


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.append(0, last[:-1] + 1)[: len(last)]
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, first) if len(first) else np.zeros(0, np.uint64)


class Sketch:
    """One line of a shard of the count-min sketch, with counters that stop at 2."""

    def __init__(self, counters: int):
        self.counts = np.zeros(counters, np.uint8)

    @staticmethod
    def packed(cells: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Ascending cells and whether they count twice or more, as bytes."""
        return varints(np.diff(cells, prepend=0) * 2 + many)[0]

    @staticmethod
    def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        codes = from_varints(data).astype(np.int64)
        return np.cumsum(codes >> 1), codes & 1

    def add(self, cells: np.ndarray, many: np.ndarray) -> None:
        self.counts[cells] = np.minimum(self.counts[cells] + 1 + many, 2)

    def repeated(self, cells: np.ndarray) -> np.ndarray:
        return self.counts[cells] > 1


class Chunk:
    """Words and windows of a chunk of texts: `hashes` are its distinct windows in ascending order, `low` the smallest id of each and `high` the largest."""

    def __init__(self, ids: pa.Array, texts: pa.Array, words: int):
        texts = [t.as_buffer() if t.is_valid else b"" for t in texts]
        self.raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)  # every text ends in a separator
        self.at = np.append(0, np.cumsum([len(t) + 1 for t in texts])).astype(np.int64)
        known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
        self.ids = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        self.starts, self.ends, word = self._words()
        bounds = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(bounds)
        self.first = bounds[:-1]
        n = np.where(known, np.maximum(self.counts - words + 1, 0), 0)
        self.text = np.repeat(np.arange(len(n)), n)
        self.place = np.repeat(self.first - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())  # the window's first word
        a, b = (self._windows(word, f[:words]) for f in _FACTORS)
        a, own = a[self.place], self.ids[self.text]
        order = np.argsort(a, kind="stable")
        new = np.append(True, a[order][1:] != a[order][:-1])[: len(a)]
        head = np.flatnonzero(new)
        self.of = np.empty(len(a), np.int64)  # the distinct window of each
        self.of[order] = np.cumsum(new) - 1
        self.hashes, self.check = a[order[head]], (b[self.place[order[head]]] >> np.uint64(32)).astype(np.uint32)
        self.low, self.high = (f.reduceat(own[order], head) if len(head) else np.zeros(0, np.int64) for f in (np.minimum, np.maximum))

    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of all words, some CHUNK_BYTES of text at a time; a word is never cut."""
        found, lo = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
        while lo < len(self.raw):
            hi = min(lo + C.CHUNK_BYTES, len(self.raw))
            while True:
                gaps = np.flatnonzero(_SEPARATOR[self.raw[lo:hi]])
                if len(gaps) or hi == len(self.raw):
                    break
                hi = min(lo + 2 * (hi - lo), len(self.raw))
            hi = lo + int(gaps[-1]) + 1
            raw = self.raw[lo:hi]
            edge = np.diff((~_SEPARATOR[raw]).astype(np.int8), prepend=0)  # the last byte is a separator
            a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            s = C.rolling(raw)
            found.append((a + lo, b + lo, C.mixed((s[b] - s[a]) * C.powers(len(raw) + 1)[1][a] + (b - a).astype(np.uint64))))
            lo = hi
        return tuple(np.concatenate(c) for c in zip(*found))

    @staticmethod
    def _windows(word: np.ndarray, factors: np.ndarray) -> np.ndarray:
        n = max(len(word) - len(factors) + 1, 0)
        h = np.zeros(n, np.uint64)
        for k, f in enumerate(factors):
            h += word[k : n + k] * f
        return C.mixed(h)

    def shards(self, number: int) -> np.ndarray:
        """The shard of each distinct window, ascending as the hashes are."""
        return ((self.hashes >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)).astype(np.int64)

    def cells(self, line: int, number: int, counters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(shard, cell, many, of) of a line of the sketch: its cells in ascending order by shard, whether a cell counts twice, and the cell of each distinct window."""
        cell = C.mixed(self.hashes ^ _SALTS[line]) & np.uint64(counters - 1)
        key = (self.shards(number).astype(np.uint64) << np.uint64(32)) | cell
        key, of, count = np.unique(key, return_inverse=True, return_counts=True)
        many = (count > 1) | (np.bincount(of, self.high > self.low, len(key)) > 0)
        return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), many, of

    def estimates(self, replies: dict[tuple[int, int], bytes], number: int, counters: int) -> np.ndarray:
        """Of each distinct window whether all lines of the sketch count it twice or more."""
        out = np.ones(len(self.hashes), bool)
        for line in range(LINES):
            shard, _, _, of = self.cells(line, number, counters)
            out &= unbits(replies, line, shard)[of]
        return out


def runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each run of equal keys."""
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    yield from zip(keys[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(keys)])


def parts(low: int, high: int, number: int) -> np.ndarray:
    """The bounds between so many equal parts of the hashes from low to high."""
    return np.array([low + (high - low + 1) * k // number for k in range(1, number)], np.uint64)


def unbits(replies: dict[tuple[int, int], bytes], line: int, shard: np.ndarray) -> np.ndarray:
    """The answers of a line for ascending shards, one for each element."""
    got = [np.unpackbits(np.frombuffer(replies[line, k], np.uint8), count=b - a) for k, a, b in runs(shard)]
    return np.concatenate(got).astype(bool) if got else np.zeros(0, bool)


def earlier_windows(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of every document without the words of windows that a document of a smaller id has.

    Words are runs of other bytes than 0x20 and 0x09-0x0D. A window is `words` consecutive words of one document; each word
    of a window whose words also start in a document with a smaller id goes, as the input stands. spans are the runs of
    removed words, [a, b) by number, and kept is the other words joined by one space.

    Null and empty texts have no words. Documents of equal ids take nothing from each other, and rows with a null id neither
    take nor lose words; repeated rows stay rows of their own. Other columns are ignored.

    The first pass counts every chunk's windows, each once or, if two ids of the chunk have it, twice, on a count-min
    sketch. Windows belong to shards by hash, and the number of shards follows the bytes of text; a chunk sends each shard
    its cells, ascending, as packed steps. A shard's lists add up to counters that never fall short, and it answers each
    chunk with one bit a cell. The second pass sends the windows that every line of the sketch counts twice to their shards
    with 96 bits of hash and the chunk's smallest id, and these group them exactly: one bit back tells that another chunk
    has the window under a smaller id. A window that is left out was met under one id only. Texts travel in chunks; no task
    holds more than a shard, and a window of very many documents is one entry for each chunk. A chunk is one compressed
    value, files have a few of them whatever the input's files are, and a shard's windows are grouped in parts.
    """
    if not 0 < words <= _FACTORS.shape[1]:
        raise ValueError(f"a window has 1 to {_FACTORS.shape[1]} words")
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "windows")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in C.pieces(batch, "text", CHUNK):
                size = pa.array([len(C.flat(piece.column("text"))[0])], pa.int64())
                yield pa.RecordBatch.from_arrays([size, pa.array([packed_rows(piece)], pa.binary())], ["size", "rows"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    packed = rows.mapInArrow(pack, "size long, rows binary").withColumn("chunk", F.monotonically_increasing_id())
    chunks = scratch.write(packed, "chunks", compression="uncompressed", maxRecordsPerFile=FILE_CHUNKS)
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    number = size // SHARD + 1
    counters = 1 << max(12, (size // number).bit_length())

    def each(kernel: Callable) -> Callable:
        """The kernel over the chunks of a task, with the shards' answers where these are joined."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    rows = unpacked_rows(batch.column("rows")[k].as_buffer())
                    ids, replies = rows.column("id"), {}
                    if "replies" in batch.schema.names:
                        replies = {(r["line"], r["shard"]): r["bits"] for r in batch.column("replies")[k].as_py() or []}
                    yield from kernel(batch.column("chunk")[k].as_py(), Chunk(ids, rows.column("text"), words), ids, replies)

        return run

    def count(chunk: int, c: Chunk, ids: pa.Array, replies: dict) -> Iterator[pa.RecordBatch]:
        for line in range(LINES):
            shard, cell, many, _ = c.cells(line, number, counters)
            for k, a, b in runs(shard):
                data = Sketch.packed(cell[a:b], many[a:b]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([line], pa.int32()), pa.array([chunk]), pa.array([data], pa.binary())], ["shard", "line", "chunk", "cells"])

    def add_up(lists: pa.Table) -> pa.Table:
        sketch = Sketch(counters)
        cells = []
        for data in lists.column("cells"):
            cell, many = Sketch.unpacked(data.as_buffer())
            sketch.add(cell, many)
            cells.append(cell.astype(np.uint32))
        bits = pa.array([np.packbits(sketch.repeated(c)).tobytes() for c in cells], pa.binary())
        return pa.table({"chunk": lists.column("chunk"), "shard": lists.column("shard"), "line": lists.column("line"), "bits": bits})

    reply = "chunk long, shard long, line int, bits binary"
    lists = chunks.select("chunk", "rows").mapInArrow(together(each(count)), "shard long, line int, chunk long, cells binary")
    estimated = scratch.write(lists.groupBy("shard", "line").applyInArrow(add_up, reply), "estimated")
    scratch.release()

    def with_replies(answers: DataFrame) -> DataFrame:
        by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "line", "bits")).alias("replies"))
        return chunks.select("chunk", "rows").join(by_chunk, "chunk", "left")

    def send(chunk: int, c: Chunk, ids: pa.Array, replies: dict) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(c.estimates(replies, number, counters))
        shard = c.shards(number)[some]
        base = int(c.low.min(initial=np.iinfo(np.int64).max))
        for k, a, b in runs(shard):
            exact = np.empty(b - a, _EXACT)
            exact["a"], exact["b"] = c.hashes[some[a:b]], c.check[some[a:b]]
            low = varints((c.low[some[a:b]].astype(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)))[0]
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([chunk]), pa.array([base]), pa.array([exact.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())], ["shard", "chunk", "base", "windows", "low"])

    def group(sent: pa.Table) -> pa.Table:
        windows = [np.frombuffer(w.as_buffer(), _EXACT) for w in sent.column("windows")]
        bounds = np.append(0, np.cumsum([len(w) for w in windows]))
        base = np.array(sent.column("base").to_pylist(), np.int64).view(np.uint64)
        low, smaller = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], bool)
        for x, y, data, b in zip(bounds[:-1], bounds[1:], sent.column("low"), base):
            low[x:y] = (from_varints(data.as_buffer()) + b).view(np.int64)
        edges = parts(min(int(w["a"][0]) for w in windows), max(int(w["a"][-1]) for w in windows), -(-int(bounds[-1]) // PART))
        cuts = np.array([[0, *np.searchsorted(w["a"], edges).tolist(), len(w)] for w in windows])  # the hashes of a list ascend
        for k in range(len(edges) + 1):
            held = [(w[x:y], slice(at + x, at + y)) for w, at, x, y in zip(windows, bounds[:-1].tolist(), cuts[:, k].tolist(), cuts[:, k + 1].tolist()) if y > x]
            if not held:
                continue
            a, b = (np.concatenate([w[f] for w, _ in held]) for f in ("a", "b"))
            own = np.concatenate([low[at] for _, at in held])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            least = np.minimum.reduceat(own[order], np.flatnonzero(new))
            found = np.empty(len(order), bool)
            found[order] = least[np.cumsum(new) - 1] < own[order]
            x = 0
            for w, at in held:
                smaller[at] = found[x : x + len(w)]
                x += len(w)
        bits = pa.array([np.packbits(smaller[x:y]).tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())
        return pa.table({"chunk": sent.column("chunk"), "shard": sent.column("shard"), "line": pa.array(np.full(len(sent), LINES), pa.int32()), "bits": bits})

    sent = with_replies(estimated).mapInArrow(together(each(send)), "shard long, chunk long, base long, windows binary, low binary")
    found = scratch.write(sent.groupBy("shard").applyInArrow(group, reply), "found")
    scratch.release()

    def cut(chunk: int, c: Chunk, ids: pa.Array, replies: dict) -> Iterator[pa.RecordBatch]:
        repeated = c.estimates(replies, number, counters)
        some = np.flatnonzero(repeated)
        elsewhere = np.zeros(len(repeated), bool)
        elsewhere[some] = unbits(replies, LINES, c.shards(number)[some])
        hit = c.place[elsewhere[c.of] | (c.ids[c.text] > c.low[c.of])]
        edge = np.zeros(len(c.starts) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + words, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), c.first) * (c.counts > 0) if len(c.first) else np.zeros(0, np.int64)
        kept = np.flatnonzero(~gone)
        mark = np.zeros(len(c.raw) + 1, np.int8)
        mark[c.starts[kept]] += 1
        mark[c.ends[kept] + 1] -= 1
        held = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        out = c.raw[held]
        out[_SEPARATOR[out]] = 32
        ends = np.append(0, np.cumsum(np.where(gone, 0, c.ends - c.starts + 1)))[np.append(c.first, len(gone))]
        data = out.tobytes()
        texts = [data[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        inner = np.ones(len(gone), bool)
        inner[c.first[c.counts > 0]] = False  # a run ends with its text
        up = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & inner))
        down = np.flatnonzero(gone & ~(np.append(gone[1:], False) & np.append(inner[1:], False))) + 1
        owner = np.searchsorted(np.append(c.first, len(gone)), up, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(up - c.first[owner]), pa.array(down - c.first[owner])], ["a", "b"])
        offsets = pa.array(np.searchsorted(owner, np.arange(len(c.first) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(c.counts, pa.int64()), pa.array(removed, pa.int64()), pa.ListArray.from_arrays(offsets, spans), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "spans", "kept"]
        )

    form = "id long, n_words long, n_removed long, spans array<struct<a: long, b: long>>, kept string"
    return with_replies(estimated.unionByName(found)).mapInArrow(each(cut), form)


def together(run: Callable) -> Callable:
    """Small batches of a function joined, so that Spark gets few of them."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size > 4 << 20 or len(held) >= 4096:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def digest_rows(docs: DataFrame, words: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return earlier_windows(docs, words).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
