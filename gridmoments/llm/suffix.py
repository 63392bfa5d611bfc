"""Exact removal of repeated byte strings by suffix arrays that are built in two stages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of context that a suffix array covers, and contexts of one anchor beyond which the anchor is split.
BUCKET_BYTES, HEAVY = 1 << 20, 2048
#: Low bits of an anchor's key that hold its place in a piece of text; the others are its hash, in every piece alike.
PLACE_BITS = 22


def suffix_order(text: np.ndarray, begin: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of interest in the order of their first `depth` bytes, and the 8-byte words at every position.

    text: strings, each ended by a zero byte, and depth + 16 zero bytes. Of the string at begin[i] the first starts[i]
    suffixes are of interest, with those that their order is induced from. Stage one sorts only suffixes that are smaller
    than their successors, by 8-byte words, as long as they tie. Stage two scans the buckets of first bytes in ascending
    order: a suffix that is larger than its successor goes behind its bucket's others when the successor is met.
    """
    n = len(text)
    word = text.astype(np.uint64)
    for shift in (1, 2, 4):
        moved = np.zeros_like(word)
        moved[:-shift] = word[shift:]
        word = (word << np.uint64(8 * shift)) | moved
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    at = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = step[at] >= 0
    small[text == 0] = True
    after = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    size = after[begin + starts - 1] + 1 - begin
    first = np.cumsum(np.append(0, size))
    member = np.repeat(begin - first[:-1], size) + np.arange(first[-1])
    inside = np.zeros(n, bool)
    inside[member] = True
    inside_before = np.zeros(n, bool)
    inside_before[1:] = inside[:-1]
    inside_before[begin] = False

    order = member[small[member]]
    order = order[np.argsort(word[order], kind="stable")]
    key = word[order]
    new = np.append(True, key[1:] != key[:-1])[: len(order)]
    for k in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        slot = np.flatnonzero(tied)
        if not len(slot):
            break
        group = np.cumsum(new[slot])
        key = word[order[slot] + k]
        by = np.lexsort((key, group))
        order[slot] = order[slot[by]]
        key = key[by]
        differs = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        new[slot] |= differs

    cuts = np.searchsorted(text[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else order[:0]
        waiting[c] = []
        larger = [now]
        while len(now):
            now = now[inside_before[now]] - 1
            now = now[text[now] == c]
            larger.append(now)
        scanned = np.concatenate([*larger, order[cuts[c] : cuts[c + 1]]])
        if not len(scanned):
            continue
        out.append(scanned)
        before = scanned[inside_before[scanned]] - 1
        before = before[(text[before] > c) & ~small[before]]
        byte = text[before]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        edges = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])) if len(byte) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(byte))):
            waiting[byte[a]].append(before[a:b])
    return np.concatenate(out) if out else order, word


def repeated(contexts: list[bytes], starts: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """For each start of each context in turn: whether its string of `length` bytes starts anywhere else.

    A context has starts + length - 1 bytes and stands for so many equal copies.
    """
    begin = np.cumsum(np.append(0, [len(c) + 1 for c in contexts]))[:-1]
    text = np.frombuffer(b"\0".join(contexts) + bytes(length + 17), np.uint8)
    order, word = suffix_order(text, begin, starts, length)
    weight = np.zeros(len(text), np.int64)
    first = np.cumsum(np.append(0, starts))
    at = np.repeat(begin - first[:-1], starts) + np.arange(first[-1])
    weight[at] = np.repeat(copies, starts)
    same = np.arange(len(order) - 1)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[word[order[same] + k] == word[order[same + 1] + k]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    run = np.cumsum(new) - 1
    total = np.bincount(run, weight[order])
    found = np.zeros(len(text), bool)
    found[order[total[run] >= 2]] = True
    return found[at]


def anchored(raw: np.ndarray, at: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of `length`-byte strings with the same anchor: (hash, text, first start, starts).

    The anchor of a string is its leftmost gram with the smallest hash, so equal strings have equal anchors.
    """
    width, n = length - gram + 1, len(raw) - gram + 1
    if n < width:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    s = C.rolling(raw)
    h = C.mixed((s[gram:] - s[:-gram]) * C.powers(len(raw) + 1)[1][:n])
    bits = np.uint64(PLACE_BITS)
    if n > 1 << PLACE_BITS:
        raise ValueError(f"a piece of {n} places is too long")
    key = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = key
    grid = grid.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(tail[: n - width + 1], head[width - 1 : n])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    counts = np.maximum(np.diff(at) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(np.append(0, counts))
    start = np.repeat(at[:-1] - first[:-1], counts) + np.arange(first[-1])
    if not len(start):
        return start, start, start, start
    anchor = anchor[start]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    edge = np.flatnonzero(new)
    return h[anchor[edge]].view(np.int64), text[edge], start[edge], np.diff(np.append(edge, len(start)))


def parts(batch: pa.RecordBatch, column: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row, base) of pieces of bounded size; a longer text is cut into pieces that overlap by length - 1 bytes."""
    done = 0
    for piece in C.pieces(batch, column):
        raw, at = C.flat(piece.column(column))
        rows = done + np.arange(len(piece))
        done += len(piece)
        if len(piece) > 1 or len(raw) <= 2 * C.CHUNK_BYTES:
            yield raw, at, rows, np.zeros(len(piece), np.int64)
            continue
        for a in range(0, max(1, len(raw) - length + 1), C.CHUNK_BYTES):
            cut = raw[a : a + C.CHUNK_BYTES + length - 1]
            yield cut, np.array([0, len(cut)]), rows, np.array([a])


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 40, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(id, n_bytes, spans, kept and a struct `carried` of the columns to carry) of every row: the byte spans that strings of `length` bytes cover which also start elsewhere, and the other bytes.

    Every string belongs to one anchor, its gram with the smallest hash, and equal strings to equal anchors. Anchors that
    occur once are dropped. Of the others, runs of strings with their bytes, the contexts, are gathered by anchor; equal
    contexts travel as one with their number. A suffix array over each bucket of anchors (suffix_order), the common
    prefixes of neighbours and the numbers of copies tell which strings occur twice. An anchor with very many different
    contexts is split by longer grams, at last by whole strings, of which equal ones are one context.

    Strings are judged on the input: overlaps and matches within a document count, and all copies go, the first too. Null
    and empty texts have no bytes and no spans. With as_text, kept is a string without the characters that a cut leaves in
    halves; rows with a null id are dropped. Rows of a repeated id are documents of their own (where ids repeat, rows are
    numbered and written first). Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "suffix")
    carried = F.struct(*(docs[c] for c in carry)) if carry else F.lit(None).cast("boolean")
    full = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).cast("binary").alias("text"), carried.alias("carried")).where("own is not null")
    if full.groupBy("own").count().where("count > 1").isEmpty():
        full = full.withColumn("id", F.col("own"))
    else:
        full = scratch.write(full.withColumn("id", F.monotonically_increasing_id()), "numbered")
    docs = full.select("id", "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = np.asarray(batch.column("id").to_numpy(zero_copy_only=False), np.int64)
            for raw, at, rows, base in parts(batch, "text", length):
                h, text, start, n = anchored(raw, at, gram, length)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(who[rows[text]]), pa.array((start - at[text] + base[text]).astype(np.int64)), pa.array(n.astype(np.int32))], ["h", "id", "s", "n"])

    marks = scratch.write(docs.mapInArrow(mark, "h long, id long, s long, n int"), "marks")
    # written, so that both sides of the join are dealt anew and Spark can split a gram that very many strings have
    shared = scratch.write(marks.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared")
    per_doc = scratch.write(marks.join(shared, "h").groupBy("id").agg(F.collect_list(F.struct("h", "s", "n")).alias("marks")), "lists")
    scratch.drop("marks")
    scratch.release()

    def digest(x: bytes) -> bytes:
        return hashlib.blake2b(x, digest_size=16).digest()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in C.pieces(whole, "text"):
                lists = batch.column("marks")
                flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
                h, s, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                row = np.repeat(np.arange(len(counts)), counts)
                texts = [x.as_buffer() for x in batch.column("text")]
                c, held = [], []
                for r, a, m in zip(row.tolist(), s.tolist(), n.tolist()):
                    x = texts[r][a : a + m + length - 1].to_pybytes()
                    k = digest(x)
                    c.append(k)
                    held.append(None if k in seen else x)
                    seen.add(k)
                if len(seen) > 200_000:
                    seen.clear()
                who = batch.column("id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c, pa.binary()), who, pa.array(s), pa.array(n), pa.array(held, pa.binary())], ["h", "c", "id", "s", "n", "x"])

    form = "h long, c binary, id long, s long, n int, x binary"
    met = scratch.write(docs.join(per_doc, "id").mapInArrow(contexts, form), "met0")
    scratch.drop("lists")
    scratch.release()

    def split(longer: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                who, s = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in ("id", "s"))
                for raw, at, rows, _ in parts(batch, "x", length):
                    h, text, start, n = anchored(raw, at, longer, length)
                    data = raw.tobytes()
                    x = [data[a : a + m + length - 1] for a, m in zip(start.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array([digest(y) for y in x], pa.binary()), pa.array(who[rows[text]]), pa.array(s[rows[text]] + start - at[text]), pa.array(n.astype(np.int32)), pa.array(x, pa.binary())],
                        ["h", "c", "id", "s", "n", "x"],
                    )

        return run

    def sort(table: pa.Table) -> pa.Table:
        x = table.column("x").to_pylist()
        n = table.column("n").to_numpy().astype(np.int64)
        found = repeated(x, n, table.column("copies").to_numpy(), length)
        first = np.cumsum(np.append(0, n))
        edge = np.append(False, found).astype(np.int8)
        up = np.flatnonzero(found & ((edge[:-1] == 0) | np.isin(np.arange(len(found)), first)))
        last = found & ~np.append(found[1:], False)
        last |= found & np.isin(np.arange(1, len(found) + 1), first)
        down = np.flatnonzero(last) + 1
        row = np.searchsorted(first, up, "right") - 1
        return pa.table({"h": table.column("h").take(pa.array(row)), "c": table.column("c").take(pa.array(row)), "a": pa.array(up - first[row]), "b": pa.array(down - first[row])})

    spans = []
    for level, longer in enumerate((0, length - length // 8, length)):
        if longer:
            met = scratch.write(again.mapInArrow(split(longer), form), f"met{level}")
        texts = scratch.write(met.groupBy("h", "c").agg(F.count("*").alias("copies"), F.first("x", True).alias("x"), F.first("n").alias("n")), f"texts{level}")
        size = texts.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0]
        light_texts, light_met, again = texts, met, None
        if longer < length:
            heavy = scratch.write(texts.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > HEAVY).select("h"), f"heavy{level}")
            if not heavy.isEmpty():
                light_texts, light_met = texts.join(heavy, "h", "left_anti"), met.join(heavy, "h", "left_anti")
                again = met.drop("x").join(heavy, "h", "left_semi").join(texts.select("h", "c", "x"), ["h", "c"])
        bucket = F.pmod("h", F.lit(size // BUCKET_BYTES + 1))
        found = light_texts.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(sort, "h long, c binary, a long, b long")
        found = scratch.write(found, f"found{level}")
        scratch.release()
        spans.append(light_met.select("h", "c", "id", "s").join(found, ["h", "c"]).select("id", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") + length - 1).alias("b")))
        if again is None:
            break
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    per_doc = every.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, kept = [], []
            for text, found in zip(batch.column("text"), batch.column("spans").to_pylist()):
                text = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                own: list[list[int]] = []
                for x in found or []:
                    if own and x["a"] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], x["b"])
                    else:
                        own.append([x["a"], x["b"]])
                merged.append([{"a": a, "b": b} for a, b in own])
                edges = [0, *(y for x in own for y in x), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if own else text)
            n = [None if not t.is_valid else len(t.as_buffer()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("own"), pa.array([x or 0 for x in n], pa.int64()), pa.array(merged, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), batch.column("carried")],
                ["id", "n_bytes", "spans", "kept", "carried"],
            )

    form = f"id long, n_bytes long, spans array<struct<a: long, b: long>>, kept {'string' if as_text else 'binary'}, carried {full.schema['carried'].dataType.simpleString()}"
    return full.join(per_doc, "id", "left").select("own", "text", "spans", "carried").mapInArrow(cut, form)


def digest_rows(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return remove_repeats(docs, length).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
