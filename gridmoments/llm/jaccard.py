"""Exact Jaccard self-join on word n-grams: size-banded tiles, bitmap bounds, then exact sorted-array intersection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: 64-bit words of a document's bitmap, and of the wide one that pairs are held to next.
WORDS, WIDE = 8, 64
#: Rounds in which each set is held to one other of each prefix token, before those that are not joined meet in tiles.
HUBS = 3
#: Smallest prefix tokens of a set that each of its rows in a tile carries, to know a pair that has met before.
FIRST = 8
#: Of 256: share of all shingles, chosen by hash, that the census counts.
CENSUS = 256
_STEP = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text in ascending order, and the bounds of the texts in them.

    Words are the runs without the bytes 0x20 and 0x09-0x0D, after A-Z become a-z. A text of fewer words has its whole
    sequence as its only shingle; null and empty texts have none. Shingles are told apart by 64-bit hashes.
    """
    raw, at = C.flat(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = at[(at < len(raw))]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = solid[edge]
    ends = np.flatnonzero(last) + 1
    s = C.rolling(raw)
    word = C.mixed((s[ends] - s[starts]) * C.powers(len(raw) + 1)[1][starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, at)
    count = np.diff(bounds)
    step = np.resize(_STEP, words) * (np.arange(words, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    n = len(word) - words + 1
    if n > 0:
        h = word[:n] * step[0]
        for k in range(1, words):
            h += word[k : n + k] * step[k]
    else:
        h = np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(count)), count)
    keep = np.flatnonzero(text[:n] == text[len(text) - n :]) if n > 0 else np.zeros(0, np.int64)
    value, owner = C.mixed(h[keep]), text[keep]
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        extra = [(word[bounds[i] : bounds[i + 1]] * step[: count[i]]).sum(dtype=np.uint64) + np.uint64(count[i]) for i in few]
        value, owner = np.concatenate([value, C.mixed(np.array(extra, np.uint64))]), np.concatenate([owner, few])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def bitmap(value: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Of each bit the parity of how many shingles fall on it: sets differ in at least as many shingles as bitmaps in bits."""
    bits = (np.bincount((value >> np.uint64(40)).astype(np.int64) % (64 * words), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("id").to_numpy(zero_copy_only=False), np.int64)


def place_kind(texts: int) -> type:
    """The numbers that hold a place among so many texts."""
    return np.uint16 if texts <= 1 << 16 else np.uint32


def census_bits(size: int) -> int:
    """The binary logarithm of the number of buckets for so many bytes of text: some 2 ** 18 shingles in each while there are few buckets, 2 ** 22 beyond."""
    log = math.ceil(math.log2(size / 18 + 2))
    return max(6, min(9, log - 18), log - 22)


def chunk_bytes(bits: int) -> int:
    """Bytes of text that a task sends to the buckets at once: so many that a bucket gets 64 shingles or more of them, within the memory of a task."""
    return min(max(2 * C.CHUNK_BYTES, 64 * 18 * 256 // CENSUS << bits), 128 << 20)


def census(spark: SparkSession, docs: DataFrame, scratch: C.Scratch, words: int, percent: int) -> DataFrame:
    """(id, n, near) of every document: its set's size, and whether it can have a partner.

    A partner lacks at most (100 - percent) % of a set, so a set with more shingles that no other document has, even
    counting only those in a share of all hashes, has none. Shingles travel as packed numbers: each chunk of documents
    sends one row to each bucket of hashes, and a bucket returns, for each chunk, the places of the documents that alone
    have a shingle, once for each. Both grow with the number of shingles, whatever the number of buckets. A shingle of
    very many documents is one number for each of them in one bucket.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = census_bits(size)
    most = chunk_bytes(bits)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, values, owners, who, sizes = TaskContext.get().partitionId(), 0, 0, [], [], [], []

        def sent() -> pa.RecordBatch:
            value, owner, n = np.concatenate(values), np.concatenate(owners), np.concatenate(sizes)
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            bucket = (value >> np.uint64(32)).astype(np.int64)
            which, first = np.unique(bucket, return_index=True)
            cut = np.append(first, len(bucket))
            rows = len(which) + 1
            none = pa.array([b""])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, (part << 40) + k)), pa.array(np.append(which, -1)), pa.array(np.full(rows, len(n), np.int32)),
                 pa.chunked_array([C.binaries(value.astype(np.uint32), cut), none]).combine_chunks(),
                 pa.chunked_array([C.binaries(owner, cut), pa.array([np.concatenate(who).tobytes()])]).combine_chunks(),
                 pa.array([b""] * len(which) + [n.astype(np.int32).tobytes()])],
                ["chunk", "bucket", "texts", "value", "owner", "n"],
            )

        for whole in batches:
            for batch in C.pieces(whole, "text", 2 * C.CHUNK_BYTES):
                value, bounds = shingles(batch.column("text"), words)
                n = np.diff(bounds)
                owner = np.repeat(sum(map(len, sizes)) + np.arange(len(n), dtype=np.int32), n).astype(np.int32)
                counted = (value & np.uint64(0xFF)) < CENSUS
                values.append(value[counted] >> np.uint64(64 - 32 - bits))
                owners.append(owner[counted])
                who.append(ids(batch))
                sizes.append(n)
                held += batch.column("text").nbytes
                if held >= most:
                    yield sent()
                    k, held, values, owners, who, sizes = k + 1, 0, [], [], [], []
        if sizes:
            yield sent()

    schema = "chunk long, bucket long, texts int, value binary, owner binary, n binary"
    rows = scratch.write(docs.select("id", "text").mapInArrow(packed, schema), "census")

    def alone(table: pa.Table) -> pa.Table:
        values = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("value")]
        owners = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("owner")]
        texts = table.column("texts").to_numpy()
        chunk = np.repeat(np.arange(len(values)), [len(v) for v in values])
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        new = np.append(True, value[order][1:] != value[order][:-1]) if len(value) else np.zeros(0, bool)
        single = np.sort(order[new & np.append(new[1:], True)])  # back in the order of the chunks
        chunk, owner = chunk[single], owner[single]
        cut = np.searchsorted(chunk, np.arange(len(values) + 1))
        kinds = [place_kind(t) for t in texts.tolist()]
        held = [np.sort(owner[a:b]).astype(k).tobytes() for a, b, k in zip(cut[:-1].tolist(), cut[1:].tolist(), kinds)]
        return pa.table({"chunk": table.column("chunk"), "alone": pa.array(held, pa.binary())})

    counted = rows.where("bucket >= 0").select("chunk", "bucket", "texts", "value", "owner")
    counted = counted.groupBy("bucket").applyInArrow(alone, "chunk long, alone binary").groupBy("chunk").agg(F.collect_list("alone").alias("alone"))
    heads = rows.where("bucket < 0").select("chunk", F.col("owner").alias("ids"), "n")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                who, n = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["n"], np.int32).astype(np.int64)
                single = np.bincount(np.frombuffer(b"".join(row["alone"] or []), place_kind(len(who))), minlength=len(who))
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n), pa.array((n > 0) & (100 * single <= (100 - percent) * n))], ["id", "n", "near"])

    return scratch.write(heads.join(counted, "chunk", "left").mapInArrow(told, "id long, n long, near boolean"), "told")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, digest, items): a document's sorted shingle hashes as bytes, and a 128-bit digest of them."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.pieces(whole, "text"):
                value, bounds = shingles(batch.column("text"), words)
                items = C.binaries(value, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.diff(bounds)), pa.array([xxhash.xxh3_128_digest(x.as_buffer()) for x in items]), items], ["id", "n", "digest", "items"]
                )

    return docs.select("id", "text").mapInArrow(run, "id long, n long, digest binary, items binary")


def prefixes(reps: DataFrame, percent: int) -> DataFrame:
    """(token, place, id, n, bits, first): of each set the smallest hashes, so many that linked sets have one in common, with their places from 0, the set's bitmap and its FIRST smallest tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, bounds = C.flat(batch.column("items"))
            value, bounds = value.view(np.uint64), bounds // 8
            n = np.diff(bounds)
            k = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            place = np.arange(k.sum()) - np.repeat(np.append(0, np.cumsum(k)[:-1]), k)
            at = np.repeat(bounds[:-1], k) + place
            bits = np.stack([bitmap(value[bounds[i] : bounds[i + 1]]) for i in range(len(n))]) if len(n) else np.zeros((0, WORDS), np.int64)
            bits = pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(bits, k, axis=0).ravel()), WORDS).cast(pa.list_(pa.int64()))
            token = value.view(np.int64)[at]
            cut = np.append(0, np.cumsum(np.minimum(k, FIRST))).astype(np.int32)
            first = pa.ListArray.from_arrays(pa.array(cut), pa.array(token[place < FIRST])).take(pa.array(np.repeat(np.arange(len(n)), k)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(place), pa.array(np.repeat(ids(batch), k)), pa.array(np.repeat(n, k)), bits, first], ["token", "place", "id", "n", "bits", "first"]
            )

    return reps.select("id", "items").mapInArrow(run, "token long, place long, id long, n long, bits array<long>, first array<long>")


def wide_bitmaps(reps: DataFrame) -> DataFrame:
    """(id, n, bits) of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, bounds = C.flat(batch.column("items"))
            value, bounds = value.view(np.uint64), bounds // 8
            bits = [bitmap(value[a:b], WIDE).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds)), pa.array(bits, pa.binary())], ["id", "n", "bits"])

    return reps.select("id", "items").mapInArrow(run, "id long, n long, bits binary")


def verified(pairs: DataFrame, wide: DataFrame, reps: DataFrame, percent: int, scratch: C.Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough: first by wide bitmaps, then by exact intersection of the sorted arrays."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (C.flat(batch.column(k))[0].view(np.uint64).reshape(len(batch), WIDE) for k in ("x", "y"))
            n = np.asarray(batch.column("n").to_numpy(zero_copy_only=False))
            keep = (100 + percent) * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (100 - percent) * n
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (wide.select(F.col("id").alias(k), F.col("bits").alias(v), F.col("n").alias(f"n{v}")).hint("merge") for k, v in (("a", "x"), ("b", "y")))
    close = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("n"))
    close = scratch.write(close.mapInArrow(bound, "a long, b long"), f"{name}-close")
    asked = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct()
    items = scratch.write(reps.join(asked.hint("merge"), "id", "left_semi"), f"{name}-items")
    x, y = (items.select(F.col("id").alias(k), F.col("items").alias(v)).hint("merge") for k, v in (("a", "x"), ("b", "y")))
    links = scratch.write(close.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-items")
    return links


def bounded(a: str, b: str, percent: int):
    """SQL: by their sizes, the token's places and the bitmaps, the sets may link, if this is the first token that both hold.

    Then neither set has more in common with the other than what it holds from this place on. Linked sets differ in at
    most (100 - p) / (100 + p) of their summed sizes.
    """
    places = f"{100 + percent} * least({a}.n - {a}.place, {b}.n - {b}.place) >= {percent} * ({a}.n + {b}.n)"
    bits = " + ".join(f"bit_count({a}.bits[{k}] ^ {b}.bits[{k}])" for k in range(WORDS))
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {places} and {100 + percent} * ({bits}) <= {100 - percent} * ({a}.n + {b}.n)"


def central(tokens: DataFrame) -> DataFrame:
    """(id, score) of each set: how many sets have its prefix tokens, on average. The text that near copies were made from shares most."""
    count = tokens.groupBy("token").agg(F.count("*").alias("c"))
    return tokens.select("token", "id").join(count.hint("merge"), "token").groupBy("id").agg(F.avg("c").alias("score"))


def unmet(a: str, b: str) -> str:
    """SQL: no token before this one is among the smallest of both sets, where the pair would have met already.

    The smallest tokens stand in the order of places, so the first that both have is the first token that both hold; a
    pair without one meets at each token, as before.
    """
    return f"coalesce(get(array_intersect({a}.first, {b}.first), 0), {a}.token) = {a}.token"


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_same, near) of every row.

    Two documents link when percent % of their sets' union is in both; component_id is the smallest id that links reach.
    n_same counts the documents with exactly the same set, near says whether the census left it as a candidate.

    1. The census drops documents of which too many shingles are theirs alone.
    2. Candidates with equal sets become one class.
    3. In each of HUBS rounds, of the classes with the same prefix token one is the hub, the same for most tokens of a
       group: first the one whose tokens the most sets have, then others that come close to it. Those that are not
       joined to it yet are held against it; that joins large groups of near copies without their pairs.
    4. Classes that share a prefix token and are not joined yet meet in tiles of a token and a size band, a pair only at
       the first token that the smallest of both have in common; the token's places in both sets and bit counts of the
       bitmaps bound the overlap, and what passes is held against each other exactly.

    Null and empty texts, and texts of white space, have no shingles and stand alone. Rows with a null id are
    dropped, repeated ids give repeated rows with one component. Ties (equal sets) are one component. Columns besides id and text are ignored.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    told = census(spark, docs, scratch, words, percent)
    scratch.drop("census")
    near = told.where("near").select("id")
    full = scratch.write(sets(docs.join(near.hint("merge"), "id"), words), "sets")
    classes = scratch.write(full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n_same")), "classes")
    reps = scratch.write(full.join(classes.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").select("id", "items"), "reps")
    full = scratch.write(full.drop("items"), "digests")
    scratch.drop("sets")
    wide = scratch.write(wide_bitmaps(reps), "wide")
    tokens = scratch.write(prefixes(reps, percent), "tokens")
    score = scratch.write(central(tokens), "score")
    links = joined = None
    for r in range(HUBS):
        labelled = tokens.drop("first").join(score.hint("merge"), "id")
        labelled = labelled.withColumn("component", F.col("id")) if joined is None else labelled.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
        labelled = scratch.write(labelled.join(mixed, "token", "left_semi"), f"mixed{r}")
        rank = F.col("score") * (1 - r / 2000 * F.pmod(F.xxhash64("id", F.lit(r)), F.lit(100)))
        hub = labelled.groupBy("token").agg(F.max_by(F.struct("id", "place", "n", "bits", "component"), F.struct(rank, "id")).alias("h")).select("token", "h.*")
        pairs = labelled.alias("t").join(hub.alias("h"), F.expr("t.token = h.token and t.component <> h.component and " + bounded("t", "h", percent)))
        pairs = pairs.select(F.least("h.id", "t.id").alias("a"), F.greatest("h.id", "t.id").alias("b")).distinct()
        new = verified(pairs, wide, reps, percent, scratch, f"hub{r}")
        scratch.drop(f"mixed{r}")
        links = new if links is None else links.unionByName(new)
        if new.isEmpty():
            break
        joined = C.components(spark, links, scratch, f"hub{r}")
    labelled = tokens.withColumn("component", F.col("id")) if joined is None else tokens.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    labelled = scratch.write(labelled.join(mixed, "token", "left_semi"), "mixed")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    left = labelled.withColumn("band", band)
    right = labelled.withColumn("band", F.explode(F.array(band - 1, band)))  # to its own band and to that of the smaller sets
    on = "l.token = r.token and l.band = r.band and (l.n < r.n or l.n = r.n and l.id < r.id) and l.component <> r.component and " + bounded("l", "r", percent) + " and " + unmet("l", "r")
    pairs = left.alias("l").join(right.alias("r"), F.expr(on)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    more = verified(pairs, wide, reps, percent, scratch, "tile")
    all_links = links.unionByName(more)
    labels = C.components(spark, all_links, scratch, "all")

    rep = full.select("id", "digest").join(classes, "digest").select("id", "rep", "n_same")
    label = rep.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n_same", F.coalesce("component", "rep").alias("component"))
    label = label.groupBy("id").agg(F.max("n_same").alias("n_same"), F.min("component").alias("component"))
    return (
        told.join(label, "id", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n_same", F.lit(1)).alias("n_same"), "near")
    )
