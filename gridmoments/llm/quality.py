"""A quality classifier from heuristic labellers whose accuracies expectation-maximisation estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .features import PLACES, dot, fit, sigmoid

#: Documents of the scorer's training sample at most, and its ridge penalty.
SAMPLE, RIDGE = 8192, 1e-5
LABELLERS = ("symbols", "capitals", "variety", "stutter", "pipes", "lines", "length", "word_length")
# For each labeller, the bounds of its measure beyond which it votes good and bad; negative ones are reversed.
BOUNDS = {"symbols": (0.045, 0.08), "capitals": (0.05, 0.25), "variety": (-0.6, -0.4), "stutter": (0.01, 0.08), "pipes": (0.002, 0.08), "lines": (0.2, 0.4), "length": (-40, -2), "word_length": (5.8, 6.6)}
#: Classes of bytes: lower-case letters and all beyond ASCII, capitals, digits, spaces, line ends; symbols have two by parity.
_KIND = np.zeros(256, np.int64)
_KIND[[*range(33, 127)]] = 5 + np.arange(33, 127) % 2
_KIND[65:91], _KIND[48:58], _KIND[97:123], _KIND[128:] = 1, 2, 0, 0
_KIND[[32, 9]], _KIND[[10, 11, 12, 13]], _KIND[124] = 3, 4, 7
GRAM = 4


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def measures(texts: pa.Array) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the labellers' measures, and its hashed features (place, value, bounds)."""
    raw, at = C.flat(texts)
    n, rows = np.diff(at), len(texts)
    owner = np.repeat(np.arange(rows), n)
    kind = _KIND[raw]
    blank = (kind == 3) | (kind == 4)
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    inner, edge = at[at < len(raw)], at[1:][at[1:] > 0] - 1
    first[inner], last[edge] = ~blank[inner], ~blank[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    s, inverse = C.rolling(raw), C.powers(len(raw) + 1)[1]

    def spans(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = C.mixed((s[b] - s[a]) * inverse[a] + (b - a).astype(np.uint64))
        who = np.searchsorted(at, a, "right") - 1
        order = np.lexsort((h, who))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (who[order][1:] != who[order][:-1])) if len(h) else np.zeros(0, bool)
        return h, who, np.bincount(who[order][new], minlength=rows)

    word, who, different = spans(starts, ends)
    words = np.bincount(who, minlength=rows)
    same = (word[1:] == word[:-1]) & (who[1:] == who[:-1])
    stutter = np.bincount(who[1:][same], minlength=rows)
    stops = np.flatnonzero(raw == 10)
    line_starts = np.sort(np.concatenate([inner, stops[stops + 1 < len(raw)] + 1]))
    line_starts = np.unique(line_starts)
    line_ends = np.append(line_starts[1:], len(raw)) if len(line_starts) else line_starts
    full = line_ends - line_starts > 1
    _, line_of, distinct = spans(line_starts[full], line_ends[full] - (raw[line_ends[full] - 1] == 10))
    lines = np.bincount(line_of, minlength=rows)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=rows)

    letters = count((kind == 0) & (raw < 128)) + count(kind == 1)
    out = {
        "symbols": _ratio(np.maximum(count(kind >= 5) - 3, 0), n),
        "capitals": _ratio(np.maximum(count(kind == 1) - 3, 0), letters),
        "variety": -np.where(words < 12, 0.5, _ratio(different, words) * np.minimum(1.4, np.maximum(1.0, words / 600))),
        "stutter": _ratio(stutter, words),
        "pipes": _ratio(count(kind == 7), words),
        "lines": np.where(lines < 2, 0.3, _ratio(lines - distinct, lines)),
        "length": -words.astype(np.float64),
        "word_length": np.where(words < 12, 6.2, _ratio(np.bincount(who, ends - starts, minlength=rows), words)),
    }
    code = kind[: max(len(raw) - GRAM + 1, 0)].copy()
    for k in range(1, GRAM):
        code = code * 8 + kind[k : k + len(code)]
    inside = owner[: len(code)] == owner[len(owner) - len(code) :]
    key = owner[: len(code)][inside] * 8**GRAM + code[inside]
    key, c = np.unique(key, return_counts=True)
    own, gram = key // 8**GRAM, key % 8**GRAM
    places = [(C.mixed(gram.astype(np.uint64)) >> np.uint64(46)).astype(np.int64)]
    values, owners = [np.sqrt(c / (n[own] + 100))], [own]
    for k, name in enumerate(LABELLERS[:-2], 1):  # words said twice, lines said twice and so on are features too
        places.append((C.mixed(np.full(rows, 8**GRAM + k, np.uint64)) >> np.uint64(46)).astype(np.int64))
        values.append(np.sqrt(np.abs(out[name])))
        owners.append(np.arange(rows))
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return out, (np.concatenate(places)[order], np.concatenate(values)[order], np.searchsorted(own[order], np.arange(rows + 1)))


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """For each text and labeller 1 (good), 0 (bad) or 2 (no vote)."""
    out = np.full((len(next(iter(found.values()))), len(LABELLERS)), 2)
    for k, name in enumerate(LABELLERS):
        good, bad = BOUNDS[name]
        out[found[name] <= good, k] = 1
        out[found[name] >= bad, k] = 0
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns and their counts: each pattern's probability of good, the chance of each vote, if one is given, of bad and good documents, and the share of good.

    Votes are taken as independent given the quality; it starts from the mean vote, and ends when no probability moves.
    """
    voted = patterns < 2
    p = (np.where(voted, patterns, 0).sum(1) + 0.5) / (voted.sum(1) + 1.0)
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        chance = np.stack([[(weight[y][:, None] * (patterns == v)).sum(0) + 1 for v in range(2)] for y in range(2)])
        chance = np.concatenate([chance / chance.sum(1, keepdims=True), np.ones((2, 1, patterns.shape[1]))], 1)  # quality, vote, labeller; no vote tells nothing
        like = np.log(np.array([1 - prior, prior]))[:, None] + np.log(chance)[:, patterns, np.arange(patterns.shape[1])].sum(2)
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        done = np.abs(new - p).max(initial=0) < 1e-9
        p = new
        if done:
            break
    return p, chance, prior


def quality(documents: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """The rows with score, votes and posterior (behind the prefix): the scorer's probability of good quality, the labellers' votes in base 3 and their posterior.

    Heuristic labellers vote on every document; expectation-maximisation over the counts of all their vote patterns
    (3 ** 8 at most) estimates their accuracies. The posteriors are the soft labels of a linear scorer over hashed
    features, fitted on at most `sample` documents, those with the smallest hashes of text and id; it scores all. No
    human label is read. Null and empty texts have no letters, score as the scorer says and keep their row; repeated rows
    give repeated rows; other columns are ignored.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.pieces(whole, "text"):
                found, _ = measures(batch.column("text"))
                code = votes(found) @ 3 ** np.arange(len(LABELLERS))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(code, return_counts=True)], ["votes", "n"])

    voted = rows.select("text").mapInArrow(vote, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    table = sorted((r["votes"], r["n"]) for r in voted.toLocalIterator())
    codes, counts = np.array([t[0] for t in table], np.int64), np.array([t[1] for t in table], np.float64)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    posterior, _, _ = estimate(patterns, counts)
    belief = dict(zip(codes.tolist(), posterior.tolist()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.pieces(whole, "text"):
                found, (place, value, bounds) = measures(batch.column("text"))
                code = votes(found) @ 3 ** np.arange(len(LABELLERS))
                yield pa.RecordBatch.from_arrays([pa.array(code), C.binaries(place.astype(np.int32), bounds), C.binaries(value.astype(np.float32), bounds)], ["votes", "p", "v"])

    most = rows.select(F.xxhash64("text", "id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    got = rows.where(F.xxhash64("text", "id") <= F.lit(most)).select("text").mapInArrow(features, "votes long, p binary, v binary").limit(sample).toLocalIterator()
    read = sorted((r["votes"], bytes(r["p"]), bytes(r["v"])) for r in got)
    place = np.frombuffer(b"".join(r[1] for r in read), np.int32).astype(np.int64)
    value = np.frombuffer(b"".join(r[2] for r in read), np.float32).astype(np.float64)
    bounds = np.cumsum([0, *(len(r[1]) // 4 for r in read)])
    target = np.array([belief[r[0]] for r in read])
    shared = spark.sparkContext.broadcast((*fit(place, value, bounds, target, np.ones(len(target)), RIDGE), belief))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, belief = shared.value
        for whole in batches:
            for batch in C.pieces(whole, text_col):
                found, (place, value, bounds) = measures(batch.column(text_col))
                code = votes(found) @ 3 ** np.arange(len(LABELLERS))
                s = sigmoid(dot(weights, place, value, bounds) + bias)
                told = [pa.array(s), pa.array(code), pa.array([belief.get(c, 0.5) for c in code.tolist()], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, *added])

    added = {f"{prefix}score": T.DoubleType(), f"{prefix}votes": T.LongType(), f"{prefix}posterior": T.DoubleType()}
    return documents.mapInArrow(score, T.StructType([*documents.schema.fields, *(T.StructField(k, t) for k, t in added.items())]))
