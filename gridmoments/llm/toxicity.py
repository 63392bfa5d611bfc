"""Toxicity scores by a linear model that swaps of identity terms may not move."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .features import PLACES, chosen, dot, fit, sigmoid, word_features

#: Labelled documents of the training sample at most and their bytes, features, weight of a toxic document, strengths of the penalties.
SAMPLE, SAMPLE_BYTES, FEATURES, TOXIC_WEIGHT, RIDGE, FAIRNESS = 8192, 32 << 20, 1024, 3.0, 1e-5, 32.0
#: Bytes of word heads that count as features beside words.
HEADS = (5, 6, 7)
# Terms of groups that texts may mention, one group a line; terms of a line are swapped for one another.
IDENTITY = [
    ["women", "men", "girls", "boys", "woman", "man", "female", "male", "transgender", "nonbinary"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    ["black", "white", "asian", "latino", "african", "european", "arab", "indigenous"],
    ["gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"],
    ["old", "young", "elderly", "teenage", "disabled", "deaf", "blind"],
    ["immigrant", "refugee", "foreigner", "citizen"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"],
    ["frauen", "männer", "muslime", "christen", "juden", "ausländer"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"],
]
NEXT = {word: line[(k + 1) % len(line)] for line in IDENTITY for k, word in enumerate(line)}
TERM = re.compile(r"\b(" + "|".join(sorted(map(re.escape, NEXT), key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with every identity term replaced by the next of its line; a text without any gets one at its end, which its checksum chooses."""
    out, n = TERM.subn(lambda m: NEXT[m[0].lower()], text)
    if n:
        return out
    number = zlib.crc32(text.encode())
    line = IDENTITY[number % len(IDENTITY)]
    return f"{text} {line[number // len(IDENTITY) % len(line)]}"


def values(count: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Counts, six at most, made less for long texts."""
    return np.minimum(count, 6) / np.sqrt(1 + np.repeat(words, np.diff(bounds)) / 300)


def telling(place: np.ndarray, count: np.ndarray, bounds: np.ndarray, target: np.ndarray, most: int) -> np.ndarray:
    """A mask of the places whose counts differ most, by the G statistic, and are more frequent in toxic texts."""
    toxic = np.repeat(target == 1, np.diff(bounds))
    a, z = (np.bincount(place[side], np.minimum(count[side], 6), minlength=PLACES) for side in (toxic, ~toxic))
    expected = (a + z) * a.sum() / max(a.sum() + z.sum(), 1)
    with np.errstate(all="ignore"):
        g = a * np.log(np.where(a > 0, a / expected, 1)) + z * np.log(np.where(z > 0, z / np.maximum(a + z - expected, 1e-9), 1))
    g[(a <= expected) | ~np.isfinite(g)] = 0
    keep = np.zeros(PLACES, bool)
    top = np.argsort(-g, kind="stable")[:most]
    keep[top[g[top] > 0]] = True
    return keep


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights and bias, from at most `sample` labelled documents whose crc32(id as text) mod 3 is not 1, those with the smallest hashes of the id.

    Of these, a document that would bring the sample above SAMPLE_BYTES of text is passed over, so that long texts cannot
    fill the driver. Each sampled text counts with its counterfactual, in which identity terms are swapped or, if it has
    none, one is added; the squared change of the score is penalised. Of a repeated id all texts count. Without a toxic
    or without a harmless example all weights are 0.
    """
    rows = labels.where(f"{label_col} in (0, 1) and {id_col} is not null").groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("y"))
    rows = rows.where(F.crc32(F.col("id").cast("string")) % 3 != 1).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = F.xxhash64("id")
    sizes = texts.join(F.broadcast(rows), "id").groupBy("id", "y").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"), F.min(order).alias("h")).orderBy("h", "id").collect()
    held, kept = 0, []
    for r in sizes:
        if held + r["n"] <= SAMPLE_BYTES:
            held += r["n"]
            kept.append((r["id"], int(r["y"])))
    spark = documents.sparkSession
    wanted = spark.createDataFrame(kept, "id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.pieces(whole, "text"):
                own = batch.column("text").fill_null("")
                other = pa.array([swapped(t) for t in own.to_pylist()], pa.string())
                out = [batch.column("id"), batch.column("y")]
                for t in (own, other):
                    place, count, bounds, words = word_features(t, HEADS)
                    out += [C.binaries(place.astype(np.int32), bounds), C.binaries(np.minimum(count, 6).astype(np.uint8), bounds), pa.array(words)]
                yield pa.RecordBatch.from_arrays(out, ["id", "y", "p0", "c0", "n0", "p1", "c1", "n1"])

    form = "id long, y int, p0 binary, c0 binary, n0 long, p1 binary, c1 binary, n1 long"
    got = texts.join(F.broadcast(wanted), "id").mapInArrow(run, form).toLocalIterator()
    read = sorted(((r["id"], r["y"], bytes(r["p0"]), bytes(r["c0"]), bytes(r["p1"]), bytes(r["c1"]), r["n0"], r["n1"]) for r in got), key=lambda r: r[:4])
    y = np.array([r[1] for r in read], np.float64)
    if not (0 < y.sum() < len(y)):
        return np.zeros(PLACES), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    keep, sides = None, []
    for k, n in ((2, 6), (4, 7)):
        place, count = (np.frombuffer(b"".join(r[c] for r in read), t) for c, t in ((k, np.int32), (k + 1, np.uint8)))
        bounds = np.cumsum([0, *(len(r[k + 1]) for r in read)])
        if keep is None:
            keep = telling(place, count, bounds, y, FEATURES)
        place, count, bounds = chosen(place, count, bounds, keep)
        sides.append((place.astype(np.int64), values(count, bounds, np.array([r[n] for r in read])), bounds))
    return fit(*sides[0], y, np.where(y > 0, TOXIC_WEIGHT, 1.0), RIDGE, sides[1], FAIRNESS)


def score(documents: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with the model's probability that the whole text is toxic; null texts count as empty."""
    shared = documents.sparkSession.sparkContext.broadcast((np.flatnonzero(model[0]), model[0][model[0] != 0], model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        weights = np.zeros(PLACES)
        weights[at] = w
        for whole in batches:
            for batch in C.pieces(whole, text_col):
                place, count, bounds, words = word_features(batch.column(text_col), HEADS, weights != 0)
                s = sigmoid(dot(weights, place, values(count, bounds, words), bounds) + bias)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, score_col])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(score_col, T.DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see train() and score(). A null id is not held out; repeated rows give repeated rows."""
    return score(documents.select("doc_id", "text"), train(documents, labels)).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
