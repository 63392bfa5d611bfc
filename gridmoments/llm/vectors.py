"""Cleaning of vector columns, shared by the search and the near-duplicate operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, flat


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid, values, bounds): vectors that are neither null nor hold null or non-finite components, and their components."""
    if pa.types.is_null(column.type):
        return np.zeros(len(column), bool), np.zeros(0), np.zeros(1, np.int64)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    bounds = np.cumsum(np.append(0, lengths))
    bad = np.cumsum(np.append(0, ~np.isfinite(values)))
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool) & (bad[bounds[1:]] == bad[bounds[:-1]])
    return valid, values, bounds


def matrix(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The chosen rows as a matrix; shorter vectors end in zeros."""
    n = np.diff(bounds)[rows]
    out = np.zeros((len(rows), width))
    if len(rows):
        col = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(np.arange(len(rows)), n), col] = values[np.repeat(bounds[rows], n) + col]
    return out


def whole_numbers(vectors: DataFrame, scale: int, width: int, limit: int, carry: dict[str, str]) -> DataFrame:
    """Rows (row, the carried columns, x, most) of the valid vectors of a column v: x holds floor(scale * component) as 64-bit integers, most the largest of -x - 1 and x.

    carry: names and types of other columns. Shorter vectors end in zeros, and values beyond limit or -limit count as these.
    `row` tells the rows apart; it follows the partitions, so the result is to be written before it is used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, values, bounds = rows_of(batch.column("v"))
            at = np.flatnonzero(valid)
            x = np.clip(np.floor(scale * matrix(values, bounds, at, width)), -limit, limit).astype(np.int64)
            who = pa.array(at, pa.int64())
            most = np.where(x < 0, -x - 1, x).max(1, initial=0)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(who), *(batch.column(c).take(who) for c in carry), binaries(x.ravel(), np.arange(len(at) + 1) * width), pa.array(most)], ["row", *carry, "x", "most"])

    form = ", ".join(["row long", *(f"{c} {kind}" for c, kind in carry.items()), "x binary", "most long"])
    return vectors.where("v is not null").withColumn("row", F.monotonically_increasing_id()).select("row", *carry, "v").mapInArrow(run, form)


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The integer vectors of a column x as rows."""
    return flat(column)[0].view(np.int64).reshape(len(column), width)
