"""Seeded samples and splits of an exact size, found by counting passes over hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared

#: Hashes that the driver sorts at most; their bits are told apart BITS at a time.
FEW, BITS = 10_000, 16


def nth_smallest(df: DataFrame, hashed: Column, n: int) -> tuple[int, int, int]:
    """(value, before, equal): the n-th smallest hash, n from 1, how many are smaller and how many are the same.

    A pass counts the hashes by their leading bits, 2**BITS counts at most, and the next looks at those of the one prefix
    that holds the n-th; four passes tell it, and a prefix of few hashes ends them.
    """
    held, before, shift = df.select(hashed.alias("h")), 0, 64
    while shift:
        shift -= BITS
        part = F.shiftright("h", shift)
        counts = held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect()
        for r in counts:
            if before + r["c"] >= n:
                break
            before += r["c"]
        held = held.where(part == r["p"])
        if r["c"] <= FEW:
            values = sorted(x["h"] for x in held.collect())
            v = values[n - before - 1]
            return v, before + values.index(v), values.count(v)
    return r["p"], before, r["c"]


def split_exactly(df: DataFrame, n: int, keys: list[str] | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """n rows in the order of a hash of the keys (all columns if none are told), and the others.

    The rows are written once with a number of their own, which decides between equal hashes, so that repeated rows are
    parted exactly too. With keys that tell rows apart the same rows are chosen on every run.
    """
    every = shared.written(df.withColumn("_row", F.monotonically_increasing_id()), "split")
    total = every.count()
    if not 0 <= n <= total:
        raise ValueError(f"{n} of {total} rows")
    if n in (0, total):
        low = F.lit(n > 0)
    else:
        own, tie = F.xxhash64(*(keys or df.columns), F.lit(seed)), F.xxhash64("_row", F.lit(seed))  # no two rows share the second
        value, before, equal = nth_smallest(every, own, n)
        low = own < value
        if before + equal == n:
            low = own <= value
        elif before < n:
            last, _, _ = nth_smallest(every.where(own == value), tie, n - before)
            low = low | ((own == value) & (tie <= last))
    return every.where(low).drop("_row"), every.where(~low).drop("_row")


def sample_exactly(df: DataFrame, n: int, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer."""
    return split_exactly(df, min(n, df.count()), keys, seed)[0]
