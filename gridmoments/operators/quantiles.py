"""Exact quantiles of groups of any size, by counting passes over value ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions.physics import col, finite

#: Ranges that a counting pass cuts a range into, and rows of a range that one task may sort.
BINS, FEW = 1 << 14, 1 << 20


def _per_group(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the columns of their group's one row."""
    return rows.join(table, by) if by else rows.crossJoin(F.broadcast(table))  # one row


def part_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The number of the part of [lo, hi] that x lies in; it never falls as x rises, and lo and hi are in different parts.

    A range on both sides of zero, or one that ends there, has zero as a part of its own and equal parts beside it. One on a
    side of zero has equal parts, of the logarithm if its ends are more than a thousandfold apart.
    """
    half = bins // 2
    capped = lambda share, n: F.least(F.floor(share * n), F.lit(n - 1))
    split = F.when(x < 0, capped((x - lo) / -lo, half)).when(x == 0, F.lit(half)).otherwise(half + 1 + capped(x / hi, half))
    rising = (F.ln(x) - F.ln(lo)) / (F.ln(hi) - F.ln(lo))
    falling = (F.ln(-lo) - F.ln(-x)) / (F.ln(-lo) - F.ln(-hi))
    flat = (x - lo) / (hi - lo)
    return F.when((lo <= 0) & (hi >= 0), split).otherwise(capped(F.when((lo > 0) & (hi / 1024 > lo), rising).when((hi < 0) & (lo / 1024 < hi), falling).otherwise(flat), bins))


def _cut(values: DataFrame, ranges: DataFrame, by: list[str], bins: int | None) -> DataFrame:
    """The parts of the ranges that hold wanted ranks: (by, lo, hi, rows, ranks), with places in the part.

    Every row of a range falls into one of its bins, which rise with the values, or, without bins, stands for itself.
    """
    held = _per_group(values, ranges.groupBy(*by).agg(F.collect_list(F.struct("lo", "hi", "id")).alias("_ranges")), by)
    met = held.withColumn("r", F.explode(F.filter("_ranges", lambda r: (F.col("_x") >= r.lo) & (F.col("_x") <= r.hi))))
    place = F.col("_x") if bins is None else part_of(F.col("_x"), F.col("r.lo"), F.col("r.hi"), bins)
    parts = met.groupBy(*by, F.col("r.id").alias("id"), place.alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).join(ranges.select("id", "ranks"), "id")
    inside = F.filter("ranks", lambda r: (r["at"] >= F.col("before")) & (r["at"] < F.col("before") + F.col("n")))
    moved = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["at"] - F.col("before")).alias("at")))
    return parts.select(*by, "lo", "hi", F.col("n").alias("rows"), moved.alias("ranks")).where("size(ranks) > 0")


def exact_quantiles(df: DataFrame, by: list[str], value: str | Column, qs: list[float]) -> DataFrame:
    """(by, rows, n, least, most, q) of each group: its rows, its finite values, the smallest, the largest, and the quantiles with linear interpolation.

    A group without finite values has null for the last three. Null is a group key like others; -0.0 and 0.0 are one value.

    One pass finds each group's ends. A quantile lies between the values of two neighbouring ranks; passes then count the
    values in BINS equal parts of the ranges that hold wanted ranks, at first the whole group, and go on with the parts that
    hold one. Ranges of at most FEW rows, or where all values are equal, end this: their values are counted one by one and
    the ranks read off. Each pass is an aggregate that combines in the mappers, so a group of all rows is spread like any
    other; the largest sort is of BINS rows, or of FEW. A group of ten billion values takes three passes if they are evenly spread, and few more however they lie.
    """
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError(f"quantiles lie between 0 and 1: {qs}")
    renamed = [f"_by{k}" for k in range(len(by))]
    x = F.when(finite(value), col(value).cast("double") + F.lit(0.0))
    keys = [F.struct(F.col(c)).alias(k) for c, k in zip(by, renamed)]  # in a struct, null meets null in a join
    every = df.select(*keys, x.alias("_x"))
    values = every.where("_x is not null")
    ends = shared.written(every.groupBy(*renamed).agg(F.count(F.lit(1)).alias("rows"), F.count("_x").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("most")), "ends")
    places = [F.lit(float(q)) * (F.col("n") - 1) for q in qs]
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in places for f in (F.floor, F.ceil))))
    told = F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("at")))
    ranges = ends.where("n > 0").select(*renamed, F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("n").alias("rows"), told.alias("ranks"))
    ranked = lambda parts: parts.select(*renamed, F.explode("ranks.rank").alias("rank"), F.col("lo").alias("v"))
    done: list[DataFrame] = []
    while True:
        ranges = shared.written(ranges.withColumn("id", F.monotonically_increasing_id()), "ranges")
        done.append(ranked(ranges.where("lo = hi")))
        ranges = ranges.where("lo < hi")
        most = ranges.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
        if most:
            done.append(ranked(_cut(values, ranges.where(F.col("rows") <= FEW), renamed, None)))
        if most <= FEW:
            break
        ranges = _cut(values, ranges.where(F.col("rows") > FEW), renamed, BINS)
    maps = reduce(DataFrame.unionByName, done).groupBy(*renamed).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    full = ends.join(maps, renamed, "left") if by else ends.crossJoin(F.broadcast(maps))
    at = lambda p: F.try_element_at("at", p.cast("long"))
    q = F.array(*((at(F.floor(p)) + (at(F.ceil(p)) - at(F.floor(p))) * (p - F.floor(p))) for p in places))
    return full.select(*(F.col(f"{k}.{c}").alias(c) for c, k in zip(by, renamed)), "rows", "n", "least", "most", F.when(F.col("n") > 0, q).alias("q"))
