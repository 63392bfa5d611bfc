"""Cloud masks, level masks, contiguous spans and their storage chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import col, finite
from ..schema import DIAGNOSTICS, THRESHOLD

Keys = list[str]


def cloudy_timesteps(voxels: DataFrame, q: str, nx: int, ny: int, keys: Keys, threshold: float = THRESHOLD) -> DataFrame:
    """Keys of time steps where a 2 x 2 horizontal block mean of a level reaches the threshold; odd last rows do not count."""
    block = [F.floor(F.col(c) / 2).alias(f"{c}2") for c in ("i", "j")]
    whole = voxels.where((F.col("i") < nx - nx % 2) & (F.col("j") < ny - ny % 2))
    mean = whole.groupBy(*keys, "k", *block).agg(F.avg(col(q)).alias("m"))
    return mean.where((F.col("m") >= threshold) & ~F.isnan("m")).select(*keys).distinct()


def empty_levels(voxels: DataFrame, q: Column | str, keys: Keys, threshold: float = THRESHOLD) -> DataFrame:
    """(keys, k, empty): a level is empty if no value exceeds the threshold; NaN does not."""
    top = F.greatest(F.coalesce(F.max(F.when(~F.isnan(col(q)), col(q))), F.lit(0.0)), F.lit(0.0))
    return voxels.groupBy(*keys, "k").agg((top <= threshold).alias("empty"))


def level_tops(voxels: DataFrame, q: str, nx: int, ny: int, keys: Keys) -> DataFrame:
    """(keys, k, top, block_top): each level's largest value and its largest 2 x 2 block mean, in one pass; NaN does not count."""
    block = [F.floor(F.col(c) / 2).alias(f"{c}2") for c in ("i", "j")]
    inside = (F.col("i") < nx - nx % 2) & (F.col("j") < ny - ny % 2)
    cells = voxels.groupBy(*keys, "k", *block).agg(F.max(F.when(~F.isnan(col(q)), col(q))).alias("top"), F.avg(F.when(inside, col(q))).alias("m"))
    return cells.groupBy(*keys, "k").agg(F.max("top").alias("top"), F.max(F.when(~F.isnan("m"), F.col("m"))).alias("block_top"))


def keep_levels(levels: DataFrame, keys: Keys, z_factor: int, future: list[int]) -> DataFrame:
    """(keys, k, keep): levels that are not empty; if coarser factors follow, also the first, the last and those within z_factor of one that is not."""
    full = ~F.col("empty")
    if not any(f > z_factor for f in future):
        return levels.select(*keys, "k", full.alias("keep"))
    by = Window.partitionBy(*keys).orderBy("k")
    near = F.max(full).over(by.rowsBetween(-z_factor, z_factor))
    whole = Window.partitionBy(*keys)
    edge = (F.col("k") == F.min("k").over(whole)) | (F.col("k") == F.max("k").over(whole))
    return levels.select(*keys, "k", (near | edge).alias("keep"))


def span_levels(levels: DataFrame, keys: Keys) -> DataFrame:
    """(keys, k, lo, hi) of kept levels, with the run of kept levels that each is part of."""
    island = F.col("k") - F.row_number().over(Window.partitionBy(*keys).orderBy("k"))
    kept = levels.where("keep").withColumn("island", island)
    run = Window.partitionBy(*keys, "island")
    return kept.select(*keys, "k", F.min("k").over(run).alias("lo"), F.max("k").over(run).alias("hi"))


def spans(levels: DataFrame, keys: Keys) -> DataFrame:
    return span_levels(levels, keys).select(*keys, "lo", "hi").distinct()


def span_chunks(runs: DataFrame, keys: Keys, chunk: int, nz: int) -> DataFrame:
    """(keys, lo, hi, group, read_lo, read_hi): spans whose storage chunks overlap are read together, over the hull of their chunks."""
    first, last = F.floor(F.col("lo") / chunk), F.floor(F.col("hi") / chunk)
    by = Window.partitionBy(*keys).orderBy("lo")
    reach = runs.withColumn("c_lo", first).withColumn("c_hi", last).withColumn("before", F.max("c_hi").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("before").isNull() | (F.col("c_lo") > F.col("before")), 1).otherwise(0)
    grouped = reach.withColumn("group", F.sum(new).over(by) - 1)
    hull = Window.partitionBy(*keys, "group")
    return grouped.select(
        *keys, "lo", "hi", "group", (F.min("c_lo").over(hull) * chunk).alias("read_lo"), F.least((F.max("c_hi").over(hull) + 1) * chunk, F.lit(nz)).alias("read_end")
    ).select(*keys, "lo", "hi", "group", "read_lo", (F.col("read_end") - 1).alias("read_hi"))


def all_finite(columns: list[str]) -> Column:
    good = F.lit(True)
    for c in columns:
        good = good & finite(c)
    return good


def finite_rows(df: DataFrame, columns: list[str] = DIAGNOSTICS) -> DataFrame:
    return df.where(all_finite(columns))


def nonfinite_counts(df: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """(column, bad) of columns that hold null, NaN or infinite values, the worst first, in one pass."""
    counts = df.agg(*(F.sum((~finite(c)).cast("long")).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(0)).alias("bad")) for c in columns))
    rows = counts.select(F.explode(pairs).alias("r")).select("r.*").where("bad > 0")
    return rows if most is None else rows.orderBy(F.desc("bad"), "column").limit(most)


def assert_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = nonfinite_counts(df, columns, 8).collect()
    if bad:
        raise ValueError("values that are not finite: " + ", ".join(f"{r['column']} {r['bad']}" for r in bad))
    return df
