"""Merging of means, variances and covariances of parts into those of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import col
from .block import at

Keys = list[str]


def merged_mean(mean: str, name: str) -> Column:
    """Of parts of equal size, as the next two."""
    return F.avg(col(mean)).alias(name)


def merged_variance(var: str, mean: str, name: str) -> Column:
    """The mean of the parts' variances and the variance of their means."""
    return (F.avg(col(var)) + F.var_pop(col(mean))).alias(name)


def merged_covariance(cov: str, x: str, y: str, name: str) -> Column:
    return (F.avg(col(cov)) + F.covar_pop(col(x), col(y))).alias(name)


def merge_pair(na: Column, ma: Column, m2a: Column, nb: Column, mb: Column, m2b: Column) -> tuple[Column, Column, Column]:
    """(n, mean, M2) of two parts of any sizes; with C and a second pair of means in place of M2 see merge_pair_covariance."""
    n, d = na + nb, mb - ma
    share = F.coalesce(F.try_divide(nb, n), F.lit(0.0))
    return n, ma + d * share, m2a + m2b + d * d * na * share


def merge_pair_covariance(na: Column, xa: Column, ya: Column, ca: Column, nb: Column, xb: Column, yb: Column, cb: Column) -> tuple[Column, Column, Column, Column]:
    n, dx, dy = na + nb, xb - xa, yb - ya
    share = F.coalesce(F.try_divide(nb, n), F.lit(0.0))
    return n, xa + dx * share, ya + dy * share, ca + cb + dx * dy * na * share


def tower_merge(base: DataFrame, shape: dict[str, int], factors: dict[str, int], fields: list[str], pairs: list[tuple[str, str]], keys: Keys) -> DataFrame:
    """A coarser level from blocks (ic, jc, kc) with avg_<f>, var_<f> and cov_<f>_<g>: blocks of so many blocks along each axis."""
    good = F.lit(True)
    for axis, f in factors.items():
        good = good & (F.col(f"{axis}c") < shape[axis] - shape[axis] % f)
    place = [F.floor(F.col(f"{a}c") / f).cast("int").alias(f"{a}c") for a, f in factors.items()]
    aggregates = [F.sum("n").alias("n")]
    for f in fields:
        aggregates += [merged_mean(f"avg_{f}", f"avg_{f}"), merged_variance(f"var_{f}", f"avg_{f}", f"var_{f}")]
    aggregates += [merged_covariance(f"cov_{f}_{g}", f"avg_{f}", f"avg_{g}", f"cov_{f}_{g}") for f, g in pairs]
    return base.where(good).groupBy(*keys, *place).agg(*aggregates)


def base_level(voxels: DataFrame, shape: dict[str, int], factors: dict[str, int], fields: list[str], pairs: list[tuple[str, str]], keys: Keys) -> DataFrame:
    good = F.lit(True)
    for axis, f in factors.items():
        good = good & (F.col(axis) < shape[axis] - shape[axis] % f)
    aggregates = [F.count(F.lit(1)).alias("n")]
    for f in fields:
        aggregates += [F.avg(col(f)).alias(f"avg_{f}"), F.var_pop(col(f)).alias(f"var_{f}")]
    aggregates += [F.covar_pop(col(f), col(g)).alias(f"cov_{f}_{g}") for f, g in pairs]
    return voxels.where(good).groupBy(*keys, *(at(a, f) for a, f in factors.items())).agg(*aggregates)


def multilevel_views(voxels: DataFrame, nx: int, ny: int, levels: list[tuple[int, int]], fields: list[str], pairs: list[tuple[str, str]], keys: Keys) -> DataFrame:
    """Horizontal block means and mean products of all levels (fx, fy) at once, per vertical level."""
    schedule = F.array(*(F.struct(F.lit(a).alias("fx"), F.lit(b).alias("fy")) for a, b in levels))
    fits = F.filter(schedule, lambda s: (F.col("i") < nx - F.lit(nx) % s.fx) & (F.col("j") < ny - F.lit(ny) % s.fy))
    place = [F.floor(F.col(a) / F.col(f"s.{f}")).cast("int").alias(f"{a}c") for a, f in (("i", "fx"), ("j", "fy"))]
    aggregates = [F.avg(col(f)).alias(f) for f in fields] + [F.avg(col(a) * col(b)).alias(f"{a}_{b}") for a, b in pairs]
    return voxels.withColumn("s", F.explode(fits)).groupBy(*keys, F.col("s.fx").alias("fx"), F.col("s.fy").alias("fy"), *place, "k").agg(*aggregates)
