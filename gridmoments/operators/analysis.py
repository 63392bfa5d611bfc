"""Grouped reductions, limits, binned curves, density tables and correlations of the output table."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions.physics import col, correlation, finite
from .quantiles import exact_quantiles

#: A function from a column to an aggregate, or any other from a pandas Series of a group's values to a number.
Reducer = Callable


def only_finite(x: Column | str) -> Column:
    return F.when(finite(x), col(x))


def aggregate_of(df: DataFrame, reducer: Reducer, x: Column) -> Column:
    """The aggregate column of a reducer: its own, or a grouped pandas function that calls it with the values that are not null.

    Such a function sees NaN for a group without values, as the built-in aggregates give null. It holds the values of a
    group in one task; reducers that are column functions do not.
    """
    try:
        made = reducer(x)
        df.agg(made.alias("x"))  # Spark refuses what is no aggregate
        return made
    except Exception:  # no function of columns
        pass

    def reduce(values: pd.Series) -> float:
        values = values.dropna()
        out = reducer(values) if len(values) else None
        return float("nan") if out is None else float(out)

    reduce.__annotations__ = {"values": pd.Series, "return": float}
    return F.nanvl(F.pandas_udf(reduce, "double")(x.cast("double")), F.lit(None).cast("double"))


def group_reduce(df: DataFrame, by: list[str], value: str, reducer: Reducer = F.median, name: str | None = None) -> DataFrame:
    """The reducer (see Reducer) of the finite values of each group; null without any. The median is exact and spreads, see exact_quantiles()."""
    name = name or f"{value}_reduced"
    if reducer is F.median:
        return exact_quantiles(df, by, value, [0.5]).select(*by, F.col("q")[0].alias(name))
    return df.groupBy(*by).agg(aggregate_of(df, reducer, only_finite(value)).alias(name))


def group_reduce_many(df: DataFrame, by: list[str], values: list[str], reducer: Reducer = F.median) -> DataFrame:
    """group_reduce() of many columns at once, in as many passes as of one."""
    if reducer is not F.median:
        return df.groupBy(*by).agg(*(aggregate_of(df, reducer, only_finite(v)).alias(f"{v}_reduced") for v in values))
    found = exact_quantiles(long_form(df, by, values), [*by, "_series"], "_value", [0.5])
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_series") == v, F.col("q")[0])).alias(f"{v}_reduced") for v in values))


def long_form(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, _series, _value): a row for each of the columns, which one scan then serves."""
    cells = F.array(*(F.struct(F.lit(v).alias("s"), col(v).cast("double").alias("x")) for v in values))
    return df.select(*by, F.explode(cells).alias("_c")).select(*by, F.col("_c.s").alias("_series"), F.col("_c.x").alias("_value"))


def heatmap_matrix(df: DataFrame, x: str, y: str, value: str, reducer: Reducer = F.median) -> DataFrame:
    """(y, x, value, n) of every pair of known coordinates; NaN where a pair has no finite value."""
    if reducer is F.median:
        cells = exact_quantiles(df, [x, y], value, [0.5]).select(x, y, F.col("q")[0].alias("value"), F.col("rows").alias("n"))
    else:
        cells = df.groupBy(x, y).agg(aggregate_of(df, reducer, only_finite(value)).alias("value"), F.count(F.lit(1)).alias("n"))
    xs, ys = (df.select(c).distinct() for c in (x, y))
    grid = ys.crossJoin(xs)  # the two axes' distinct values, which make up the matrix asked for
    return grid.join(cells, [x, y], "left").select(y, x, F.coalesce("value", F.lit(float("nan"))).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


def quantile_summary(df: DataFrame, by: list[str], value: str, qs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Exact quantiles with linear interpolation, one column q<percent> each."""
    out = exact_quantiles(df, by, value, list(qs))
    return out.select(*by, *(F.col("q")[k].alias(f"q{round(100 * q):02d}") for k, q in enumerate(qs)))


def robust_limits(df: DataFrame, by: list[str], value: str, qlo: float = 0.005, qhi: float = 0.995) -> DataFrame:
    """(by, rows, lo, hi): quantiles of each group's finite values; equal ones give way to the extremes, and these to 10 % around them. No values: (0, 1)."""
    lo, hi, least, most = F.col("q")[0], F.col("q")[1], F.col("least"), F.col("most")
    flat = lo == hi
    pad = F.when(F.abs(least) > 0, 0.1 * F.abs(least)).otherwise(F.lit(1e-6))
    same = flat & (least == most)
    low = F.when(same, least - pad).when(flat, least).otherwise(lo)
    high = F.when(same, most + pad).when(flat, most).otherwise(hi)
    return exact_quantiles(df, by, value, [qlo, qhi]).select(*by, "rows", F.coalesce(low, F.lit(0.0)).alias("lo"), F.coalesce(high, F.lit(1.0)).alias("hi"))


def quantile_limits(df: DataFrame, value: str, by: list[str] | None = None, qlo: float = 0.05, qhi: float = 0.95, margin_lo: float = 0.0, margin_hi: float = 0.0, clamp_low: float | None = None) -> DataFrame:
    """(by, lo, hi): robust limits with margins, at least clamp_low; a collapsed interval is widened around its middle."""
    lo, hi = F.col("lo") - margin_lo, F.col("hi") + margin_hi
    if clamp_low is not None:
        lo = F.greatest(lo, F.lit(clamp_low))
    out = robust_limits(df, by or [], value, qlo, qhi).select(*(by or []), lo.alias("lo"), hi.alias("hi"))
    mid = (F.col("lo") + F.col("hi")) / 2
    pad = F.when(F.abs(mid) > 0, 0.1 * F.abs(mid)).otherwise(F.lit(1e-6))
    bad = ~(F.col("hi") > F.col("lo"))
    return out.select(*(by or []), F.when(bad, mid - pad).otherwise(F.col("lo")).alias("lo"), F.when(bad, mid + pad).otherwise(F.col("hi")).alias("hi"))


def is_constant(value: str) -> Column:
    """Aggregate: the finite values are all equal, or there is none."""
    x = only_finite(value)
    return F.coalesce(F.min(x) == F.max(x), F.lit(True))


def bin_of(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal bins, the last closed; null outside."""
    width = (hi - lo) / n
    return F.when((x >= lo) & (x <= hi), F.least(F.floor((x - lo) / width), F.lit(n - 1)).cast("int"))


def binned_median(df: DataFrame, x: str, y: str, nbins: int = 30, qlo: float = 0.005, qhi: float = 0.995, by: list[str] | None = None, least_rows: int = 0) -> DataFrame:
    """(by, bin, center, median, n): medians of y in equal bins of x between its limits; pairs that are not finite or out of range do not count."""
    by = by or []
    pairs = df.where(finite(x) & finite(y))
    limits = shared.written(robust_limits(pairs, by, x, qlo, qhi).where(F.col("rows") >= least_rows).select(*by, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "limits")
    held = pairs.join(limits, by) if by else pairs.crossJoin(F.broadcast(limits))  # one row for each group; Spark broadcasts them if few
    lo, hi = F.col("_lo"), F.col("_hi")
    binned = held.withColumn("bin", bin_of(col(x), lo, hi, nbins)).where("bin is not null").withColumn("center", lo + (F.col("bin") + 0.5) * (hi - lo) / nbins)
    return exact_quantiles(binned, [*by, "bin", "center"], y, [0.5]).select(*by, "bin", "center", F.col("q")[0].alias("median"), "n")


def stratified_binned_median(df: DataFrame, x: str, y: str, stratum: str = "resolution_h", most: int = 8, least_rows: int = 100, nbins: int = 30) -> DataFrame:
    """binned_median within each of the first `most` values of a stratum, without those of few rows."""
    first = df.select(stratum).distinct().orderBy(stratum).limit(most)
    return binned_median(df.join(F.broadcast(first), stratum), x, y, nbins, by=[stratum], least_rows=least_rows)


def resolution_density(df: DataFrame, value: str, resolution: str = "resolution_h", nbins: int = 48) -> DataFrame:
    """(resolution, bin, n, share): counts of a value's bins by resolution, and their share of the resolution's; corr_* spans [-1, 1], var_* starts at 0."""
    good = df.where(finite(value))
    if value.startswith("corr_"):
        limits = df.sparkSession.createDataFrame([(-1.0, 1.0)], "lo double, hi double")
    else:
        limits = quantile_limits(good, value, qlo=0.005, qhi=0.995, clamp_low=0.0 if value.startswith("var_") else None)
    held = good.crossJoin(F.broadcast(limits)).withColumn("bin", bin_of(col(value), F.col("lo"), F.col("hi"), nbins)).where("bin is not null")
    counts = held.groupBy(resolution, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy(resolution)) + 1e-12))


def target_summary(df: DataFrame, targets: list[str]) -> DataFrame:
    """(target, zero_fraction, min, p01, p50, p99, max) of all targets at once."""
    cells = long_form(df, [], targets).withColumnRenamed("_series", "target")
    zero = cells.groupBy("target").agg(F.avg((only_finite("_value") == 0).cast("double")).alias("zero_fraction"))
    found = exact_quantiles(cells, ["target"], "_value", [0.01, 0.5, 0.99]).join(zero, "target")
    return found.select("target", "zero_fraction", F.col("least").alias("min"), *(F.col("q")[k].alias(n) for k, n in enumerate(("p01", "p50", "p99"))), F.col("most").alias("max"))


def feature_correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs, in one pass."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(only_finite(a), only_finite(b)).alias("corr")) for a, b in combinations_with_replacement(features, 2)]
    return df.agg(F.array(*pairs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def with_correlations(df: DataFrame) -> DataFrame:
    """Adds corr_<a>_<b> for every cov_<a>_<b> with both variances."""
    have = set(df.columns)
    new = {}
    for c in df.columns:
        parts = c.split("_")[1:]
        if c.startswith("cov_") and len(parts) == 2 and {f"var_{p}" for p in parts} <= have:
            new[f"corr_{parts[0]}_{parts[1]}"] = correlation(c, f"var_{parts[0]}", f"var_{parts[1]}").cast("float")
    return df.withColumns(new) if new else df


def covariance_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("cov_")]


def provenance(df: DataFrame, data_source: str | None = None, forcing_model: str | None = None, experiment: str | None = None) -> DataFrame:
    for name, value in (("data_source", data_source), ("forcing_model", forcing_model), ("experiment", experiment)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df
