"""Tables of the truth analysis: many pairs of columns, targets and strata at once, in as many scans as one of them takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions.physics import col, finite
from ..sources import tables
from . import analysis as A

#: Strata that are taken, and rows below which one is passed over.
STRATA, LEAST_ROWS = 8, 100


def _pairs(df: DataFrame, pairs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """(x, target, keep, _x, _y): a row for each row and pair of columns of which both values are finite."""
    cells = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("target"), col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y")) for x, y in pairs))
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*").where(finite("_x") & finite("_y"))


def binned_medians(df: DataFrame, pairs: list[tuple[str, str]], nbins: int = 40, by: list[str] | None = None, least_rows: int = 0) -> DataFrame:
    """(by, x, target, bin, center, median, n): binned_median() of every pair (x, target), of each stratum with at least least_rows finite pairs."""
    return A.binned_median(_pairs(df, pairs, by or []), "_x", "_y", nbins, by=[*(by or []), "x", "target"], least_rows=least_rows)


def tke_against_covariances(df: DataFrame, nbins: int = 40) -> DataFrame:
    """Medians of every covariance in bins of the turbulence kinetic energy."""
    return binned_medians(df, [("tke", c) for c in A.covariance_columns(df)], nbins)


def tke_against_covariances_by_resolution(df: DataFrame, nbins: int = 40, stratum: str = "resolution_h", most: int = STRATA, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The same within each of the first resolutions that have enough rows."""
    counted = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_rows")).orderBy(stratum).limit(most).where(F.col("_rows") >= least_rows)
    first = shared.written(counted.select(stratum), "strata")  # `most` rows at most
    return binned_medians(df.join(F.broadcast(first), stratum, "left_semi"), [("tke", c) for c in A.covariance_columns(df)], nbins, [stratum])


def fractions_against_covariances(df: DataFrame, nbins: int = 40) -> DataFrame:
    """Medians of every covariance in bins of the liquid and of the ice fraction."""
    return binned_medians(df, [(x, c) for x in ("liq_fraction", "ice_fraction") for c in A.covariance_columns(df)], nbins)


def conditional_views(df: DataFrame, nbins: int = 30, prefix: str = "pred_") -> DataFrame:
    """Medians of liquid and ice, true and predicted, in bins of total water and of temperature: eight curves.

    A curve is over the rows where its two columns are finite, as a plot of it alone would be.
    """
    return binned_medians(df, [(x, f"{p}{q}") for q in ("q_liq", "q_ice") for x in ("qt", "theta_li") for p in ("", prefix)], nbins)


def densities(df: DataFrame, targets: list[str], resolution: str = "resolution_h", nbins: int = 48) -> DataFrame:
    """(target, resolution, bin, n, share) of every target; see resolution_density(). Limits of all targets come from one set of passes."""
    cells = A.long_form(df, [resolution], targets).withColumnRenamed("_series", "target").where(finite("_value"))
    limits = A.robust_limits(cells, ["target"], "_value")
    low = F.when(F.col("target").startswith("var_"), F.greatest("lo", F.lit(0.0))).otherwise(F.col("lo"))
    mid = (low + F.col("hi")) / 2
    pad = F.when(F.abs(mid) > 0, 0.1 * F.abs(mid)).otherwise(F.lit(1e-6))
    flat, bounded = ~(F.col("hi") > low), F.col("target").startswith("corr_")
    lo = F.when(bounded, F.lit(-1.0)).when(flat, mid - pad).otherwise(low)
    hi = F.when(bounded, F.lit(1.0)).when(flat, mid + pad).otherwise(F.col("hi"))
    limits = shared.written(limits.select("target", lo.alias("_lo"), hi.alias("_hi")), "limits")  # a row for each target
    held = cells.join(F.broadcast(limits), "target").withColumn("bin", A.bin_of(F.col("_value"), F.col("_lo"), F.col("_hi"), nbins)).where("bin is not null")
    counts = held.groupBy("target", resolution, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("target", resolution)) + 1e-12))


def resolution_grid(df: DataFrame, targets: list[str]) -> DataFrame:
    """(target, resolution_h, resolution_z, mean, n): means of the finite values and numbers of rows of each pair of resolutions; NaN where no value is finite."""
    keys = ["resolution_h", "resolution_z"]
    cells = A.long_form(df, keys, targets).withColumnRenamed("_series", "target")
    return cells.groupBy("target", *keys).agg(F.coalesce(F.avg(A.only_finite("_value")), F.lit(float("nan"))).alias("mean"), F.count(F.lit(1)).alias("n"))


def truth_analysis(df: DataFrame, out: str, data_source: str | None = None, forcing_model: str | None = None, experiment: str | None = None) -> list[str]:
    """Writes the tables of all analyses of a table of moments below `out` and returns their names.

    Moments and correlations against either resolution, and their grid, are of all rows; covariances against kinetic energy,
    also within resolutions, and against phase fractions are of the rows of the provenance that is told.
    """
    full = A.with_correlations(df)
    moments = tables.select_columns(full.columns, [], ["cov_", "var_", "corr_"])
    own = A.provenance(df, data_source, forcing_model, experiment)
    found = {
        "density_resolution_h": densities(full, moments, "resolution_h"), "density_resolution_z": densities(full, moments, "resolution_z"), "resolution_grid": resolution_grid(full, moments),
        "tke": tke_against_covariances(own), "tke_by_resolution_h": tke_against_covariances_by_resolution(own), "fractions": fractions_against_covariances(own),
    }
    for name, table in found.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    return list(found)
