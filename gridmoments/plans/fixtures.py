"""Voxels of a grid at three time steps, derived from the lineitem table, in Spark and in SQL.

The table is summed into SEEDS rows of small whole numbers; a voxel takes those of one row, found from its place. So the
grid is dense at every scale, of any shape, and all engines read the same numbers. Cloud lies in two layers that differ
by time step, with holes; the third time step has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import BuildOptions
from .builder import Geometry, split_phases

NT, NX, NY, NZ, DX, DZ, MIN_H, MAX_DZ = 3, 12, 12, 25, 100.0, 50.0, 200.0, 200.0
GEOMETRY = Geometry(NX, NY, (DZ,) * NZ, DX)
OPTIONS = BuildOptions(min_h=MIN_H, max_dz=MAX_DZ)
SEEDS = 509
SEED_SQL = {
    "a": "CAST(sum(l_partkey * 7 + l_linenumber) AS BIGINT) % 512",
    "b": "CAST(sum(l_suppkey * 11 + l_orderkey) AS BIGINT) % 512",
    "c": "CAST(sum(l_orderkey * 5 + l_partkey) AS BIGINT) % 512",
    "d": "CAST(sum(l_linenumber * 13 + l_suppkey) AS BIGINT) % 512",
}
PLACE_SQL = f"(timestep * 101 + i * 31 + j * 17 + k * 7) % {SEEDS}"
#: Steps are no decimal fractions, so that no mean lies where roundings part; condensate is of the size of the other fields, so that no moment vanishes in rounding.
FIELDS_SQL = {
    "hus": "1.0e0 + a / 509.0e0 + k / 61.0e0",
    "thetali": "300.0e0 + b / 251.0e0 + k / 7.0e0",
    "ta": "226.0e0 + 1.75e0 * (30 - k) + c / 127.0e0",
    "pfull": "900.0e0 - 16.0e0 * k + d / 251.0e0",
    "rhoa": "1.25e0 - k / 61.0e0 + a / 1021.0e0",
    "ua": "b / 61.0e0 - 4.0e0 + i / 3.0e0",
    "va": "c / 127.0e0 - 2.0e0",
    "wa": "(d - 256) / 127.0e0 + (a - 256) / 251.0e0",
    "q_c": "CASE WHEN timestep < 2 AND (k BETWEEN 4 AND 7 + timestep OR k BETWEEN 15 + timestep AND 18) AND (a + b + i) % 5 < 4 THEN (a + 2 * d) / 1021.0e0 ELSE 0.0e0 END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, shape: tuple[int, int, int, int]) -> DataFrame:
    """timestep, i, j, k of every voxel."""
    nt, nx, ny, nz = shape
    at = spark.range(nt * nx * ny * nz)
    places = (("timestep", nx * ny * nz, nt), ("i", ny * nz, nx), ("j", nz, ny), ("k", 1, nz))
    return at.select(*(F.expr(f"cast(id div {step} % {n} as int)").alias(name) for name, step, n in places))


def raw_voxels(spark: SparkSession, sf_dir: str, shape: tuple[int, int, int, int] = (NT, NX, NY, NZ)) -> DataFrame:
    """timestep, i, j, k, the fields and q_c."""
    seeds = table(spark, sf_dir, "lineitem").groupBy(F.expr(f"cast((l_orderkey * 7 + l_linenumber) % {SEEDS} as int)").alias("seed")).agg(*(F.expr(e).alias(n) for n, e in SEED_SQL.items()))
    at = cells(spark, shape).withColumn("seed", F.expr(PLACE_SQL)).join(F.broadcast(seeds), "seed", "left").fillna(0)  # SEEDS rows at most
    return at.select("timestep", "i", "j", "k", *(F.expr(f"cast({e} as double)").alias(n) for n, e in FIELDS_SQL.items()))


def voxels(spark: SparkSession, sf_dir: str, shape: tuple[int, int, int, int] = (NT, NX, NY, NZ)) -> DataFrame:
    """The same with clw and cli in place of q_c."""
    return split_phases(raw_voxels(spark, sf_dir, shape))


RAW_SQL = (
    f"sd AS (SELECT CAST((l_orderkey * 7 + l_linenumber) % {SEEDS} AS INTEGER) AS seed, " + ", ".join(f"{e} AS {n}" for n, e in SEED_SQL.items()) + " FROM lineitem GROUP BY 1), "
    + f"ce AS (SELECT CAST(t AS INTEGER) AS timestep, CAST(x AS INTEGER) AS i, CAST(y AS INTEGER) AS j, CAST(z AS INTEGER) AS k FROM range({NT}) p(t), range({NX}) q(x), range({NY}) r(y), range({NZ}) s(z)), "
    + f"pl AS (SELECT ce.*, {', '.join(f'coalesce({n}, 0) AS {n}' for n in SEED_SQL)} FROM ce LEFT JOIN sd ON sd.seed = {PLACE_SQL}), "
    + "raw AS (SELECT timestep, i, j, k, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in FIELDS_SQL.items()) + " FROM pl)"
)
SHARE_SQL = "least(greatest((ta - 233.0) / (273.15 - 233.0), 0.0), 1.0)"
VOX_SQL = f"{RAW_SQL}, vox AS (SELECT * EXCLUDE (q_c), {SHARE_SQL} * q_c AS clw, (1 - {SHARE_SQL}) * q_c AS cli FROM raw)"
