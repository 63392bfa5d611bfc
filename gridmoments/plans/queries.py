"""Queries over the test tables, one or more for each operator, with the SQL that must give the same rows.

Doubles are rounded to a few digits on both sides, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schedules as S
from .. import shared
from ..functions import physics as P
from ..operators import analysis as A
from ..operators import block as B
from ..operators import masks as M
from ..operators import merge as G
from ..operators import training as L
from ..operators import truth as T
from ..operators.scales import scheduled
from ..schema import COLUMNS, COVARIANCES, DIAGNOSTICS, FLOATS, MEAN_OF, SHORT, VARIANCES
from ..sources import chunks, grid, library, manifest, tables
from . import builder, many
from .fixtures import DX, GEOMETRY, MIN_H, NT, NX, NY, NZ, OPTIONS, RAW_SQL, SHARE_SQL, VOX_SQL, raw_voxels, table, voxels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHAPE = {"i": NX, "j": NY, "k": NZ}
DIGITS = 7


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, columns: list[str], digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def r(expression: str, name: str, digits: int = DIGITS) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) AS {name}"


# Schedules, of grids whose numbers come from the tables


def _grids(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """The distinct values of expressions over the line items, as long."""
    return table(spark, sf_dir, "lineitem").select(*(F.expr(e).cast("long").alias(n) for n, e in columns.items())).distinct()


def _grids_sql(**columns: str) -> str:
    return "g AS (SELECT DISTINCT " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in columns.items()) + " FROM lineitem)"


_SIDE = {"n": "100 + l_linenumber"}
_EXTENT = {"n": "l_partkey % 129 + 1", "b": "l_suppkey % 30 + 1"}
_RANGES = {"lo": "l_linenumber", "hi": "l_linenumber + l_partkey % 70", "n": "l_suppkey % 7 + 2"}
_PLACES = {"n": "l_partkey % 40 + 1", "window_size": "l_suppkey % 40 + 1", "outputs": "l_linenumber % 4 + 1"}


@query(f"WITH {_grids_sql(**_EXTENT)} SELECT n, b, n - n % b AS used, n % b AS rest FROM g")
def truncated_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled(_grids(spark, sf_dir, **_EXTENT), lambda r: [S.truncated_block_extent(r["n"], r["b"])], "used long, rest long")


@query(f"""WITH {_grids_sql(**_RANGES)},
v AS (SELECT lo, hi, n, CASE WHEN hi - lo + 1 <= n THEN lo + g ELSE lo + CAST(round_even(g * (hi - lo) / CAST(n - 1 AS DOUBLE), 0) AS BIGINT) END AS v FROM g c, range(0, 8) x(g) WHERE g < least(n, hi - lo + 1))
SELECT DISTINCT lo, hi, n, CAST(v AS BIGINT) AS v FROM v""")
def subsample_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled(_grids(spark, sf_dir, **_RANGES), lambda r: [(v,) for v in S.subsample_closed_range(r["lo"], r["hi"], r["n"])], "v long")


_SEEDS_SQL = f"{_grids_sql(**_SIDE)}, s AS (SELECT DISTINCT n, 20 + CAST(round_even(i * (n // 2 - 20) / 4.0, 0) AS BIGINT) AS seed FROM g, range(5) x(i)), h AS (SELECT DISTINCT n, seed * m AS f FROM s, range(1, 7) y(m) WHERE seed * m <= n)"
_TRIPLE = "fx long, fy long, fz long"


@query(f"WITH {_SEEDS_SQL} SELECT n, f AS fx, f AS fy, CAST(z AS BIGINT) AS fz FROM h, range(1, 9) w(z)")
def block_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled(_grids(spark, sf_dir, **_SIDE), lambda r: S.block_triples(r["n"], r["n"], 8, 50.0, 1000.0, 50.0, 400.0), _TRIPLE)


@query(f"WITH {_grids_sql(**_SIDE)}, h AS (SELECT DISTINCT n, 20 + CAST(round_even(i * (n - 20) / 9.0, 0) AS BIGINT) AS f FROM g, range(10) x(i)) SELECT n, f AS fx, f AS fy, CAST(z AS BIGINT) AS fz FROM h, range(1, 9) w(z)")
def sliding_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled(_grids(spark, sf_dir, **_SIDE), lambda r: S.sliding_triples(r["n"], r["n"], 8, 50.0, 1000.0, 50.0, 400.0), _TRIPLE)


@query(f"WITH {_SEEDS_SQL}, c AS (SELECT DISTINCT n, n // 2 + CAST(round_even(i * (n - n // 2) / 4.0, 0) AS BIGINT) AS f FROM g, range(5) x(i)) SELECT n, f AS size FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.n = c.n AND h.f = c.f)")
def hybrid_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    def extras(r):
        return [(w,) for w in S.extra_windows(r["n"], r["n"], 50.0, 1000.0, set(S.block_factors(r["n"], r["n"], 50.0, 1000.0)))]

    return scheduled(_grids(spark, sf_dir, **_SIDE), extras, "size long")


@query(f"""WITH {_grids_sql(**_SIDE)}, f AS (SELECT DISTINCT n, s * (1 << k) AS f FROM g, (VALUES (1), (3), (31)) v(s), range(0, 7) w(k) WHERE s * (1 << k) BETWEEN 4 AND n UNION SELECT n, n FROM g)
SELECT n, CAST(f AS BIGINT) AS factor, f * 50.0::DOUBLE AS resolution_h, CAST(n // f AS BIGINT) AS cells FROM f""")
def seed_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled(_grids(spark, sf_dir, **_SIDE), lambda r: S.seed_schedule(r["n"], 50.0, (1, 3, 31), 200.0), "factor long, resolution_h double, cells long")


@query(f"""WITH {_grids_sql(n='12 * l_linenumber')} SELECT n, CAST(f AS BIGINT) AS fx, CAST(f AS BIGINT) AS fy, CAST(z AS BIGINT) AS fz FROM g, range(1, 85) a(f), range(1, 13) b(z)
WHERE n % f = 0 AND 36 % f = 0 AND (f = 1 OR f * 50 >= 150) AND 12 % z = 0 AND z * 50 <= 200""")
def divisor_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled(_grids(spark, sf_dir, n="12 * l_linenumber"), lambda r: S.divisor_triples(r["n"], 36, 12, 50.0, 150.0, 50.0, 200.0), _TRIPLE)


@query(f"WITH {_grids_sql(dz='10 * l_linenumber')} SELECT dz, CAST(1 << k AS BIGINT) AS factor, (1 << k) * dz * 1.0::DOUBLE AS thickness FROM g, range(0, 7) a(k) WHERE (1 << k) * dz <= 400 OR k = 0")
def z_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled(_grids(spark, sf_dir, dz="10 * l_linenumber"), lambda r: S.z_scheme([float(r["dz"])] * 127, 400.0), "factor long, thickness double")


@query(f"""WITH {_grids_sql(**_PLACES)}, c AS (SELECT *, least(outputs, n - window_size + 1) AS e FROM g WHERE window_size <= n)
SELECT n, window_size, outputs, CAST(CASE WHEN e = 1 THEN 0 ELSE i * (n - window_size) // (e - 1) END AS BIGINT) AS start FROM c, range(0, 4) x(i) WHERE i < e""")
def window_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = _grids(spark, sf_dir, **_PLACES).where("window_size <= n")
    return scheduled(fits, lambda r: [(a,) for a in S.anchors(r["n"], r["window_size"], r["outputs"])], "start long")


@query("""WITH c AS (SELECT DISTINCT l_linenumber * l_linenumber * 1.0::DOUBLE AS x FROM lineitem), o AS (SELECT x, lag(x) OVER (ORDER BY x) AS p, lead(x) OVER (ORDER BY x) AS n FROM c)
SELECT (x + n) / 2 AS edge FROM o WHERE n IS NOT NULL UNION ALL SELECT x - (n - x) / 2 FROM o WHERE p IS NULL UNION ALL SELECT x + (x - p) / 2 FROM o WHERE n IS NULL""")
def centers_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = [x[0] for x in table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * F.col("l_linenumber")).cast("double")).distinct().collect()]
    return spark.createDataFrame([(e,) for e in S.centers_to_edges(sorted(centers))], "edge double")


# Blocks


def _block(keys: str, where: str, values: list[str]) -> str:
    return f"WITH {VOX_SQL} SELECT {keys}, {', '.join(values)} FROM vox WHERE {where} GROUP BY ALL"


@query(_block("timestep, i // 5 AS ic, j // 5 AS jc", "k = 0 AND i < 10 AND j < 10", [r("avg(hus)", "hus"), r("avg(wa)", "wa")]))
def block_mean_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.block_aggregate(voxels(spark, sf_dir).where("k = 0"), SHAPE, {"i": 5, "j": 5}, B.means(["hus", "wa"]), ["timestep"]), ["hus", "wa"])


@query(_block("timestep, k, i // 5 AS ic, j // 5 AS jc", "i < 10 AND j < 10", [r("avg(hus)", "hus"), r("avg(wa)", "wa")]))
def block_mean_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.block_aggregate(voxels(spark, sf_dir), SHAPE, {"i": 5, "j": 5}, B.means(["hus", "wa"]), ["timestep", "k"]), ["hus", "wa"])


@query(_block("timestep, i, j, k // 2 AS kc", "k < 24", [r("avg(hus)", "hus"), r("avg(wa)", "wa")]))
def block_mean_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.block_aggregate(voxels(spark, sf_dir), SHAPE, {"k": 2}, B.means(["hus", "wa"]), ["timestep", "i", "j"]), ["hus", "wa"])


BOX = "timestep, i // 2 AS ic, j // 2 AS jc, k // 3 AS kc"
CUBE = {"i": 2, "j": 2, "k": 3}


@query(_block(BOX, "k < 24", [r("avg(hus)", "hus"), r("avg(wa)", "wa")]))
def block_mean_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.block_aggregate(voxels(spark, sf_dir), SHAPE, CUBE, B.means(["hus", "wa"]), ["timestep"]), ["hus", "wa"])


@query(_block(BOX, "k < 24", [r("avg(hus * wa)", "hus_wa"), r("avg(ua * ua)", "ua_ua")]))
def block_product_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = [B.product_mean("hus", "wa", "hus_wa"), B.product_mean("ua", "ua", "ua_ua")]
    return rounded(B.block_aggregate(voxels(spark, sf_dir), SHAPE, CUBE, products, ["timestep"]), ["hus_wa", "ua_ua"])


@query(_block(BOX, "k < 24", [r("avg(wa)", "wa"), r("var_pop(wa) * count(wa)", "m2_wa")]))
def block_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.block_aggregate(voxels(spark, sf_dir), SHAPE, CUBE, [*B.means(["wa"]), B.m2("wa", "m2_wa")], ["timestep"]), ["wa", "m2_wa"])


@query(_block(BOX, "k < 24", [r("avg(hus)", "hus"), r("avg(wa)", "wa"), r("covar_pop(hus, wa) * count(wa)", "c_hus_wa")]))
def block_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.block_aggregate(voxels(spark, sf_dir), SHAPE, CUBE, [*B.means(["hus", "wa"]), B.co_moment("hus", "wa", "c_hus_wa")], ["timestep"]), ["hus", "wa", "c_hus_wa"])


def _moments_sql() -> list[str]:
    share = {"liq_fraction": "clw > 1e-10", "ice_fraction": "cli > 1e-10", "cloud_fraction": "clw > 1e-10 OR cli > 1e-10"}
    out = [f"avg({f}) AS {n}" for n, f in MEAN_OF.items()] + [f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS {n}" for n, c in share.items()]
    out.append("0.5 * (var_pop(ua) + var_pop(va) + var_pop(wa)) AS tke")
    out += [f"var_pop({SHORT[c[4:]]}) AS {c}" for c in VARIANCES]
    return out + [f"covar_pop({', '.join(SHORT[p] for p in c[4:].split('_'))}) AS {c}" for c in COVARIANCES]


ROUNDED = ", ".join(r(c, c) for c in DIAGNOSTICS)


@query(f"WITH {VOX_SQL}, c AS (SELECT {BOX}, {', '.join(_moments_sql())} FROM vox WHERE k < 24 GROUP BY ALL) SELECT timestep, ic, jc, kc, {ROUNDED} FROM c")
def block_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.block_aggregate(voxels(spark, sf_dir), SHAPE, CUBE, B.moment_aggregates(), ["timestep"]), DIAGNOSTICS)


@query(_block("timestep, k", "true", [r("avg(hus)", "hus"), r("avg(wa)", "wa")]))
def domain_mean_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voxels(spark, sf_dir).groupBy("timestep", "k").agg(*B.means(["hus", "wa"])), ["hus", "wa"])


@query("""WITH l AS (SELECT DISTINCT l_linenumber - 1 AS k, (l_linenumber + 1) // 2 * 10.0::DOUBLE AS dz FROM lineitem), f AS (SELECT unnest([1, 2, 3]) AS fz)
SELECT CAST(fz AS BIGINT) AS fz, CAST(k // fz AS BIGINT) AS kc, sum(dz) AS dz FROM l, f WHERE k < 7 - 7 % fz GROUP BY ALL""")
def dz_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of one column, whose thicknesses grow."""
    level = F.col("l_linenumber")
    levels = table(spark, sf_dir, "lineitem").select((level - 1).alias("k"), (F.floor((level + 1) / 2) * 10.0).alias("dz")).distinct()
    return B.level_thickness(levels, [1, 2, 3])


# Scalars


@query(f"WITH {VOX_SQL} SELECT timestep, i, j, k, {r('clw', 'clw', 9)}, {r('cli', 'cli', 9)} FROM vox")
def phase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voxels(spark, sf_dir).select("timestep", "i", "j", "k", "clw", "cli"), ["clw", "cli"], 9)


@query(f"""WITH {VOX_SQL} SELECT timestep, k, {r('avg(CASE WHEN clw > 1e-10 THEN 1.0 ELSE 0 END)', 'liq_fraction')}, {r('avg(CASE WHEN cli > 1e-10 THEN 1.0 ELSE 0 END)', 'ice_fraction')},
{r('avg(CASE WHEN clw > 1e-10 OR cli > 1e-10 THEN 1.0 ELSE 0 END)', 'cloud_fraction')} FROM vox GROUP BY ALL""")
def cloud_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = {"liq_fraction": P.present("clw"), "ice_fraction": P.present("cli"), "cloud_fraction": P.cloudy("clw", "cli")}
    return rounded(voxels(spark, sf_dir).groupBy("timestep", "k").agg(*(F.avg(c.cast("double")).alias(n) for n, c in share.items())), list(share))


@query(f"WITH {VOX_SQL} SELECT timestep, i, j, k, {r('0.5 * (ua * ua + va * va + wa * wa)', 'ke')} FROM vox")
def kinetic_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voxels(spark, sf_dir).select("timestep", "i", "j", "k", P.kinetic_energy("ua", "va", "wa").alias("ke")), ["ke"])


@query(f"WITH {VOX_SQL} SELECT timestep, k, {r('0.5 * count(*) * (var_pop(ua) + var_pop(va) + var_pop(wa))', 'tke', 6)} FROM vox GROUP BY ALL")
def tke_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voxels(spark, sf_dir).groupBy("timestep", "k").agg(P.tke_total("ua", "va", "wa").alias("tke")), ["tke"], 6)


@query(f"WITH {VOX_SQL} SELECT timestep, k, {r('0.5 * (avg(ua * ua) - avg(ua) * avg(ua) + avg(va * va) - avg(va) * avg(va) + avg(wa * wa) - avg(wa) * avg(wa))', 'tke')} FROM vox GROUP BY ALL")
def tke_from_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).groupBy("timestep", "k").agg(*(B.product_mean(f, f, f"{f}2") for f in ("ua", "va", "wa")), *B.means(["ua", "va", "wa"]))
    return rounded(v.select("timestep", "k", P.tke_from_moments("ua2", "ua", "va2", "va", "wa2", "wa").alias("tke")), ["tke"])


@query(f"WITH {VOX_SQL} SELECT timestep, k, {r('avg(hus * wa) - avg(hus) * avg(wa)', 'cov')}, {r('avg(wa * wa) - avg(wa) * avg(wa)', 'var')} FROM vox GROUP BY ALL")
def covariance_from_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).groupBy("timestep", "k").agg(B.product_mean("hus", "wa", "hw"), B.product_mean("wa", "wa", "ww"), *B.means(["hus", "wa"]))
    return rounded(v.select("timestep", "k", P.covariance_from_moments("hw", "hus", "wa").alias("cov"), P.variance_from_moments("ww", "wa").alias("var")), ["cov", "var"])


@query(_block(BOX, "k < 24", [r("least(greatest(covar_pop(hus, wa) / sqrt(greatest(var_pop(hus) * var_pop(wa), 0)), -1), 1)", "corr_qt_w", 5)]))
def pearson_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.block_aggregate(voxels(spark, sf_dir), SHAPE, CUBE, B.moment_aggregates(), ["timestep"])
    return rounded(df.select("timestep", "ic", "jc", "kc", P.correlation("cov_qt_w", "var_qt", "var_w").alias("corr_qt_w")), ["corr_qt_w"], 5)


# The table


def _emit_sql(cells: str, extra: str = "", domain: int = 1100, month: int = -1) -> str:
    names = [c for c in FLOATS if c not in ("resolution_h", "domain_h", "resolution_z", "q_con")]
    q = "round(CAST(CAST(q_liq AS FLOAT) + CAST(q_ice AS FLOAT) AS DOUBLE), 5) AS q_con"
    return f"""{cells}, t AS (SELECT *, max(q_liq + q_ice) OVER (PARTITION BY timestep, fx, fz, kc{extra}) AS top FROM c)
SELECT {', '.join(f'round(CAST(CAST({n} AS FLOAT) AS DOUBLE), 5) AS {n}' for n in names)}, {q}, CAST(fx * 100 AS DOUBLE) AS resolution_h, {domain}.0::DOUBLE AS domain_h, CAST(fz * 50 AS DOUBLE) AS resolution_z,
'unknown' AS data_source, CAST({month} AS BIGINT) AS month, CAST(-1 AS BIGINT) AS "cfSite_number", 'unknown' AS forcing_model, 'unknown' AS experiment
FROM t WHERE top > 1e-10 AND q_liq + q_ice >= 1e-10"""


def _out(df: DataFrame) -> DataFrame:
    return rounded(df, FLOATS, 5).select(*COLUMNS)


_BLOCKS = f"""WITH {VOX_SQL}, h AS (SELECT unnest([2, 3, 4, 5, 6, 8, 9, 10, 12]) AS fx), z AS (SELECT unnest([1, 2, 3, 4]) AS fz),
c AS (SELECT timestep, fx, fz, i // fx AS ic, j // fx AS jc, k // fz AS kc, {', '.join(_moments_sql())} FROM vox, h, z WHERE i < 12 - 12 % fx AND j < 12 - 12 % fx AND k < 25 - 25 % fz GROUP BY ALL)"""


@query(_emit_sql(_BLOCKS))
def multiscale_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(builder.coarsen_chunk(voxels(spark, sf_dir), GEOMETRY, OPTIONS.having(coarsening_mode="block")))


@query(f"""{_BLOCKS}, d AS (SELECT NOT (isfinite(q_liq) AND isfinite(qt)) AS bad, q_liq + q_ice <= 1e-10 AS clear FROM c)
SELECT 'cells' AS rule, count(*) AS n FROM d UNION ALL SELECT 'incomplete', 0 UNION ALL SELECT 'not_finite', CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) FROM d UNION ALL SELECT 'clear', CAST(sum(CASE WHEN clear THEN 1 ELSE 0 END) AS BIGINT) FROM d""")
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the flagship table and why some were left out, counted while the table is written."""
    dropped = B.Dropped()
    rows = builder.coarsen_chunk(voxels(spark, sf_dir), GEOMETRY, OPTIONS.having(coarsening_mode="block"), dropped=dropped)
    shared.written(rows, "counted")
    return spark.createDataFrame(list(dropped.counts().items()), "rule string, n long")


def _windows(sizes: str, name: str, levels: str = "st") -> str:
    return f"""{name} AS (SELECT timestep, fx, fz, a.s AS ic, b.s AS jc, d.s AS kc, {', '.join(_moments_sql())} FROM vox, ({sizes}) w,
(SELECT n, w, s FROM st) a, (SELECT n, w, s FROM st) b, (SELECT n, w, s FROM {levels}) d
WHERE a.n = 12 AND a.w = fx AND b.n = 12 AND b.w = fx AND d.n = 25 AND d.w = fz AND i >= a.s AND i < a.s + fx AND j >= b.s AND j < b.s + fx AND k >= d.s AND k < d.s + fz GROUP BY ALL)"""


_STARTS = "st AS (SELECT DISTINCT n, w, s FROM (SELECT n, w, unnest([0, n - w]) AS s FROM (VALUES (12), (25)) a(n), range(1, 13) b(w)) WHERE s >= 0)"


_FOUR = "sz AS (SELECT DISTINCT n, w, i * (n - w) // 3 AS s FROM (SELECT 25 AS n), range(1, 13) b(w), range(4) x(i))"


@query(_emit_sql(f"WITH {VOX_SQL}, {_STARTS}, {_FOUR}, {_windows('SELECT fx, fz FROM (SELECT unnest([2, 3, 4, 5, 6, 8, 9, 10, 11, 12]) AS fx), range(1, 5) q(fz)', 'c', 'sz')}"))
def multiscale_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten sizes at both ends of the domain and at four heights, of which two meet cloud."""
    return _out(builder.coarsen_chunk(voxels(spark, sf_dir), GEOMETRY, OPTIONS.having(coarsening_mode="sliding", outputs_z=4)))


@query(_emit_sql(f"""WITH {VOX_SQL}, {_STARTS}, {_windows('SELECT 7 AS fx, 5 AS fz', 'sl')}, h AS (SELECT unnest([4, 8, 12]) AS fx), z AS (SELECT unnest([2, 4, 6]) AS fz),
bl AS (SELECT timestep, fx, fz, i // fx AS ic, j // fx AS jc, k // fz AS kc, {', '.join(_moments_sql())} FROM vox, h, z WHERE i < 12 - 12 % fx AND j < 12 - 12 % fx AND k < 25 - 25 % fz GROUP BY ALL),
c AS (SELECT * FROM bl UNION ALL SELECT * FROM sl)"""))
def multiscale_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(builder.coarsen_chunk(voxels(spark, sf_dir), GEOMETRY, OPTIONS.having(max_dz=350.0, budget=1)))


def _levels(raw: str) -> str:
    return f"{raw}, lv AS (SELECT timestep, k, greatest(max(q_c), 0) <= 1e-10 AS empty FROM raw GROUP BY ALL)"


def _keep(raw: str) -> str:
    return f"{_levels(raw)}, kp AS (SELECT timestep, k, bool_or(NOT empty) OVER (PARTITION BY timestep ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) OR k = min(k) OVER (PARTITION BY timestep) OR k = max(k) OVER (PARTITION BY timestep) AS keep FROM lv)"


_LEVELS, _KEEP = _levels(RAW_SQL), _keep(RAW_SQL)
_NONEMPTY = f"{_LEVELS}, ne AS (SELECT timestep, k, k - row_number() OVER (PARTITION BY timestep ORDER BY k) AS g FROM lv WHERE NOT empty), sp AS (SELECT timestep, min(k) AS lo, max(k) AS hi FROM ne GROUP BY timestep, g)"


def _span_table(n: int, sizes: list[int], month: int = -1) -> str:
    """The blocks of the spans of the first n by n columns."""
    raw = f"{RAW_SQL[:-1]} WHERE i < {n} AND j < {n})"
    return _emit_sql(f"""WITH {_keep(raw)}, isl AS (SELECT timestep, k, k - row_number() OVER (PARTITION BY timestep ORDER BY k) AS g FROM kp WHERE keep),
run AS (SELECT timestep, k, min(k) OVER (PARTITION BY timestep, g) AS lo, max(k) OVER (PARTITION BY timestep, g) AS hi FROM isl),
h AS (SELECT unnest({sizes}) AS fx), z AS (SELECT unnest([1, 2, 3, 4]) AS fz),
vox AS (SELECT raw.* EXCLUDE (q_c), least(greatest((ta - 233.0) / (273.15 - 233.0), 0.0), 1.0) * q_c AS clw, (1 - least(greatest((ta - 233.0) / (273.15 - 233.0), 0.0), 1.0)) * q_c AS cli, lo, hi FROM raw JOIN run USING (timestep, k)),
c AS (SELECT timestep, lo, fx, fz, i // fx AS ic, j // fx AS jc, (k - lo) // fz AS kc, {', '.join(_moments_sql())} FROM vox, h, z
WHERE i < {n} - {n} % fx AND j < {n} - {n} % fx AND k - lo < hi - lo + 1 - (hi - lo + 1) % fz AND fz <= hi - lo + 1 GROUP BY ALL)""", ", lo", 100 * (n - 1), month)


@query(_span_table(12, [2, 3, 4, 5, 6, 8, 9, 10, 12]))
def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(builder.build_table(raw_voxels(spark, sf_dir), GEOMETRY, OPTIONS))


@query(f"SELECT * FROM ({_span_table(12, [2, 3, 4, 5, 6, 8, 9, 10, 12], 1)}) UNION ALL SELECT * FROM ({_span_table(8, [2, 3, 4, 6, 8], 7)})")
def many_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cases of different grids as one plan: their geometries are rows of a table."""
    v = raw_voxels(spark, sf_dir)
    both = v.withColumn("month", F.lit(1).cast("long")).unionByName(v.where("i < 8 and j < 8").withColumn("month", F.lit(7).cast("long")))
    grids = [(1, *many.grid_row(GEOMETRY)), (7, *many.grid_row(builder.Geometry(8, 8, GEOMETRY.dz, DX)))]
    return _out(many.build_many(both, spark.createDataFrame(grids, f"month long, {many.GRID}"), OPTIONS).rows)


_RUN = f"""{_KEEP}, isl AS (SELECT timestep, k, k - row_number() OVER (PARTITION BY timestep ORDER BY k) AS g FROM kp WHERE keep),
run AS (SELECT timestep, k, min(k) OVER (PARTITION BY timestep, g) AS lo, max(k) OVER (PARTITION BY timestep, g) AS hi FROM isl),
vox AS (SELECT raw.* EXCLUDE (q_c), {SHARE_SQL} * q_c AS clw, (1 - {SHARE_SQL}) * q_c AS cli, lo, hi FROM raw JOIN run USING (timestep, k))"""


@query(_emit_sql(f"""WITH {_RUN}, w AS (SELECT fx, fz FROM (SELECT unnest([2, 7, 12]) AS fx), (SELECT unnest([1, 3, 4]) AS fz)),
dp AS (SELECT DISTINCT hi - lo + 1 AS d FROM run), h AS (SELECT DISTINCT d, fx, fz FROM dp, w WHERE d >= 4 OR (d = 1 AND fz = 1)),
x AS (SELECT DISTINCT fx AS wx, unnest([0, 12 - fx]) AS s FROM w), zz AS (SELECT DISTINCT d AS wd, fz AS wz, unnest([0, d - fz]) AS s FROM h),
c AS (SELECT timestep, lo, fx, fz, p.s AS ic, q.s AS jc, r.s AS kc, {', '.join(_moments_sql())} FROM vox, h, x p, x q, zz r
WHERE h.d = hi - lo + 1 AND p.wx = fx AND q.wx = fx AND r.wd = h.d AND r.wz = fz AND i >= p.s AND i < p.s + fx AND j >= q.s AND j < q.s + fx AND k - lo >= r.s AND k - lo < r.s + fz GROUP BY ALL)""", ", lo"))
def span_table_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three sizes and heights within each span."""
    return _out(builder.build_table(raw_voxels(spark, sf_dir), GEOMETRY, OPTIONS.having(coarsening_mode="sliding", budget=3)))


# Masks


@query(f"WITH {RAW_SQL}, m AS (SELECT timestep, k, i // 2, j // 2, avg(q_c) AS m FROM raw GROUP BY ALL) SELECT DISTINCT timestep FROM m WHERE m >= 1e-10")
def cloudy_timesteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cloudy_timesteps(raw_voxels(spark, sf_dir), "q_c", NX, NY, ["timestep"])


@query(f"WITH {_LEVELS} SELECT timestep, k, empty FROM lv")
def empty_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.empty_levels(raw_voxels(spark, sf_dir), "q_c", ["timestep"])


@query(f"WITH {_KEEP} SELECT timestep, k, keep FROM kp")
def z_keep_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.keep_levels(empty_levels(spark, sf_dir), ["timestep"], 1, [2, 4])


def _nonempty_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spans(M.keep_levels(empty_levels(spark, sf_dir), ["timestep"], 1, []), ["timestep"])


@query(f"WITH {_NONEMPTY} SELECT timestep, lo, hi FROM sp")
def z_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nonempty_spans(spark, sf_dir)


@query(f"""WITH {_NONEMPTY}, c AS (SELECT *, lo // 4 AS a, hi // 4 AS b FROM sp), w AS (SELECT *, max(b) OVER (PARTITION BY timestep ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY timestep ORDER BY lo) - 1 AS grp FROM w)
SELECT timestep, lo, hi, CAST(grp AS BIGINT) AS "group", CAST(min(a) OVER (PARTITION BY timestep, grp) * 4 AS BIGINT) AS read_lo, CAST(least((max(b) OVER (PARTITION BY timestep, grp) + 1) * 4, 25) - 1 AS BIGINT) AS read_hi FROM g""")
def span_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.span_chunks(_nonempty_spans(spark, sf_dir), ["timestep"], 4, NZ)


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose prices and taxes are not finite in places."""
    price = F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    tax = F.when(F.col("l_partkey") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", price.alias("price"), tax.alias("tax"))


_HOLES = "h AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS price, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem)"


@query(f"WITH {_HOLES} SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, price, tax FROM h WHERE price IS NOT NULL AND tax IS NOT NULL")
def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.finite_rows(_holes(spark, sf_dir), ["price", "tax"])


@query(f"""WITH {_HOLES} SELECT 'price' AS "column", count(*) - count(price) AS bad FROM h UNION ALL SELECT 'tax', count(*) - count(tax) FROM h""")
def nonfinite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nonfinite_counts(_holes(spark, sf_dir), ["price", "tax", "l_quantity"])


@query(f"""WITH {_HOLES} SELECT "column", bad FROM (SELECT 'price' AS "column", count(*) - count(price) AS bad FROM h UNION ALL SELECT 'tax', count(*) - count(tax) FROM h) ORDER BY bad DESC, "column" LIMIT 1""")
def topk_bad_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nonfinite_counts(_holes(spark, sf_dir), ["price", "tax", "l_quantity"], 1)


# Merging


@query("SELECT l_returnflag, count(*) AS n, " + r("avg(l_quantity)", "mean", 6) + ", " + r("var_pop(l_quantity) * count(*)", "m2", 2) + ", " + r("covar_pop(l_quantity, l_discount) * count(*)", "c", 4) + " FROM lineitem GROUP BY ALL")
def merge_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of each group, by parity of the order, merged."""
    x, y, n = P.col("l_quantity"), P.col("l_discount"), F.count(F.lit(1))
    part = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 2).alias("p")).agg(n.alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), B.m2("l_quantity", "m2"), B.co_moment("l_quantity", "l_discount", "c"))
    a, b = (part.where(f"p = {p}").select("l_returnflag", *(F.col(c).alias(f"{c}{p}") for c in ("n", "x", "y", "m2", "c"))) for p in (0, 1))
    both = a.join(b, "l_returnflag", "full").fillna(0)
    c = lambda name: (F.col(f"{name}0"), F.col(f"{name}1"))
    (na, nb), (xa, xb), (ya, yb), (ma, mb), (ca, cb) = (c(k) for k in ("n", "x", "y", "m2", "c"))
    count, mean, m2 = G.merge_pair(na, xa, ma, nb, xb, mb)
    co = G.merge_pair_covariance(na, xa, ya, ca, nb, xb, yb, cb)[3]
    return both.select("l_returnflag", count.alias("n"), F.round(mean, 6).alias("mean"), F.round(m2, 2).alias("m2"), F.round(co, 4).alias("c"))


@query(_block("timestep, i // 4 AS ic, j // 4 AS jc, k // 3 AS kc", "k < 24", ["count(*) AS n", r("avg(hus)", "avg_hus"), r("avg(wa)", "avg_wa"), r("var_pop(hus)", "var_hus"), r("var_pop(wa)", "var_wa"), r("covar_pop(hus, wa)", "cov_hus_wa")]))
def tower_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 3 blocks from 2 x 2 x 1 blocks. Whole blocks are of equal size only on a full grid, so smaller tables may differ."""
    base = G.base_level(voxels(spark, sf_dir), SHAPE, {"i": 2, "j": 2, "k": 1}, ["hus", "wa"], [("hus", "wa")], ["timestep"])
    merged = G.tower_merge(base, {"i": NX // 2, "j": NY // 2, "k": NZ}, {"i": 2, "j": 2, "k": 3}, ["hus", "wa"], [("hus", "wa")], ["timestep"])
    return rounded(merged, ["avg_hus", "avg_wa", "var_hus", "var_wa", "cov_hus_wa"])


@query(f"""WITH {VOX_SQL}, h AS (SELECT unnest([2, 4, 8, 12]) AS fx) SELECT timestep, fx, fx AS fy, i // fx AS ic, j // fx AS jc, k, {r('avg(hus)', 'hus')}, {r('avg(wa)', 'wa')}, {r('avg(hus * wa)', 'hus_wa')} FROM vox, h WHERE i < 12 - 12 % fx AND j < 12 - 12 % fx GROUP BY ALL""")
def multilevel_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = S.horizontal_levels(NX, NY, DX, (1,), MIN_H)
    return rounded(G.multilevel_views(voxels(spark, sf_dir), NX, NY, levels, ["hus", "wa"], [("hus", "wa")], ["timestep"]), ["hus", "wa", "hus_wa"])


# Windows


@query(f"""WITH {VOX_SQL}, s AS (SELECT a.s AS ic, b.s AS jc, c.s AS kc FROM range(0, 10, 2) a(s), range(0, 10, 2) b(s), range(0, 24, 3) c(s))
SELECT timestep, ic, jc, kc, {r('avg(hus)', 'hus')}, {r('avg(hus * wa)', 'hus_wa')} FROM (SELECT timestep, CAST(ic AS INTEGER) AS ic, CAST(jc AS INTEGER) AS jc, CAST(kc AS INTEGER) AS kc, hus, wa FROM vox, s
WHERE i >= ic AND i < ic + 3 AND j >= jc AND j < jc + 3 AND k >= kc AND k < kc + 2) GROUP BY ALL""")
def sliding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.windows(voxels(spark, sf_dir), [(3, 3, 2)], NX, NY, NZ, ["timestep"], strides=(2, 2, 3), aggregates=[*B.means(["hus"]), B.product_mean("hus", "wa", "hus_wa")])
    return rounded(df.drop("fx", "fy", "fz"), ["hus", "hus_wa"])


@query(f"""WITH {VOX_SQL}, s AS (SELECT a.s AS ic, b.s AS jc, c.s AS kc FROM (VALUES (0), (4), (9)) a(s), (VALUES (0), (4), (9)) b(s), (VALUES (0), (11), (23)) c(s))
SELECT timestep, ic, jc, kc, {r('avg(hus)', 'hus')}, {r('var_pop(wa)', 'var_wa')} FROM (SELECT timestep, ic, jc, kc, hus, wa FROM vox, s WHERE i >= ic AND i < ic + 3 AND j >= jc AND j < jc + 3 AND k >= kc AND k < kc + 2) GROUP BY ALL""")
def sliding_anchor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.windows(voxels(spark, sf_dir), [(3, 3, 2)], NX, NY, NZ, ["timestep"], (3, 3, 3), aggregates=[*B.means(["hus"]), F.var_pop("wa").alias("var_wa")])
    return rounded(df.drop("fx", "fy", "fz"), ["hus", "var_wa"])


# Analysis


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS price FROM lineitem GROUP BY ALL")
def group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_reduce(items(spark, sf_dir), ["l_returnflag", "l_linestatus"], "l_extendedprice", name="price")


@query("SELECT l_linenumber, median(l_extendedprice) AS l_extendedprice_reduced, median(l_quantity) AS l_quantity_reduced FROM lineitem GROUP BY ALL")
def group_median_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_reduce_many(items(spark, sf_dir), ["l_linenumber"], ["l_extendedprice", "l_quantity"])


def trimmed_mean(values):
    """Mean of the values between the tenth and the ninetieth percentile: a reducer that is no function of columns."""
    lo, hi = np.quantile(values, [0.1, 0.9])
    return values[(values >= lo) & (values <= hi)].mean()


@query("""WITH s AS (SELECT l_returnflag, l_linenumber, sqrt(l_extendedprice) AS x FROM lineitem), l AS (SELECT l_returnflag, l_linenumber, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM s GROUP BY ALL)
SELECT l_returnflag, l_linenumber, """ + r("avg(x)", "root", 6) + " FROM s JOIN l USING (l_returnflag, l_linenumber) WHERE x BETWEEN lo AND hi GROUP BY ALL")
def group_trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.group_reduce(roots(spark, sf_dir), ["l_returnflag", "l_linenumber"], "root", trimmed_mean, "root"), ["root"], 6)


@query("""WITH b AS (SELECT l_linenumber AS x, CAST(l_quantity AS BIGINT) AS y, CASE WHEN (l_linenumber + l_quantity) % 5 < 4 THEN l_extendedprice END AS v FROM lineitem),
c AS (SELECT x, y, median(v) AS value, count(*) AS n FROM b GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT x FROM b), (SELECT DISTINCT y FROM b))
SELECT y, x, """ + r("coalesce(value, -1)", "value", 4) + ", coalesce(n, 0) AS n FROM g LEFT JOIN c USING (x, y)")
def heatmap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of all line items; some cells have no value."""
    v = F.when((F.col("l_linenumber") + F.col("l_quantity")) % 5 < 4, F.col("l_extendedprice"))
    b = items(spark, sf_dir).select(F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("long").alias("y"), v.alias("v"))
    return rounded(A.heatmap_matrix(b, "x", "y", "v").withColumn("value", F.nanvl("value", F.lit(-1.0))), ["value"], 4)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("root", F.sqrt("l_extendedprice"))


@query("SELECT l_returnflag, " + ", ".join(r(f"quantile_cont(sqrt(l_extendedprice), {q})", f"q{round(100 * q):02d}", 4) for q in (0.1, 0.5, 0.9)) + " FROM lineitem GROUP BY ALL")
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.quantile_summary(roots(spark, sf_dir), ["l_returnflag"], "root"), ["q10", "q50", "q90"], 4)


@query("SELECT l_linenumber, " + r("quantile_cont(sqrt(l_extendedprice), 0.005)", "lo", 4) + ", " + r("quantile_cont(sqrt(l_extendedprice), 0.995)", "hi", 4) + " FROM lineitem GROUP BY ALL")
def robust_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.robust_limits(roots(spark, sf_dir), ["l_linenumber"], "root").drop("rows"), ["lo", "hi"], 4)


@query("SELECT l_linenumber, " + r("greatest(quantile_cont(sqrt(l_extendedprice), 0.05) - 20.0, 40.0)", "lo", 4) + ", " + r("quantile_cont(sqrt(l_extendedprice), 0.95) + 10.0", "hi", 4) + " FROM lineitem GROUP BY ALL")
def quantile_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.quantile_limits(roots(spark, sf_dir), "root", ["l_linenumber"], margin_lo=20.0, margin_hi=10.0, clamp_low=40.0), ["lo", "hi"], 4)


@query("SELECT l_linenumber, min(l_linenumber * 2.5) = max(l_linenumber * 2.5) AS same, min(l_tax) = max(l_tax) AS tax_same FROM lineitem GROUP BY ALL")
def is_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("x", F.col("l_linenumber") * 2.5).groupBy("l_linenumber").agg(A.is_constant("x").alias("same"), A.is_constant("l_tax").alias("tax_same"))


def _binned(by: str, nbins: int, source: str, digits: int = 4) -> str:
    part = f"{by}, " if by else ""
    join = f"JOIN l USING ({by})" if by else ", l"
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH s AS ({source}), l AS (SELECT {part}quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi, count(*) AS rows FROM s {group}),
b AS (SELECT s.*, lo, hi, CAST(least(floor((x - lo) / ((hi - lo) / {nbins})), {nbins - 1}) AS INTEGER) AS bin FROM s {join} WHERE x >= lo AND x <= hi AND rows >= 100)
SELECT {part}bin, {r(f'lo + (bin + 0.5) * (hi - lo) / {nbins}', 'center', 3)}, {r('median(y)', 'median', digits)}, count(*) AS n FROM b GROUP BY ALL"""


@query(_binned("", 30, "SELECT sqrt(l_extendedprice) AS x, l_quantity AS y FROM lineitem"))
def binned_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir).select(F.sqrt("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return rounded(rounded(A.binned_median(df, "x", "y"), ["center"], 3), ["median"], 4)


@query(_binned("l_linenumber", 12, "SELECT l_linenumber, sqrt(l_extendedprice) AS x, l_quantity AS y FROM lineitem WHERE l_linenumber <= 4"))
def stratified_binned_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir).select("l_linenumber", F.sqrt("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return rounded(rounded(A.stratified_binned_median(df, "x", "y", "l_linenumber", 4, 100, 12), ["center"], 3), ["median"], 4)


@query("""WITH s AS (SELECT l_linenumber, sqrt(l_extendedprice) AS x FROM lineitem), l AS (SELECT quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM s),
b AS (SELECT l_linenumber, CAST(least(floor((x - lo) / ((hi - lo) / 48)), 47) AS INTEGER) AS bin FROM s, l WHERE x >= lo AND x <= hi), c AS (SELECT l_linenumber, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT l_linenumber, bin, n, """ + r("n / (sum(n) OVER (PARTITION BY l_linenumber) + 1e-12)", "share", 8) + " FROM c")
def resolution_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.resolution_density(items(spark, sf_dir).withColumn("x", F.sqrt("l_extendedprice")), "x", "l_linenumber"), ["share"], 8)


_COARSE = f"tb AS MATERIALIZED ({_emit_sql(_BLOCKS)})"


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the flagship query, of which the truth analysis is."""
    return shared.written(multiscale_block(spark, sf_dir), "coarse")


def _curves(pairs: list[tuple[str, str]], by: str = "", source: str = "tb") -> str:
    keys = f"{by}, " if by else ""
    parts = [f"SELECT '{x}' AS x, '{y}' AS target, * FROM ({_binned(by, 40, f'SELECT {keys}{x} AS x, {y} AS y FROM {source}', 6)})" for x, y in pairs]
    return f"WITH {_COARSE} " + " UNION ALL ".join(parts)


def _rounded_curves(df: DataFrame) -> DataFrame:
    """The table has five digits, so that a median has six."""
    return rounded(rounded(df, ["center"], 3), ["median"], 6)


@query(_curves([("tke", c) for c in COVARIANCES]))
def tke_against_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_curves(T.tke_against_covariances(_coarse(spark, sf_dir)))


@query(_curves([("tke", c) for c in COVARIANCES], "resolution_h", "(SELECT * FROM tb WHERE resolution_h IN (SELECT DISTINCT resolution_h FROM tb ORDER BY 1 LIMIT 8))"))
def tke_against_covariances_by_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within the first eight resolutions, without those of fewer than a hundred rows."""
    return _rounded_curves(T.tke_against_covariances_by_resolution(_coarse(spark, sf_dir)))


@query(_curves([(x, c) for x in ("liq_fraction", "ice_fraction") for c in COVARIANCES]))
def fractions_against_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_curves(T.fractions_against_covariances(_coarse(spark, sf_dir)))


@query(f"WITH {_COARSE}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS target, resolution_h, {c} AS x FROM tb" for c in VARIANCES + COVARIANCES) + """),
l AS (SELECT target, CASE WHEN target LIKE 'var%' THEN greatest(quantile_cont(x, 0.005), 0) ELSE quantile_cont(x, 0.005) END AS lo, quantile_cont(x, 0.995) AS hi FROM u GROUP BY target),
b AS (SELECT target, resolution_h, CAST(least(floor((x - lo) / ((hi - lo) / 48)), 47) AS INTEGER) AS bin FROM u JOIN l USING (target) WHERE x >= lo AND x <= hi), c AS (SELECT target, resolution_h, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT target, resolution_h, bin, n, """ + r("n / (sum(n) OVER (PARTITION BY target, resolution_h) + 1e-12)", "share", 8) + " FROM c")
def moment_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of all variances and covariances by resolution."""
    return rounded(T.densities(_coarse(spark, sf_dir), VARIANCES + COVARIANCES), ["share"], 8)


@query(f"WITH {_COARSE} " + " UNION ALL ".join(f"SELECT '{c}' AS target, resolution_h, resolution_z, {r(f'sum({c})', 'total', 5)}, count(*) AS n FROM tb GROUP BY ALL" for c in VARIANCES + COVARIANCES))
def resolution_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means times numbers, which have no more digits than the table."""
    cells = T.resolution_grid(_coarse(spark, sf_dir), VARIANCES + COVARIANCES)
    return rounded(cells.withColumn("total", F.col("mean") * F.col("n")).drop("mean"), ["total"], 5)


def _summary(c: str) -> str:
    return f"SELECT '{c}' AS target, {r(f'avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0 END)', 'zero_fraction', 6)}, min({c}) AS min, {r(f'quantile_cont({c}, 0.01)', 'p01', 6)}, {r(f'quantile_cont({c}, 0.5)', 'p50', 6)}, {r(f'quantile_cont({c}, 0.99)', 'p99', 6)}, max({c}) AS max FROM lineitem"


@query(_summary("l_tax") + " UNION ALL " + _summary("l_extendedprice"))
def target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.target_summary(items(spark, sf_dir), ["l_tax", "l_extendedprice"]), ["zero_fraction", "p01", "p50", "p99"], 6)


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'corr', 6)} FROM lineitem" for n, a in enumerate(_FEATURES) for b in _FEATURES[n:]))
def feature_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.feature_correlations(items(spark, sf_dir), _FEATURES), ["corr"], 6)


@query("SELECT DISTINCT CAST(l_linenumber * 100 AS DOUBLE) AS resolution_h FROM lineitem")
def distinct_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select((F.col("l_linenumber") * 100).cast("double").alias("resolution_h")).distinct()


# Loading


@query(f"WITH {RAW_SQL} SELECT timestep, i, j, k, {r('CAST(q_c AS FLOAT)', 'q_c', 6)} FROM raw WHERE timestep = 1 AND k IN (4, 5, 16)")
def scan_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time step's levels out of a chunked store, whose files the executors write here first."""
    path = shared.folder(spark, "store")
    chunks.write_store(raw_voxels(spark, sf_dir), path, ["q_c", "ta"], {"t": NT, "x": NX, "y": NY, "z": NZ}, {"t": 1, "x": 8, "y": NY, "z": 5}, "zyxt")
    grid.register(spark)
    df = spark.read.format("les_grid").option("path", path).option("kind", "zarr").option("fields", "q_c").load()
    return rounded(df.where("timestep = 1 and k in (4, 5, 16)").select("timestep", "i", "j", "k", "q_c"), ["q_c"], 6)


@query(f"""WITH {RAW_SQL} SELECT {r('CAST(var_pop(hus) AS FLOAT)', 'var_qt', 4)}, {r('CAST(covar_pop(hus, wa) AS FLOAT)', 'cov_qt_w', 4)}, CAST(100 * timestep AS DOUBLE) AS resolution_h, CAST(k AS DOUBLE) AS resolution_z FROM raw GROUP BY timestep, k""")
def load_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of moments is written, and read through the operator without its other columns."""
    path = shared.folder(spark, "moments")
    by = raw_voxels(spark, sf_dir).groupBy("timestep", "k").agg(F.avg("hus").alias("qt"), F.var_pop("hus").cast("float").alias("var_qt"), F.covar_pop("hus", "wa").cast("float").alias("cov_qt_w"))
    by.select("qt", "var_qt", "cov_qt_w", (F.col("timestep") * 100).cast("double").alias("resolution_h"), F.col("k").cast("double").alias("resolution_z")).write.parquet(path)
    df, moments = tables.load_moments(spark, path)
    return rounded(df, moments, 4)


@query("SELECT l_orderkey, l_tax FROM lineitem")
def load_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_tax"])


@query("SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders")
def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns chosen by prefix and by name."""
    df = table(spark, sf_dir, "orders")
    return df.select(*tables.select_columns(df.columns, ["o_orderkey", "o_orderstatus"], ["o_orderd", "o_orderp"]))


@query("SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND user_id = 7")
def provenance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    kind = df.agg(F.min("event_type")).first()[0]
    named = df.withColumnsRenamed({"event_type": "data_source", "user_id": "experiment"})
    return A.provenance(named, data_source=kind, experiment=7).withColumnsRenamed({"data_source": "event_type", "experiment": "user_id"})


@query(f"WITH {_HOLES} SELECT l_suppkey AS file, count(*) AS rows, count(*) - count(price) AS bad, count(*) = count(price) AS keep FROM h GROUP BY ALL")
def file_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.file_hygiene(_holes(spark, sf_dir).withColumnRenamed("l_suppkey", "file"), ["price"])


@query("""WITH x AS (SELECT user_id % 50 AS u, event_id, event_type, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END AS n FROM events WHERE event_id % 3 > 0)
SELECT CAST(u AS VARCHAR) || '|1|amip' AS "key", arg_max(event_type, event_id) AS status, arg_max(n, event_id) AS rows, CAST(73 AS BIGINT) AS timesteps, 't' AS "timestamp" FROM x GROUP BY u""")
def manifest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose row count is sometimes no number, beside comments and short lines."""
    e = table(spark, sf_dir, "events")
    rows = F.when(F.col("event_id") % 5 == 0, F.lit("?")).otherwise(F.col("event_id").cast("string"))
    record = F.concat_ws("\t", F.concat(F.col("user_id") % 50, F.lit("|1|amip")), "event_type", rows, F.lit("73"), F.lit("t"))
    line = F.when(F.col("event_id") % 3 > 0, record).when(F.col("event_id") % 2 == 0, F.concat(F.lit("# "), record)).otherwise(F.lit("short\tline"))
    return manifest.latest(e.select(line.alias("value"), F.col("event_id").alias("line")))


@query("""SELECT CAST(n_nationkey AS VARCHAR) || '|1|amip' AS "key", CASE WHEN n_nationkey % 3 = 0 THEN 'done' ELSE 'cloudfree' END AS status, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 10 * n_regionkey + 2 ELSE 0 END AS BIGINT) AS rows, CAST(73 AS BIGINT) AS timesteps FROM nation""")
def manifest_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends; the last record of a case counts."""
    path = shared.folder(spark, "manifest")
    nation = table(spark, sf_dir, "nation").withColumn("key", F.concat(F.col("n_nationkey").cast("string"), F.lit("|1|amip")))
    told = lambda df, status, rows: df.select("key", F.lit(status).alias("status"), rows.cast("long").alias("rows"), F.lit(73).alias("timesteps"))
    done = nation.where("n_nationkey % 3 = 0")
    for records in (told(nation, "cloudfree", F.lit(0)), told(done, "done", F.col("n_regionkey") * 10 + 1), told(done, "done", F.col("n_regionkey") * 10 + 2)):
        manifest.append_rows(records, path)
    return manifest.read(spark, path).drop("timestamp")


@query("""WITH c AS (SELECT m AS month, s AS site, e AS experiment FROM (VALUES (1), (7)) a(m), range(0, 40) b(s), (VALUES ('amip'), ('amip4K')) d(e))
SELECT CAST(month AS BIGINT) AS month, CAST(site AS BIGINT) AS site, experiment FROM c WHERE NOT (experiment = 'amip' AND site IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0))""")
def pending_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = manifest.expand_cases(spark, list(range(40)), [1, 7], ["amip", "amip4K"])
    done = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("site"), F.lit("amip").alias("experiment"))
    return manifest.pending(cases, done, ["site", "experiment"])


@query("""WITH g(forcing_model, month, gone, gone_deep) AS (VALUES ('HadGEM2-A', 10, [0], [94, 100]), ('HadGEM2-A', 7, [0], [0]), ('HadGEM2-A', 4, [15, 17, 18], [32, 92, 94]), ('HadGEM2-A', 1, [15, 17, 18, 19, 20], [0]),
('CNRM-CM5', 10, [15, 22, 23], NULL), ('CNRM-CM5', 7, [13, 14, 15, 18], NULL), ('CNRM-CM5', 4, [11, 12, 13, 14, 15, 17, 18, 21, 22, 23], NULL), ('CNRM-CM5', 1, [14, 15, 17, 18, 19, 20, 21, 22, 23], NULL),
('CNRM-CM6-1', 10, [22, 23], NULL), ('CNRM-CM6-1', 7, [12, 13, 14, 15, 17], NULL), ('CNRM-CM6-1', 4, [13, 14, 15], NULL), ('CNRM-CM6-1', 1, [14, 15, 21, 22, 23], NULL)),
s AS (SELECT forcing_model, month, n FROM g, range(4, 24) r(n) WHERE n <> 16 AND NOT list_contains(gone, n)
UNION ALL SELECT forcing_model, month, n FROM g, (SELECT unnest([30, 31, 32, 33, 66, 67, 68, 69, 70, 82, 92, 94, 96, 99, 100]) AS n) WHERE gone_deep IS NOT NULL AND NOT list_contains(gone_deep, n))
SELECT forcing_model, CAST(month AS BIGINT) AS month, CAST(n AS BIGINT) AS "cfSite_number", CASE WHEN n >= 30 THEN 'deep' ELSE 'shallow' END AS site_type, e AS experiment, s_name FROM s, (VALUES ('amip'), ('amip4K')) x(e), supplier WHERE s_suppkey = n""")
def case_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known cases of the sites that are suppliers' keys."""
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cfSite_number"), "s_name")
    return library.case_library(spark).join(sites, "cfSite_number")


@query("SELECT s_suppkey, s_suppkey % 100 AS \"cfSite_number\", 'HadGEM2-A' AS forcing_model, s_suppkey % 12 + 1 AS month, 'amip' AS experiment FROM supplier")
def parse_case_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.format_string("/data/x.y/Output.cfsite%d_HadGEM2-A_amip_2004-2008.%02d.4x", F.col("s_suppkey") % 100, F.col("s_suppkey") % 12 + 1)
    return table(spark, sf_dir, "supplier").select("s_suppkey", path.alias("path")).select("s_suppkey", *library.parse_case_path("path"))


@query("SELECT c_custkey AS \"key\", c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")))


# Training


def _scaled(spread: str) -> str:
    fixed = {c: f"({c} - avg({c}) OVER ()) / coalesce(nullif({spread}({c}) OVER (), 0), 1)" for c in ("l_quantity", "l_discount")}
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(r(e, c, 5) for c, e in fixed.items()) + " FROM lineitem"


@query(_scaled("stddev_samp"))
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(L.standardize(df, ["l_quantity", "l_discount"]), ["l_quantity", "l_discount"], 5)


@query(_scaled("stddev_pop"))
def standardize_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(L.standardize(df, ["l_quantity", "l_discount"], population=True), ["l_quantity", "l_discount"], 5)


@query("""WITH n AS (SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem) SELECT 'train' AS part, CAST(floor(0.7 * n) AS BIGINT) AS rows FROM n UNION ALL SELECT 'test', CAST(n - floor(0.7 * n) AS BIGINT) FROM n UNION ALL SELECT 'quantity of both', CAST(q AS BIGINT) FROM n""")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the parts of a seeded split of all line items, and what both parts hold."""
    train, test = L.split(items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity"), 0.7, ["l_orderkey", "l_linenumber"])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("q"))
    return both.select("part", "rows").unionByName(both.agg(F.sum("q").cast("long").alias("rows")).select(F.lit("quantity of both").alias("part"), "rows"))


_LOGIT, _TRUTH = "((l_quantity - 25.3) / 5.0)", "(CASE WHEN l_tax > 0.04 THEN l_tax ELSE 0.0 END)"
_BCE = f"greatest({_LOGIT}, 0) - {_LOGIT} * (CASE WHEN {_TRUTH} > 0 THEN 1 ELSE 0 END) + ln(1 + exp(-abs({_LOGIT})))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.when(F.col("l_tax") > 0.04, F.col("l_tax")).otherwise(F.lit(0.0))
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", ((F.col("l_quantity") - 25.3) / 5.0).alias("logit"), truth.alias("truth"), (F.col("l_discount") - 0.0203).alias("magnitude"))


@query(f"SELECT l_orderkey, l_linenumber, {r(_BCE, 'bce', 6)} FROM lineitem")
def bce_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir).select("l_orderkey", "l_linenumber", P.bce_with_logits("logit", (F.col("truth") > 0).cast("int")).alias("bce")), ["bce"], 6)


@query(f"SELECT l_returnflag, {r(f'avg({_BCE}) + avg(CASE WHEN {_TRUTH} > 0 THEN pow(l_discount - 0.0203 - {_TRUTH}, 2) END)', 'loss', 6)} FROM lineitem GROUP BY ALL")
def hurdle_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir).groupBy("l_returnflag").agg(L.hurdle_loss("magnitude", "logit", "truth", F.col("truth") > 0).alias("loss")), ["loss"], 6)


@query(f"SELECT l_orderkey, l_linenumber, {r(f'CASE WHEN {_LOGIT} >= 0 THEN greatest(l_discount - 0.0203, 0) ELSE 0 END', 'decoded', 6)} FROM lineitem")
def decode_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir).select("l_orderkey", "l_linenumber", L.decode("magnitude", "logit").alias("decoded")), ["decoded"], 6)


def _metrics(t: str, p: str, name: str) -> str:
    e = f"({p} - {t})"
    return f"SELECT '{name}' AS target, {r(f'avg({e} * {e})', 'mse', 6)}, {r(f'sqrt(avg({e} * {e}))', 'rmse', 6)}, {r(f'avg(abs({e}))', 'mae', 6)}, {r(f'1 - avg({e} * {e}) / var_pop({t})', 'r2', 6)} FROM lineitem"


@query(_metrics("l_tax", "l_discount", "tax") + " UNION ALL " + _metrics("sqrt(l_quantity)", "sqrt(l_quantity + 1)", "root"))
def target_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir).withColumn("a", F.sqrt("l_quantity")).withColumn("b", F.sqrt(F.col("l_quantity") + 1))
    return rounded(L.target_metrics(df, {"tax": ("l_tax", "l_discount"), "root": ("a", "b")}), ["mse", "rmse", "mae", "r2"], 6)

