"""From voxels to the output table: masks, spans, schedules, coarsening, emission and the partitioned write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schedules as S
from ..functions.physics import partition_condensate
from ..operators import block as B
from ..operators import masks as M
from ..options import BuildOptions
from ..schema import COLUMNS, DIAGNOSTICS, METADATA, OUTPUT, THRESHOLD


@dataclass(frozen=True)
class Geometry:
    """Cells of the domain, their width and the levels' thicknesses. The domain is one interval short of nx * dx."""

    nx: int
    ny: int
    dz: tuple[float, ...]
    dx: float
    domain_h: float | None = None

    @property
    def nz(self) -> int:
        return len(self.dz)

    @property
    def domain(self) -> float:
        return (self.nx - 1) * self.dx if self.domain_h is None else self.domain_h


def split_phases(voxels: DataFrame, q: str = "q_c") -> DataFrame:
    """Voxels with clw and cli in place of the total condensate."""
    liquid, ice = partition_condensate(q, "ta")
    return voxels.withColumn("clw", liquid).withColumn("cli", ice).drop(q)


def table(cells: DataFrame, geometry: Geometry, first_level: Column | int = 0, window: bool = False) -> DataFrame:
    """The 36 output columns of emitted cells. resolution_z is the thickness of the block's or window's own levels."""
    dz = F.array(*(F.lit(float(z)) for z in geometry.dz))
    start = F.col("kc") if window else F.col("kc") * F.col("fz")
    first = first_level if isinstance(first_level, Column) else F.lit(first_level)
    thick = F.aggregate(F.slice(dz, (first + start + 1).cast("int"), F.col("fz")), F.lit(0.0), lambda a, z: a + z)
    return output(cells, thick, F.lit(geometry.dx), F.lit(geometry.domain))


def output(cells: DataFrame, thick: Column, dx: Column, domain: Column) -> DataFrame:
    """The 36 output columns of cells, with the thickness of their levels, the width of a voxel and that of the domain."""
    have = set(cells.columns)
    out = cells.select(
        *(F.col(c).cast("float").alias(c) for c in DIAGNOSTICS),
        (F.col("q_liq").cast("float") + F.col("q_ice").cast("float")).alias("q_con"),
        (F.greatest("fx", "fy").cast("float") * dx.cast("float")).alias("resolution_h"),
        domain.cast("float").alias("domain_h"),
        thick.cast("float").alias("resolution_z"),
        *((F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)).cast(OUTPUT[c].dataType).alias(c) for c, v in METADATA.items()),
    )
    return out.select(*COLUMNS)


def coarsen_chunk(voxels: DataFrame, geometry: Geometry, options: BuildOptions = BuildOptions(), keys: tuple[str, ...] = ("timestep",), triples: list[S.Triple] | None = None, dropped: B.Dropped | None = None) -> DataFrame:
    """The table of whole columns: blocks, windows or both, as the options' mode says. `triples` replaces the block schedule, `dropped` counts what is left out."""
    g, keys = geometry, [*keys, *(c for c in METADATA if c in voxels.columns)]
    scales, extra = schedule(g, list(g.dz), options)
    scales = triples or scales
    parts = []
    if scales:
        parts.append(table(B.emitted(B.blocks(voxels, scales, g.nx, g.ny, g.nz, keys), dropped=dropped), g))
    if extra:
        parts.append(table(B.emitted(B.windows(voxels, extra, g.nx, g.ny, g.nz, keys, *options.placing()), dropped=dropped), g, window=True))
    return checked(together(parts, voxels), options)


def schedule(g: Geometry, dz: list[float], options: BuildOptions) -> tuple[list[S.Triple], list[S.Triple]]:
    """Block and window scales of a column of such levels in the options' mode."""
    arguments = (g.nx, g.ny, len(dz), g.dx, options.min_h, float(sum(dz) / len(dz)), options.max_dz, options.budget)
    if options.coarsening_mode == "sliding":
        return [], S.sliding_triples(*arguments)
    blocks, extra = S.hybrid_triples(*arguments)
    return blocks, extra if options.coarsening_mode == "hybrid" else []


def together(parts: list[DataFrame], voxels: DataFrame) -> DataFrame:
    out = parts[0] if parts else voxels.sparkSession.createDataFrame([], OUTPUT)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def checked(rows: DataFrame, options: BuildOptions) -> DataFrame:
    """With the option check_finite, rows that raise an error where a number is not finite, as they are read."""
    if not options.check_finite:
        return rows
    good = M.all_finite([c for c, f in zip(OUTPUT.names, OUTPUT.fields) if f.dataType.typeName() == "float"])
    return rows.withColumn("qt", F.when(good, F.col("qt")).otherwise(F.raise_error(F.lit("a value of the table is not finite")).cast("float"))).select(*COLUMNS)


def build_table(voxels: DataFrame, geometry: Geometry, options: BuildOptions = BuildOptions(), keys: tuple[str, ...] = ("timestep",)) -> DataFrame:
    """The table of cloudy spans: voxels with q_c, over all cases and time steps at once.

    Time steps without a cloudy 2 x 2 mean go. Levels that are empty and far from cloud go; blocks, windows and their
    vertical schedule start anew in each span of kept levels. One pass over q_c finds each level's maxima, from which all
    this follows; a second one coarsens. The few pairs of a span's bounds are collected to compute their schedules,
    nz * (nz + 1) / 2 at most.
    """
    g, spark = geometry, voxels.sparkSession
    keys = [*keys, *(c for c in METADATA if c in voxels.columns)]
    tops = M.level_tops(voxels, "q_c", g.nx, g.ny, keys)
    cloudy = tops.groupBy(*keys).agg(F.max("block_top").alias("t")).where(F.col("t") >= THRESHOLD).select(*keys)
    empty = tops.join(cloudy, keys, "left_semi").select(*keys, "k", (F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)) <= THRESHOLD).alias("empty"))
    future = [f for f, _ in S.z_scheme(list(g.dz), options.max_dz)]
    levels = M.span_levels(M.keep_levels(empty, keys, 1, future), keys).persist()  # one row a level
    rows, blocks = [], set()
    for r in levels.select("lo", "hi").distinct().collect():
        dz = list(g.dz[r["lo"] : r["hi"] + 1])
        scales, extra = schedule(g, dz, options)
        blocks.update(scales)
        deepest = max((t[2] for t in scales), default=0)
        rows.append((r["lo"], r["hi"], deepest, [list(t) for t in scales], B.window_sizes(extra, g.nx, g.ny, len(dz), *options.placing())))
    if not rows:
        return spark.createDataFrame([], OUTPUT)
    known = F.broadcast(spark.createDataFrame(rows, f"lo int, hi int, deepest int, scales array<array<int>>, windows array<{B.WINDOW}>"))
    own = split_phases(voxels).join(levels, [*keys, "k"]).withColumn("kk", F.col("k") - F.col("lo"))
    keys = [*keys, "lo", "hi"]
    parts = []
    if blocks:
        cells = B.blocks(own, sorted(blocks), g.nx, g.ny, F.col("hi") - F.col("lo") + 1, keys, k="kk", deepest=F.col("hi") - F.col("lo") + 1)
        wanted = F.expr("exists(scales, s -> s[0] = fx and s[1] = fy and s[2] = fz)")
        parts.append(table(B.emitted(cells).join(known, ["lo", "hi"]).where(wanted), g, F.col("lo")))
    if any(r[4] for r in rows):
        wide = known.where("size(windows) > 0")
        with_ends = own.join(wide.select("lo", "hi", *B.segment_ends(F.col("windows"))), ["lo", "hi"])
        cells = B.moment_windows(with_ends, [F.col(f"e{n}") for n in range(3)], lambda c: c.join(wide.select("lo", "hi", "windows"), ["lo", "hi"]), keys, k="kk")
        parts.append(table(B.emitted(cells), g, F.col("lo"), window=True))
    return checked(together(parts, voxels), options)


#: Files that a case is dealt to at most.
FILES_A_CASE = 16


def write_table(df: DataFrame, path: str, mode: str = "overwrite", rows_a_file: int = 2_000_000) -> None:
    """Partitions by case; with overwrite only the cases at hand are replaced. A case without clouds leaves no partition.

    Rows of a case are dealt to FILES_A_CASE tasks, so that none holds a whole case, and to files of so many rows.
    """
    by = ["data_source", "experiment", "month", "cfSite_number"]
    salt = F.pmod(F.xxhash64("qt", "resolution_h", "resolution_z"), F.lit(FILES_A_CASE))
    df.repartition(*by, salt).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_a_file).partitionBy(*by).parquet(path)


def dense(voxels: DataFrame, geometry: Geometry, keys: list[str]) -> DataFrame:
    """Keys whose grid lacks cells; blocks of such grids would mix sizes."""
    return voxels.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") != geometry.nx * geometry.ny * geometry.nz)
