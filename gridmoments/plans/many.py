"""The table of many cases at once, whose grids are rows of a table rather than numbers of the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schedules as S
from .. import shared
from ..operators import block as B
from ..operators import masks as M
from ..options import BuildOptions
from ..schema import METADATA, THRESHOLD
from .builder import Geometry, checked, output, schedule, split_phases, together

#: A case's grid: cells, their width, the domain's width (null: one interval short of nx * dx) and the levels' thicknesses.
GRID = "nx int, ny int, dx double, domain_h double, dz array<double>"
_GRID = ["nx", "ny", "dx", "domain_h", "dz"]
_SHAPE = f"grid long, lo int, hi int, nx int, ny int, dx double, domain_h double, dz array<double>, seeds array<{B.SEED}>, scales array<{B.SCALE}>, windows array<{B.WINDOW}>"


@dataclass
class Build:
    """The output rows, and (the case's columns, timesteps) of every case that has voxels."""

    rows: DataFrame
    steps: DataFrame


def grid_row(g: Geometry) -> tuple[int, int, float, float, list[float]]:
    """A Geometry as the columns of GRID."""
    return g.nx, g.ny, float(g.dx), float(g.domain), [float(z) for z in g.dz]


def _schedules(options: BuildOptions):
    """Adds the scales and windows of each row's span of levels; the rows are few, one for each span that a grid has somewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                dz = r["dz"][r["lo"] : r["hi"] + 1]
                g = Geometry(r["nx"], r["ny"], tuple(r["dz"]), r["dx"], r["domain_h"])
                blocks, extra = schedule(g, dz, options)
                of = S.seeds_of(sorted({t[:2] for t in blocks}))
                windows = B.window_sizes(extra, g.nx, g.ny, len(dz), *options.placing())
                out.append(
                    r | {
                        "dz": dz, "seeds": [{"sx": a, "sy": b} for a, b in sorted(set(of.values()))],
                        "scales": [dict(zip(("fx", "fy", "fz", "ax", "ay"), (*t, *of[t[:2]]))) for t in blocks],
                        "windows": [dict(zip(("fx", "fy", "fz", "xs", "ys", "zs"), w)) for w in windows],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    ints = pa.list_(pa.int32())
    part = lambda *names: pa.list_(pa.struct([(n, ints if n in ("xs", "ys", "zs") else pa.int32()) for n in names]))
    schema = pa.schema(
        [("grid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("nx", pa.int32()), ("ny", pa.int32()), ("dx", pa.float64()), ("domain_h", pa.float64()), ("dz", pa.list_(pa.float64()))]
        + [("seeds", part("sx", "sy")), ("scales", part("fx", "fy", "fz", "ax", "ay")), ("windows", part("fx", "fy", "fz", "xs", "ys", "zs"))]
    )
    return run


def _placed(geometries: DataFrame, case: list[str], options: BuildOptions) -> tuple[DataFrame, DataFrame]:
    """(case, grid, nx, ny, coarser) of every case, and the distinct grids; coarser tells whether levels are merged at all."""
    double = geometries.groupBy(*case).count().where("count > 1").limit(5).collect()
    if double:
        raise ValueError(f"cases with more than one grid: {[tuple(r)[:-1] for r in double]}")
    own = geometries.select(*case, F.col("nx").cast("int"), F.col("ny").cast("int"), F.col("dx").cast("double"), F.coalesce(F.col("domain_h"), (F.col("nx") - 1) * F.col("dx")).cast("double").alias("domain_h"), F.col("dz").cast("array<double>"))

    def coarser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("coarser", pa.array([len(S.z_scheme(dz, options.max_dz)) > 1 for dz in batch.column("dz").to_pylist()], pa.bool_()))

    grids = own.select(*_GRID).distinct().withColumn("grid", F.monotonically_increasing_id())
    grids = shared.written(grids.mapInArrow(coarser, f"{GRID}, grid long, coarser boolean"), "grids")
    return own.join(grids, _GRID).select(*case, "grid", "nx", "ny", "coarser"), grids


def build_many(voxels: DataFrame, geometries: DataFrame, options: BuildOptions = BuildOptions(), keys: tuple[str, ...] = ("timestep",), spans: bool = True, dropped: B.Dropped | None = None) -> Build:
    """The table of all cases in one plan, whatever their number and their grids.

    geometries has a row for each case: columns of the metadata that tell the cases apart, and GRID. Voxels without such a
    row are left out. With spans, voxels have q_c, and blocks and windows start anew in each span of cloudy levels (see
    build_table()); without, whole columns are coarsened, and voxels have clw and cli or q_c.

    Grids, the levels' spans and their schedules are small tables: a row for each distinct grid, for each level of a time
    step, and for each span that a grid has somewhere. They are written once and joined; Spark broadcasts those that are
    small. `dropped` counts the cells that are left out. Voxels are read twice, for the levels' maxima and for the blocks, and once more if there are windows.
    """
    case = [c for c in METADATA if c in geometries.columns]
    if missing := [c for c in case if c not in voxels.columns]:
        raise ValueError(f"the voxels lack {missing}")
    placed, grids = _placed(geometries, case, options)
    step = [*keys, *case]
    named = [c for c in METADATA if c in voxels.columns and c not in case]
    if spans:
        sized = voxels.join(placed.select(*case, "nx", "ny"), case)
        tops = shared.written(M.level_tops(sized, "q_c", F.col("nx"), F.col("ny"), step), "tops")
        cloudy = tops.groupBy(*step).agg(F.max("block_top").alias("t")).where(F.col("t") >= THRESHOLD).select(*step)
        empty = tops.join(cloudy, step, "left_semi").select(*step, "k", (F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)) <= THRESHOLD).alias("empty")).join(placed, case)
        kept = M.keep_levels(empty.where("coarser"), step, 1, [2]).unionByName(M.keep_levels(empty.where("not coarser"), step, 1, []))
        levels = shared.written(M.span_levels(kept, step).join(placed.drop("coarser"), case), "levels")
        shapes = levels.select("grid", "lo", "hi").distinct()
        steps = tops.select(*step).distinct().groupBy(*case).agg(F.count(F.lit(1)).alias("timesteps"))
    else:
        levels = placed.join(grids.select("grid", F.lit(0).alias("lo"), (F.size("dz") - 1).alias("hi")), "grid").drop("coarser")
        shapes = grids.select("grid", F.lit(0).alias("lo"), (F.size("dz") - 1).alias("hi"))
        steps = voxels.join(placed.select(*case), case, "left_semi").select(*step).distinct().groupBy(*case).agg(F.count(F.lit(1)).alias("timesteps"))
    on = ["grid", "lo", "hi"]
    shapes = shared.written(shapes.join(grids.drop("coarser"), "grid").select(*on, *_GRID).mapInArrow(_schedules(options), _SHAPE), "shapes")
    own = split_phases(voxels) if "q_c" in voxels.columns else voxels
    cells_of = levels.join(shapes.select(*on, "seeds", *B.segment_ends(F.col("windows"))), on)
    own = own.join(cells_of, [*step, "k"] if spans else case).withColumn("kk", F.col("k") - F.col("lo"))
    by = [*step, *named, *on, "nx", "ny"]

    def rows(cells: DataFrame, window: bool) -> DataFrame:
        start = F.col("kc") if window else F.col("kc") * F.col("fz")
        thick = F.aggregate(F.slice("dz", (start + 1).cast("int"), F.col("fz")), F.lit(0.0), lambda a, z: a + z)
        return output(B.emitted(cells, dropped=dropped).join(shapes.select(*on, "dx", "domain_h", "dz"), on), thick, F.col("dx"), F.col("domain_h"))

    parts, depth = [], F.col("hi") - F.col("lo") + 1
    if not shapes.where("size(scales) > 0").isEmpty():
        base = B.base_blocks(own.drop("e0", "e1", "e2"), F.col("seeds"), F.col("nx"), F.col("ny"), by, k="kk")
        parts.append(rows(B.merged_blocks(base.join(shapes.select(*on, "scales"), on), F.col("scales"), F.col("nx"), F.col("ny"), depth, by), False))
    if not shapes.where("size(windows) > 0").isEmpty():
        wide = shapes.where("size(windows) > 0").select(*on, "windows")
        cells = B.moment_windows(own.drop("seeds"), [F.col(f"e{n}") for n in range(3)], lambda c: c.join(wide, on), by, k="kk")
        parts.append(rows(cells, True))
    return Build(checked(together(parts, voxels), options), steps)
