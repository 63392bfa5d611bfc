"""Block and window aggregates of voxels, one scale or many in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.physics import cloudy, col, present, tke
from ..schedules import Triple, seeds_of, starts
from ..schema import COVARIANCES, DIAGNOSTICS, FIELDS, MEAN_OF, SHORT, THRESHOLD, VARIANCES
from .masks import all_finite

Keys = list[str]
Agg = list[Column]


def at(axis: str, factor: int) -> Column:
    """The block that an index falls in."""
    return F.floor(F.col(axis) / factor).cast("int").alias(f"{axis}c")


def whole(shape: dict[str, int], factors: dict[str, int]) -> Column:
    """Cells of complete blocks, counted from the low corner."""
    good = F.lit(True)
    for axis, f in factors.items():
        good = good & (F.col(axis) < shape[axis] - shape[axis] % f)
    return good


def block_aggregate(voxels: DataFrame, shape: dict[str, int], factors: dict[str, int], aggregates: Agg, keys: Keys) -> DataFrame:
    """Aggregates over blocks along the given axes; axes without a factor stay as they are only if they are among the keys."""
    return voxels.where(whole(shape, factors)).groupBy(*keys, *(at(a, f) for a, f in factors.items())).agg(*aggregates)


def means(fields: list[str]) -> Agg:
    return [F.avg(col(f)).alias(f) for f in fields]


def product_mean(x: str, y: str, name: str) -> Column:
    return F.avg(col(x) * col(y)).alias(name)


def m2(x: str, name: str) -> Column:
    """Sum of squared deviations from the mean."""
    return (F.var_pop(col(x)) * F.count(x)).alias(name)


def co_moment(x: str, y: str, name: str) -> Column:
    return (F.covar_pop(col(x), col(y)) * F.count(x)).alias(name)


def moment_aggregates() -> Agg:
    """The diagnostics of a block in double precision."""
    out = [F.avg(col(f)).alias(name) for name, f in MEAN_OF.items()]
    out += [F.avg(present("clw").cast("double")).alias("liq_fraction"), F.avg(present("cli").cast("double")).alias("ice_fraction"), F.avg(cloudy("clw", "cli").cast("double")).alias("cloud_fraction")]
    out.append(tke(F.var_pop(col("ua")), F.var_pop(col("va")), F.var_pop(col("wa"))).alias("tke"))
    out += [F.var_pop(col(SHORT[c[4:]])).alias(c) for c in VARIANCES]
    out += [F.covar_pop(*(col(SHORT[p]) for p in c[4:].split("_"))).alias(c) for c in COVARIANCES]
    return out


def level_thickness(levels: DataFrame, factors: list[int], keys: Keys | None = None, k: str = "k", dz: str = "dz") -> DataFrame:
    """(keys, fz, kc, dz): the thickness of whole groups of fz levels of each column, counted from its lowest."""
    keys = keys or []
    depth = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    held = levels.join(depth, keys) if keys else levels.crossJoin(F.broadcast(depth))  # one row
    held = held.withColumn("fz", F.explode(F.array(*map(F.lit, factors)))).where(F.col(k) < F.col("_n") - F.col("_n") % F.col("fz"))
    return held.groupBy(*keys, F.col("fz").cast("long").alias("fz"), F.floor(F.col(k) / F.col("fz")).alias("kc")).agg(F.sum(dz).alias("dz"))


class Dropped:
    """Counts of the cells that emitted() has dropped, by the first rule that a cell broke, gathered as the cells are computed.

    Hand one to a build and ask counts() after the rows have been written, or otherwise computed once: no scan is added.
    """

    def __init__(self) -> None:
        self.seen: list[Observation] = []

    def watched(self, cells: DataFrame, rules: dict[str, Column]) -> DataFrame:
        seen, before, counts = Observation(), F.lit(False), [F.count(F.lit(1)).alias("cells")]
        for name, broken in rules.items():
            broken = F.coalesce(broken, F.lit(True))
            counts.append(F.coalesce(F.sum((broken & ~before).cast("long")), F.lit(0)).alias(name))
            before = before | broken
        self.seen.append(seen)
        return cells.observe(seen, *counts)

    def counts(self) -> dict[str, int]:
        """All cells, and those that each rule has dropped."""
        total: dict[str, int] = {}
        for seen in self.seen:
            for name, n in seen.get.items():
                total[name] = total.get(name, 0) + n
        return total


def emitted(cells: DataFrame, threshold: float = THRESHOLD, dropped: Dropped | None = None) -> DataFrame:
    """Whole cells with condensate above the threshold and with finite diagnostics; a level without such a cell gives none."""
    q = F.col("q_liq") + F.col("q_ice")
    rules = {"incomplete": F.col("n") != F.col("fx") * F.col("fy") * F.col("fz"), "not_finite": ~all_finite(DIAGNOSTICS) | F.isnan(q), "clear": q <= threshold}
    if dropped is not None:
        cells = dropped.watched(cells, rules)
    return cells.where((F.col("n") == F.col("fx") * F.col("fy") * F.col("fz")) & (q > threshold) & ~F.isnan(q) & all_finite(DIAGNOSTICS)).drop("n")


#: The mean that belongs to each short name of a (co)variance.
_FIELD_OF = {"qt": "qt", "ql": "q_liq", "qi": "q_ice", "w": "w", "h": "theta_li"}

#: Fields whose means a block keeps beside its diagnostics, so that larger blocks can be merged from it.
WIND = ["ua", "va"]


def parts_of(voxels: DataFrame) -> list[Column]:
    """Aggregates of a block from which larger ones can be merged. A null counts as NaN, so that no block is of fewer values than it says."""
    return [F.count(F.lit(1)).alias("n"), *moment_aggregates(), *(F.avg(col(f)).alias(f"_{f}") for f in WIND)]


def merged() -> list[Column]:
    """The same of blocks of equal size: means of means, and mean (co)variances with the (co)variances of the means."""
    mean_of = _FIELD_OF
    out = [F.sum("n").alias("n"), *(F.avg(c).alias(c) for c in [*MEAN_OF, "liq_fraction", "ice_fraction", "cloud_fraction"])]
    out.append((F.avg("tke") + 0.5 * (F.var_pop("_ua") + F.var_pop("_va") + F.var_pop("w"))).alias("tke"))
    out += [(F.avg(c) + F.var_pop(mean_of[c[4:]])).alias(c) for c in VARIANCES]
    return out + [(F.avg(c) + F.covar_pop(*(F.col(mean_of[p]) for p in c[4:].split("_")))).alias(c) for c in COVARIANCES]


def blocks(voxels: DataFrame, triples: list[Triple], nx: int, ny: int, nz: Column | int, keys: Keys, k: str = "k", deepest: Column | None = None) -> DataFrame:
    """(keys, fx, fy, fz, ic, jc, kc, n, diagnostics) of every block of every scale; n is how many voxels it has.

    Two aggregations, no join: voxels meet the few sizes from which all others can be merged (seeds_of), one level deep;
    these blocks meet the scales that they are part of. With `deepest`, a column, scales of more levels do not count.
    """
    of = seeds_of(sorted({t[:2] for t in triples}))
    seeds = F.array(*(F.struct(F.lit(a).alias("sx"), F.lit(b).alias("sy")) for a, b in sorted(set(of.values()))))
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("fx", "fy", "fz", "ax", "ay"), (*t, *of[t[:2]])))) for t in triples))
    return merged_blocks(base_blocks(voxels, seeds, F.lit(nx), F.lit(ny), keys, k), table, F.lit(nx), F.lit(ny), nz if isinstance(nz, Column) else F.lit(nz), keys, deepest)


#: The forms of a size that others are merged from, and of a scale with the size that it is merged from, in columns.
SEED, SCALE = "struct<sx: int, sy: int>", "struct<fx: int, fy: int, fz: int, ax: int, ay: int>"


def base_blocks(voxels: DataFrame, seeds: Column, nx: Column, ny: Column, keys: Keys, k: str = "k") -> DataFrame:
    """(keys, sx, sy, ib, jb, kb, parts) of the blocks, one level deep, of each size of an array column of SEED."""
    fits = F.filter(seeds, lambda s: (F.col("i") < nx - nx % s.sx) & (F.col("j") < ny - ny % s.sy))
    held = [c for c in voxels.columns if c not in keys and c not in ("i", "j", k)]
    whole_ = voxels.select(*keys, "i", "j", k, *(F.coalesce(col(c), F.lit(float("nan"))).alias(c) for c in held if c in FIELDS), F.explode(fits).alias("s"))
    place = [F.floor(F.col(a) / F.col(f"s.{f}")).cast("int").alias(n) for a, f, n in (("i", "sx", "ib"), ("j", "sy", "jb"))]
    return whole_.groupBy(*keys, F.col("s.sx").alias("sx"), F.col("s.sy").alias("sy"), *place, F.col(k).alias("kb")).agg(*parts_of(whole_))


def merged_blocks(base: DataFrame, scales: Column, nx: Column, ny: Column, nz: Column, keys: Keys, deepest: Column | None = None) -> DataFrame:
    """Blocks of every scale of an array column of SCALE from those of base_blocks()."""
    fits = F.filter(
        scales,
        lambda t: (t.ax == F.col("sx")) & (t.ay == F.col("sy")) & (F.col("ib") * t.ax < nx - nx % t.fx) & (F.col("jb") * t.ay < ny - ny % t.fy) & (F.col("kb") < nz - nz % t.fz)
        & (F.lit(True) if deepest is None else t.fz <= deepest),
    )
    cells = base.withColumn("t", F.explode(fits))
    place = [F.floor(F.col(a) * F.col(f"t.{s}") / F.col(f"t.{f}")).cast("int").alias(n) for a, s, f, n in (("ib", "ax", "fx", "ic"), ("jb", "ay", "fy", "jc"))]
    place.append(F.floor(F.col("kb") / F.col("t.fz")).cast("int").alias("kc"))
    return cells.groupBy(*keys, *(F.col(f"t.{f}").alias(f) for f in ("fx", "fy", "fz")), *place).agg(*merged())


def window_sizes(triples: list[Triple], nx: int, ny: int, nz: int, outputs: Triple = (2, 2, 2), strides: tuple[int | None, int | None, int | None] = (None, None, None)) -> list[tuple[int, int, int, list[int], list[int], list[int]]]:
    """(fx, fy, fz, starts along x, y and z) of each window; starts are anchors, or at strides if any is given (then 1 where it is not). A window larger than the data raises ValueError."""
    some, sizes = any(strides), []
    for t in triples:
        at = [starts(n, w, k, (s or 1) if some else None) if w <= n else [] for n, w, k, s in zip((nx, ny, nz), t, outputs, strides)]
        if not all(at):
            raise ValueError(f"window {t} exceeds the data")
        sizes.append((*t, *at))
    return sizes


#: The form of one window of window_sizes() in a column.
WINDOW = "struct<fx: int, fy: int, fz: int, xs: array<int>, ys: array<int>, zs: array<int>>"


def in_windows(voxels: DataFrame, sizes: Column, keys: Keys, aggregates: Agg, k: str = "k") -> DataFrame:
    """Aggregates of the windows of an array column: (keys, fx, fy, fz, ic, jc, kc), the last three the windows' starts. A voxel finds its windows in short arrays of starts."""
    cells = voxels.withColumn("s", F.explode(sizes))
    for axis, all_starts, size, name in (("i", "xs", "fx", "ic"), ("j", "ys", "fy", "jc"), (k, "zs", "fz", "kc")):
        cells = cells.withColumn(name, F.explode(F.filter(F.col(f"s.{all_starts}"), lambda a: (a <= F.col(axis)) & (F.col(axis) < a + F.col(f"s.{size}")))))
    return cells.groupBy(*keys, *(F.col(f"s.{f}").alias(f) for f in ("fx", "fy", "fz")), "ic", "jc", "kc").agg(*aggregates)


_AXES = (("i", "xs", "fx", "ic"), ("j", "ys", "fy", "jc"), ("k", "zs", "fz", "kc"))


def segment_ends(sizes: Column) -> list[Column]:
    """Arrays e0, e1 and e2 of where windows of an array column begin and end along x, y and z."""
    out = []
    for n, (_, all_starts, size, _) in enumerate(_AXES):
        ends = F.flatten(F.transform(sizes, lambda s: F.concat(s[all_starts], F.transform(s[all_starts], lambda a: a + s[size]))))  # noqa: B023
        out.append(F.array_distinct(ends).alias(f"e{n}"))
    return out


def moment_windows(voxels: DataFrame, ends: list[Column], windows_of: Callable[[DataFrame], DataFrame], keys: Keys, k: str = "k") -> DataFrame:
    """(keys, fx, fy, fz, ic, jc, kc, n, diagnostics) of windows, as in_windows() with moment_aggregates().

    The windows' ends (segment_ends()) cut each axis into segments. Voxels are aggregated once, by the segments they lie in;
    windows_of adds a column `windows` to these cells, which make up the windows. Cells are far fewer than voxels where windows
    are large, and never more. Means are weighted by the numbers of voxels, and (co)variances are about the window's own
    means, as parts of unequal size merge.
    """
    cells = voxels
    for n, axis in enumerate(("i", "j", k)):
        cells = cells.withColumn(f"_s{n}", F.array_max(F.filter(ends[n], lambda e: e <= F.col(axis))))  # noqa: B023
    held = [c for c in voxels.columns if c in FIELDS]
    cells = cells.where("_s0 is not null and _s1 is not null and _s2 is not null").withColumns({c: F.coalesce(col(c), F.lit(float("nan"))) for c in held})
    cells = windows_of(cells.groupBy(*keys, "_s0", "_s1", "_s2").agg(*parts_of(cells))).withColumn("s", F.explode("windows")).drop("windows")
    for n, (_, all_starts, size, name) in enumerate(_AXES):
        cells = cells.withColumn(name, F.explode(F.filter(F.col(f"s.{all_starts}"), lambda a: (a <= F.col(f"_s{n}")) & (F.col(f"_s{n}") < a + F.col(f"s.{size}")))))  # noqa: B023
    by = [*keys, *("fx", "fy", "fz"), "ic", "jc", "kc"]
    cells = cells.select("*", *(F.col(f"s.{f}").alias(f) for f in ("fx", "fy", "fz")))
    whole_, n = Window.partitionBy(*by), F.col("n")
    centred = [*_FIELD_OF.values(), "_ua", "_va"]
    cells = cells.withColumns({f"_d_{c}": F.col(c) - F.sum(n * F.col(c)).over(whole_) / F.sum(n).over(whole_) for c in centred})
    mean = lambda x: F.sum(n * x) / F.sum(n)
    d = lambda c: F.col(f"_d_{c}")
    out = [F.sum(n).alias("n"), *(mean(F.col(c)).alias(c) for c in [*MEAN_OF, "liq_fraction", "ice_fraction", "cloud_fraction"])]
    out.append(mean(F.col("tke") + 0.5 * (d("_ua") * d("_ua") + d("_va") * d("_va") + d("w") * d("w"))).alias("tke"))
    out += [mean(F.col(c) + d(_FIELD_OF[c[4:]]) * d(_FIELD_OF[c[4:]])).alias(c) for c in VARIANCES]
    out += [mean(F.col(c) + d(_FIELD_OF[c[4:].split("_")[0]]) * d(_FIELD_OF[c[4:].split("_")[1]])).alias(c) for c in COVARIANCES]
    return cells.groupBy(*by).agg(*out)


def windows(voxels: DataFrame, triples: list[Triple], nx: int, ny: int, nz: int, keys: Keys, outputs: Triple = (2, 2, 2), strides: tuple[int | None, int | None, int | None] = (None, None, None), aggregates: Agg | None = None) -> DataFrame:
    """Aggregates of sliding windows without padding, of one grid for all voxels; see window_sizes(), in_windows() and moment_windows()."""
    told = window_sizes(triples, nx, ny, nz, outputs, strides)
    sizes = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("fx", "fy", "fz"), w)), *(F.array(*map(F.lit, v)).alias(n) for n, v in zip(("xs", "ys", "zs"), w[3:]))) for w in told))
    if aggregates:
        return in_windows(voxels, sizes, keys, aggregates)
    ends = [sorted({e for w in told for a in w[3 + n] for e in (a, a + w[n])}) for n in range(3)]
    return moment_windows(voxels, [F.array(*map(F.lit, e)) for e in ends], lambda cells: cells.withColumn("windows", sizes), keys)
