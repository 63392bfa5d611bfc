import math
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmoments.functions import physics as P
from gridmoments.operators import analysis as A
from gridmoments.operators import block as B
from gridmoments.operators import masks as M
from gridmoments.operators import merge as G
from gridmoments.operators import training as L
from gridmoments.options import BuildOptions, parse_bool, parse_ints
from gridmoments.plans.builder import Geometry, build_table, coarsen_chunk, dense, split_phases, write_table
from gridmoments.schema import COLUMNS, FIELDS, FLOATS, OUTPUT
from gridmoments.sources import grid, library, manifest, tables


def voxels(spark, shape, **fields):
    """A chunk at time step 0; a field is a number or an array."""
    nx, ny, nz = shape
    i, j, k = (a.ravel() for a in np.indices(shape))
    columns = [np.broadcast_to(np.asarray(fields.get(f, 0.0), float), shape).ravel() for f in FIELDS]
    rows = list(zip(*(x.tolist() for x in ([0] * len(i) and np.zeros(len(i), int), i, j, k, *columns))))
    return spark.createDataFrame(rows, "timestep int, i int, j int, k int, " + ", ".join(f"{f} float" for f in FIELDS))


def cells(df, value, *keys):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_hand_blocks(spark):
    a = np.fromfunction(lambda i, j, k: 1 + i + 4 * j, (4, 4, 1))
    df = B.block_aggregate(voxels(spark, (4, 4, 1), hus=a), {"i": 4, "j": 4}, {"i": 2, "j": 2}, B.means(["hus"]), ["k"])
    assert cells(df, "hus", "ic", "jc") == {(0, 0): 3.5, (1, 0): 5.5, (0, 1): 11.5, (1, 1): 13.5}
    v = voxels(spark, (7, 7, 1), hus=1.0)
    assert B.block_aggregate(v, {"i": 7, "j": 7}, {"i": 3, "j": 3}, B.means(["hus"]), []).count() == 4


def test_uniform_chunk(spark):
    """A constant field: eight blocks, no variance, all liquid."""
    v = voxels(spark, (4, 4, 4), hus=0.01, thetali=300, ta=280, pfull=1e5, rhoa=1, clw=0.002)
    rows = coarsen_chunk(v, Geometry(4, 4, (1.0,) * 4, 1.0), BuildOptions(coarsening_mode="block"), triples=[(2, 2, 2)]).collect()
    assert len(rows) == 8
    for r in rows:
        assert r["resolution_h"] == 2 and r["resolution_z"] == 2 and r["liq_fraction"] == r["cloud_fraction"] == 1 and r["ice_fraction"] == 0
        assert all(r[c] == 0 for c in COLUMNS if c.startswith(("var_", "cov_", "tke")))
        assert (r["data_source"], r["month"]) == ("unknown", -1)


def test_random_chunk_keeps_its_invariants(spark, tmp_path):
    rng = np.random.default_rng(1)
    shape = (16, 16, 8)
    clw, cli = np.zeros(shape), np.zeros(shape)
    clw[:4, :4, 4], cli[:4, :4, 4] = 0.05, 0.01
    noise = {f: rng.standard_normal(shape) for f in ("ua", "va", "wa")}
    v = voxels(spark, shape, hus=0.01 + 1e-5 * rng.standard_normal(shape), thetali=310 + 0.002 * rng.standard_normal(shape), ta=280, clw=clw, cli=cli, **noise)
    g = Geometry(16, 16, (25.0,) * 8, 50.0)
    hybrid = coarsen_chunk(v, g, BuildOptions(min_h=100, max_dz=25)).cache()
    assert hybrid.columns == COLUMNS and hybrid.schema.simpleString() == OUTPUT.simpleString()
    rows = hybrid.collect()
    assert rows and len({r["resolution_h"] for r in rows}) > 1
    for r in rows:
        assert r["tke"] >= 0 and all(r[c] >= 0 for c in COLUMNS if c.startswith("var_"))
        assert abs(r["q_con"] - (r["q_liq"] + r["q_ice"])) <= 1e-8
        assert max(r["liq_fraction"], r["ice_fraction"]) <= r["cloud_fraction"] <= 1 and r["resolution_h"] >= 100 and r["resolution_z"] == 25
    block = coarsen_chunk(v, g, BuildOptions(coarsening_mode="block", min_h=100, max_dz=25))
    assert hybrid.exceptAll(block).isEmpty() and block.exceptAll(hybrid).isEmpty()
    write_table(hybrid, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == len(rows)
    assert dense(v, g, ["timestep"]).isEmpty()


def test_cells_that_are_not_finite_go(spark):
    hus = np.full((8, 8, 6), 0.01)
    hus[0, 0, 0] = np.nan
    v = voxels(spark, (8, 8, 6), hus=hus, clw=0.01, cli=0.005)
    df = coarsen_chunk(v, Geometry(8, 8, (50.0,) * 6, 100.0), BuildOptions(min_h=100, max_dz=50))
    assert df.count() > 0 and M.nonfinite_counts(df, FLOATS).isEmpty()
    with pytest.raises(ValueError, match="hus"):
        M.assert_finite(v, FIELDS)


def test_sliding_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((7, 8, 5))
    df = B.windows(voxels(spark, a.shape, hus=a), [(3, 2, 2)], 7, 8, 5, [], strides=(1, 1, 1), aggregates=B.means(["hus"]))
    got = cells(df, "hus", "ic", "jc", "kc")
    assert len(got) == 5 * 7 * 4
    for (i, j, k), value in got.items():
        assert value == pytest.approx(a.astype(np.float32)[i : i + 3, j : j + 2, k : k + 2].mean(), rel=1e-5, abs=1e-6)
    with pytest.raises(ValueError):
        B.windows(voxels(spark, (2, 2, 2)), [(3, 3, 1)], 2, 2, 2, [])


def test_spans_restart_blocks(spark):
    """Blocks and their schedule start anew in each span of kept levels."""
    shape = (4, 4, 12)
    q = np.zeros(shape)
    q[:, :, [4, 9]] = 1e-3
    v = voxels(spark, shape, ta=280.0, clw=q).withColumnRenamed("clw", "q_c").drop("cli")
    rows = build_table(v, Geometry(4, 4, tuple(range(1, 13)), 100.0), BuildOptions(min_h=200, max_dz=100)).collect()
    # kept: level 0, levels 3-5 and levels 8-11
    assert sorted(r["resolution_z"] for r in rows if r["resolution_h"] == 400) == [5.0, 9.0, 10.0, 15.0, 19.0, 30.0, 42.0]
    assert all(r["q_ice"] == 0 and r["q_liq"] > 0 for r in rows)


def test_masks(spark):
    levels = spark.createDataFrame([(0, k, k not in (3, 4, 5, 9, 12)) for k in range(1, 17)], "t int, k int, empty boolean")
    kept = M.keep_levels(levels, ["t"], 1, [2])
    assert sorted((r.lo, r.hi) for r in M.spans(kept, ["t"]).collect()) == [(1, 6), (8, 13), (16, 16)]
    plain = M.keep_levels(levels, ["t"], 1, [])
    assert sorted(r.k for r in plain.where("keep").collect()) == [3, 4, 5, 9, 12]
    runs = lambda *x: spark.createDataFrame([(0, a, b) for a, b in x], "t int, lo int, hi int")
    groups = lambda *x: sorted({(r.group, r.read_lo, r.read_hi) for r in M.span_chunks(runs(*x), ["t"], 60, 480).collect()})
    assert groups((0, 9), (39, 54)) == [(0, 0, 59)]
    assert groups((0, 9), (304, 309)) == [(0, 0, 59), (1, 300, 359)]
    assert groups((120, 129), (149, 159)) == [(0, 120, 179)]
    q = spark.createDataFrame([(0, 0, 0, 0, float("nan")), (0, 0, 1, 0, 0.0)], "t int, i int, j int, k int, q double")
    assert [r.empty for r in M.empty_levels(q, "q", ["t"]).collect()] == [True]


def test_merge_is_exact(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((32, 32, 2)) * 0.002 + 300
    v = voxels(spark, a.shape, hus=a, wa=rng.standard_normal(a.shape))
    shape = {"i": 32, "j": 32, "k": 2}
    base = G.base_level(v, shape, {"i": 4, "j": 4, "k": 1}, ["hus", "wa"], [("hus", "wa")], [])
    merged = G.tower_merge(base, {"i": 8, "j": 8, "k": 2}, {"i": 2, "j": 2, "k": 2}, ["hus", "wa"], [("hus", "wa")], [])
    once = G.base_level(v, shape, {"i": 8, "j": 8, "k": 2}, ["hus", "wa"], [("hus", "wa")], [])
    for c in ("avg_hus", "var_hus", "cov_hus_wa"):
        x, y = cells(merged, c, "ic", "jc", "kc"), cells(once, c, "ic", "jc", "kc")
        assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k], rel=1e-9, abs=1e-12) for k in x)
    a, b = rng.standard_normal(15), rng.standard_normal(23)
    lit = lambda x: (F.lit(float(len(x))), F.lit(float(x.mean())), F.lit(float(((x - x.mean()) ** 2).sum())))
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(G.merge_pair(*lit(a), *lit(b)), "nms"))).first()
    both = np.concatenate([a, b])
    assert (row["n"], row["m"], row["s"]) == (38, pytest.approx(both.mean(), rel=1e-12), pytest.approx(((both - both.mean()) ** 2).sum(), rel=1e-10))


def test_physics(spark):
    row = spark.range(1).select(
        P.kinetic_energy(F.lit(3), F.lit(4), F.lit(0)).alias("ke"), P.variance_from_moments(F.lit(5), F.lit(2)).alias("v"), P.tke(F.lit(1), F.lit(2), F.lit(3)).alias("t"),
        P.tke_from_moments(*map(F.lit, (5, 2, 6, 1, 7, 1))).alias("m"), P.tke_from_m2(*map(F.lit, (2, 3, 3, 3))).alias("d"), P.present(F.lit(float("nan"))).alias("nan"),
        *(c.alias(n) for c, n in zip(P.partition_condensate(F.lit(1.0), F.lit(233.0)), ("liquid", "ice"))), P.correlation(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("none"), P.correlation(F.lit(3.0), F.lit(1.0), F.lit(1.0)).alias("one"),
        P.bce_with_logits(F.lit(-800.0), F.lit(1)).alias("bce"), P.sigmoid(F.lit(-800.0)).alias("low"),
    ).first()
    assert (row["ke"], row["v"], row["t"], row["m"], row["d"], row["nan"], row["liquid"], row["ice"], row["one"], row["bce"], row["low"]) == (12.5, 1, 3, 6, 2.25, False, 0, 1, 1, 800, 0)
    assert math.isnan(row["none"])


def test_analysis(spark):
    df = spark.createDataFrame([(float(k), float(k % 3), "a") for k in range(100)] + [(float("nan"), 1.0, "a"), (None, 2.0, "a")], "x double, y double, g string")
    one = A.robust_limits(df, [], "x").first()
    assert (one["lo"], one["hi"]) == pytest.approx((0.495, 98.505)) and not df.agg(A.is_constant("x").alias("c")).first()["c"]
    empty = A.robust_limits(df.where("false"), [], "x").first()
    assert (empty["lo"], empty["hi"], df.where("false").agg(A.is_constant("x").alias("c")).first()["c"]) == (0, 1, True)
    same = A.robust_limits(spark.createDataFrame([(5.0,)] * 3, "x double"), [], "x").first()
    assert (same["lo"], same["hi"]) == (4.5, 5.5)
    assert A.quantile_summary(df, ["g"], "x").columns == ["g", "q10", "q50", "q90"]
    bins = A.binned_median(df, "x", "y", 10).collect()
    assert len(bins) == 10 and sum(r["n"] for r in bins) == 98
    assert A.group_reduce(df, ["g"], "x", F.avg).first()["x_reduced"] == pytest.approx(49.5)
    m = spark.createDataFrame([(1.0, 4.0, 1.0)], "cov_a_b double, var_a double, var_b double")
    assert A.with_correlations(m).first()["corr_a_b"] == 0.5 and A.covariance_columns(m) == ["cov_a_b"]
    grid_ = A.heatmap_matrix(spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "x int, y int, v double"), "x", "y", "v").collect()
    assert len(grid_) == 4 and sum(math.isnan(r["value"]) for r in grid_) == 2


def test_training(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 2))
    rows = [(float(a), float(b), float(max(a, 0)), float(a + b)) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, q_liq double, s double")
    model = L.train(df, ["a", "b"], ["q_liq", "s"], hidden=(16,), epochs=60, batch=64, rate=1e-2)
    out = L.predict(df, model)
    metrics = {r["target"]: r for r in L.target_metrics(out, {t: (t, f"pred_{t}") for t in ("q_liq", "s")}).collect()}
    assert metrics["s"]["r2"] > 0.95 and metrics["q_liq"]["r2"] > 0.9
    assert out.where("pred_q_liq < 0").isEmpty()
    train, test = L.split(df, 0.8, ["a", "b"])
    assert (train.count(), test.count()) == (480, 120)
    with pytest.raises(ValueError):
        L.split(df, 0.0, ["a"])
    assert L.output_mapping(["q_liq", "s"]) == {"q_liq": (0, 1), "s": (2, None)}
    z = L.standardize(df.withColumn("c", F.lit(2.0)), ["a", "c"]).agg(F.avg("a").alias("m"), F.stddev_samp("a").alias("s"), F.max("c").alias("c")).first()
    assert (z["m"], z["s"], z["c"]) == pytest.approx((0, 1, 0), abs=1e-9)


def test_options():
    assert BuildOptions.from_env({}).coarsening_mode == "hybrid"
    o = BuildOptions.from_env({"GRIDMOMENTS_COARSENING_MODE": " Block ", "GRIDMOMENTS_BUDGET": "0", "GRIDMOMENTS_CHECK_FINITE": "no", "GRIDMOMENTS_MIN_H": "50"}, max_dz=1.0)
    assert (o.coarsening_mode, o.budget, o.check_finite, o.min_h, o.max_dz) == ("block", 1, False, 50.0, 1.0)
    with pytest.raises(ValueError):
        BuildOptions.from_env({"GRIDMOMENTS_COARSENING_MODE": "convolutional"})
    assert parse_bool("Yes", False) and not parse_bool("0", True) and parse_bool(" ", True)
    assert parse_ints("1, 2,", []) == [1, 2] and parse_ints("", [3]) == [3]
    assert "budget=10" in BuildOptions().summary() and BuildOptions().having(budget=3).budget == 3


def test_grid_source(spark, tmp_path):
    a = np.arange(2 * 3 * 4 * 5, dtype=np.float32).reshape(2, 3, 4, 5)
    np.savez(tmp_path / "g.npz", hus=a.transpose(3, 2, 1, 0), dims="zyxt", chunk=2)
    grid.register(spark)
    df = spark.read.format("les_grid").option("path", str(tmp_path / "g.npz")).option("fields", "hus").load()
    got = cells(df, "hus", "timestep", "i", "j", "k")
    assert len(got) == a.size and all(a[k] == v for k, v in got.items())
    assert df.where("timestep = 1 and k in (1, 2)").count() == 24
    assert grid.axes("zyxt") == (3, 2, 1, 0) and grid.level_chunks(5, 2, range(1, 4)) == [(1, 2), (2, 4)]
    with pytest.raises(ValueError):
        grid.axes("abcd")
    out = grid.scatter([((0, 0, 0), np.ones((1, 2, 2))), ((1, 0, 0), np.zeros((1, 2, 2)))], (2, 2, 2))
    assert out[0].all() and not out[1].any()


def test_grid_folder_is_read_by_slab(spark, tmp_path):
    a = np.arange(2 * 3 * 4 * 5, dtype=np.float32).reshape(2, 3, 4, 5)
    grid.save(str(tmp_path / "s"), "hus", a.transpose(3, 2, 1, 0), "zyxt", 2)
    grid.save(str(tmp_path / "s"), "wa", -a.transpose(3, 2, 1, 0), "zyxt", 2)
    store = grid.NpyStore(str(tmp_path / "s"))
    assert isinstance(store.fields["hus"], np.memmap) and store.chunk == 2
    grid.register(spark)
    df = spark.read.format("les_grid").options(path=str(tmp_path / "s"), kind="npy", fields="hus, wa", month="7", cfSite_number="12", experiment="amip").load()
    assert cells(df, "wa", "timestep", "i", "j", "k") == {k: -v for k, v in np.ndenumerate(a)}
    assert {(r.month, r.cfSite_number, r.experiment) for r in df.select("month", "cfSite_number", "experiment").distinct().collect()} == {(7, 12, "amip")}


def test_netcdf_variables(monkeypatch):
    class Variable:
        shape, dimensions = (2, 5, 4, 3), ("time", "z", "y", "x")

        def chunking(self):
            return [1, 5, 2, 3]

    class Dataset:
        def __init__(self, path, mode):
            self.variables = {"hus": Variable(), "z": type("V", (), {"shape": (5,)})()}

    monkeypatch.setitem(sys.modules, "netCDF4", types.SimpleNamespace(Dataset=Dataset))
    store = grid.netcdf_store("x.nc")
    assert store.dims == {"hus": "tzyx"} and store.chunk == 5 and grid.axes("tzyx") == (0, 3, 2, 1)


def case_voxels(spark, cases, shape, q, *, salt=0):
    """Voxels of cases (site, month) of one grid, with condensate q of a voxel."""
    nx, ny, nz = shape
    cells = spark.range(nx * ny * nz).selectExpr("0 as timestep", f"cast(id div {ny * nz} as int) as i", f"cast(id div {nz} % {ny} as int) as j", f"cast(id % {nz} as int) as k")
    named = spark.createDataFrame(cases, "cfSite_number long, month long").withColumn("experiment", F.lit("amip"))
    noise = lambda n: F.pmod(F.xxhash64("cfSite_number", "month", "i", "j", "k", F.lit(n + salt)), F.lit(1000)) / 1000.0
    v = named.crossJoin(cells).select("*", *(noise(n).alias(f) for n, f in enumerate(f for f in FIELDS if f not in ("clw", "cli", "ta"))), (250 + 40 * noise(99)).alias("ta"))
    return v.withColumn("q_c", F.expr(q) * noise(77))


def test_cases_are_built_once(spark, tmp_path):
    from gridmoments.plans.cases import build_cases, row_counts
    from gridmoments.plans.many import GRID, grid_row

    calls, cloud = [], {1: 0.002, 2: 0.0}

    def load(spark, cases):
        own = sorted((r["site"], r["month"]) for r in cases.collect())
        calls.append(own)
        v = case_voxels(spark, own, (4, 4, 4), f"case when cfSite_number = 1 then {cloud[1]} else {cloud[2]} end")
        g = spark.createDataFrame([(s, m, "amip", *grid_row(Geometry(4, 4, (1.0,) * 4, 100.0))) for s, m in own], f"cfSite_number long, month long, experiment string, {GRID}")
        return v, g

    told = lambda df: {r["key"]: (r["status"], r["rows"], r["timesteps"]) for r in df.collect()}
    cases = manifest.expand_cases(spark, [1, 2], [1], ["amip"])
    table, record = str(tmp_path / "a table"), str(tmp_path / "record")
    first = told(build_cases(spark, cases, load, table, record))
    rows = first["1|1|amip"][1]
    assert rows > 0 and first == {"1|1|amip": ("done", rows, 1), "2|1|amip": ("cloudfree", 0, 1)} and calls == [[(1, 1), (2, 1)]]
    assert told(manifest.read(spark, record)) == first
    assert told(build_cases(spark, cases, load, table, record)) == {} and len(calls) == 1
    assert told(build_cases(spark, cases.where("site = 1"), load, table, record, force=True)) == {"1|1|amip": ("done", rows, 1)}
    assert [tuple(r) for r in row_counts(spark, table).collect()] == [("unknown", "amip", 1, 1, rows)]
    cloud.update({1: 0.0, 2: 0.002})  # the cloud has moved: nothing of the first site stays
    again = told(build_cases(spark, cases, load, table, record, force=True))
    assert again["1|1|amip"] == ("cloudfree", 0, 1) and again["2|1|amip"][0] == "done"
    assert [tuple(r)[:4] for r in row_counts(spark, table).collect()] == [("unknown", "amip", 1, 2)]
    assert told(manifest.read(spark, record)) == again
    manifest.append(spark, record, [(2, 1, "amip", "building", 0, 0)])  # a run that ended halfway
    assert set(told(build_cases(spark, cases, load, table, record))) == {"2|1|amip"}


@pytest.mark.parametrize("mode", ["block", "sliding"])
def test_two_hundred_cases_of_two_grids_in_one_plan(spark, mode):
    from gridmoments.plans.many import GRID, build_many, grid_row

    options = BuildOptions(min_h=200, max_dz=30, coarsening_mode=mode, budget=3)
    a, b = Geometry(4, 4, (10.0, 10.0, 10.0, 12.0, 14.0, 16.0), 100.0), Geometry(6, 5, (20.0,) * 5, 100.0, domain_h=777.0)
    cloud = "case when cfSite_number % 5 = 0 then 0.0 when k = 1 or (k >= 3 and cfSite_number % 2 = 0) then 0.01 else 0.0 end"
    own = {g: [(s, m) for s in range(50) for m in months] for g, months in ((a, (1, 4)), (b, (7, 10)))}
    v = {g: case_voxels(spark, own[g], (g.nx, g.ny, g.nz), cloud) for g in (a, b)}
    geometries = spark.createDataFrame([(s, m, "amip", *grid_row(g)) for g in (a, b) for s, m in own[g]], f"cfSite_number long, month long, experiment string, {GRID}")
    built = build_many(v[a].unionByName(v[b]), geometries, options)
    key = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
    got = sorted(key(r) for r in built.rows.collect())
    want = sorted(key(r) for g in (a, b) for r in build_table(v[g], g, options).collect())
    assert got == want and len({(r[-4], r[-3]) for r in got}) == 160
    assert built.steps.count() == 200
    whole = build_many(v[a].unionByName(v[b]).where("cfSite_number < 3"), geometries, options, spans=False)
    want = sorted(key(r) for g in (a, b) for r in coarsen_chunk(split_phases(v[g].where("cfSite_number < 3")), g, options).collect())
    assert sorted(key(r) for r in whole.rows.collect()) == want and want
    with pytest.raises(ValueError, match="more than one grid"):
        build_many(v[a], geometries.unionByName(geometries.limit(1)), options)


def test_scales_are_merged_from_few_sizes():
    from gridmoments.schedules import seeds_of

    of = seeds_of([(n, n) for n in (1, 2, 3, 4, 6, 9, 5)])
    assert of == {(1, 1): (1, 1), (2, 2): (2, 2), (3, 3): (3, 3), (4, 4): (2, 2), (6, 6): (3, 3), (9, 9): (3, 3), (5, 5): (5, 5)}


def test_blocks_with_missing_voxels_go(spark):
    v = voxels(spark, (4, 4, 2), ta=280, clw=0.002).where("not (i = 0 and j = 0 and k = 0)")
    rows = coarsen_chunk(v, Geometry(4, 4, (1.0,) * 2, 1.0), BuildOptions(coarsening_mode="block"), triples=[(2, 2, 1), (4, 4, 2)]).collect()
    assert len(rows) == 7 and {r["resolution_h"] for r in rows} == {2.0}


def test_small_sources(spark, tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(0.1, 1.0, 2.0, 3.0, 4.0)], "qt double, cov_a_b double, var_a double, resolution_h double, resolution_z double").write.parquet(path)
    df, moments = tables.load_moments(spark, path, extra=("qt",))
    assert moments == ["cov_a_b", "var_a"] and df.columns == ["resolution_h", "resolution_z", "cov_a_b", "var_a", "qt"]
    assert tables.load_features(spark, path, ["qt"], ["var_a"]).schema.simpleString() == "struct<qt:float,var_a:float>"
    assert tables.preview(df, 1)[1] == 1
    source = str(tmp_path / "a.arrow")
    data = pa.table({"a": [1, 2], "b": ["x", "y"]})
    with pa.OSFile(source, "wb") as f, pa.ipc.new_file(f, data.schema) as w:
        w.write_table(data)
    assert tables.migrate_arrow(spark, source, str(tmp_path / "m")) == 2
    tables.write_csv(spark.read.parquet(str(tmp_path / "m")), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_sources(spark, tmp_path):
    good, bad = str(tmp_path / "files/good.parquet"), str(tmp_path / "files/bad.parquet")
    spark.createDataFrame([(0.1, 0.01), (0.2, 0.02)], "qt double, q_liq double").write.parquet(good)
    spark.createDataFrame([(0.1, 0.01), (float("nan"), 0.02)], "qt double, q_liq double").coalesce(1).write.parquet(bad)
    assert tables.clean_files(spark, f"{tmp_path}/files/*.parquet", ["qt", "q_liq"]).count() == 2
    with pytest.raises(ValueError):
        tables.load_columns(spark, good, ["nothing"])
    assert len(tables.list_parquet(spark, str(tmp_path / "files"), 1)) == 1
    assert tables.select_columns(["cov_a", "var_b", "x1", "y"], ["y"], ["cov_"], r"^x\d") == ["cov_a", "x1", "y"]
    path = str(tmp_path / "manifest")
    manifest.append(spark, path, [(10, 1, "amip", "cloudfree", 0, 73)])
    manifest.append(spark, path, [(10, 1, "amip", "done", 5, 73), (11, 1, "amip", "done", 6, 73)])
    got = {r["key"]: (r["status"], r["rows"]) for r in manifest.read(spark, path).collect()}
    assert got == {"10|1|amip": ("done", 5), "11|1|amip": ("done", 6)}
    assert library.site_type(4) == "shallow" and library.site_type(99) == "deep"
    sizes = {r["forcing_model"]: r["count"] for r in library.case_library(spark, deep=False).where("site_type = 'shallow' and experiment = 'amip'").groupBy("forcing_model").count().collect()}
    assert sizes == {"HadGEM2-A": 68, "CNRM-CM5": 50, "CNRM-CM6-1": 61}
    assert library.calibration_cases(spark, ["HadGEM2-A"], None).count() > 68 and library.calibration_cases(spark, most=5).count() == 5


def test_incremental_ingest(spark, tmp_path):
    from gridmoments.streaming.ingest import ingest

    v = voxels(spark, (4, 4, 4), ta=280, clw=0.002).withColumn("month", F.lit(1).cast("long"))
    v.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), v.schema, str(tmp_path / "out"), str(tmp_path / "check"), Geometry(4, 4, (1.0,) * 4, 100.0), BuildOptions(), spans=False)
    assert spark.read.parquet(str(tmp_path / "out")).count() == coarsen_chunk(v, Geometry(4, 4, (1.0,) * 4, 100.0)).count() > 0
    v.write.mode("append").parquet(str(tmp_path / "in"))  # more of a case that is built
    with pytest.raises(Exception, match="earlier batch"):
        ingest(spark, str(tmp_path / "in"), v.schema, str(tmp_path / "out"), str(tmp_path / "check"), Geometry(4, 4, (1.0,) * 4, 100.0), BuildOptions(), spans=False)
    assert split_phases(v.withColumnRenamed("clw", "q_c").drop("cli")).where("clw > 0").count() == 64
