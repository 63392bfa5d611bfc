"""Files of the classic format, batches for training, tables of the truth analysis."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmoments.operators import truth as T
from gridmoments.schema import COVARIANCES, VARIANCES
from gridmoments.sources import classic
from gridmoments.sources.batches import Batches


def classic_bytes(variables, version=1, records=None):
    """A file of such variables: name -> array; names in `records` have the record dimension first."""
    count = (lambda n: struct.pack(">q", n)) if version == 5 else (lambda n: struct.pack(">i", n))
    offset = (lambda n: struct.pack(">i", n)) if version == 1 else (lambda n: struct.pack(">q", n))
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: count(len(s)) + pad(s.encode())
    records = records or ()
    dims, kinds = [], {"i4": 4, "f4": 5, "f8": 6}
    n = max((len(variables[v]) for v in records), default=0)
    if records:
        dims.append(("time", 0))
    shapes = {}
    for v, a in variables.items():
        own = []
        for k, size in enumerate(a.shape):
            if v in records and k == 0:
                own.append(0)
            else:
                dims.append((f"{v.replace('/', '_')}_{k}", size))
                own.append(len(dims) - 1)
        shapes[v] = own
    head = b"CDF" + bytes([version]) + count(n) + struct.pack(">i", 10) + count(len(dims)) + b"".join(name(d) + count(s) for d, s in dims)
    head += struct.pack(">i", 12) + count(1) + name("title") + struct.pack(">i", 2) + count(5) + pad(b"a les")
    one = lambda v: variables[v].nbytes // (len(variables[v]) if v in records else 1)

    def listing(begins):
        out = struct.pack(">i", 11) + count(len(variables))
        for v, a in variables.items():
            out += name(v) + count(len(shapes[v])) + b"".join(count(d) for d in shapes[v])
            out += struct.pack(">i", 12) + count(1) + name("scale") + struct.pack(">i", 6) + count(1) + struct.pack(">d", 1.5)
            out += struct.pack(">i", kinds[a.dtype.str[1:]]) + count(one(v) + -one(v) % 4) + offset(begins[v])
        return out

    at, begins = len(head) + len(listing(dict.fromkeys(variables, 0))), {}
    fixed = [v for v in variables if v not in records]
    for v in [*fixed, *records]:
        begins[v] = at
        at += one(v) + (-one(v) % 4 if v not in records or len(records) > 1 else 0)
    body = b"".join(pad(variables[v].astype(variables[v].dtype.newbyteorder(">")).tobytes()) for v in fixed)
    for k in range(n):
        part = [variables[v][k : k + 1].astype(variables[v].dtype.newbyteorder(">")).tobytes() for v in records]
        body += b"".join(map(pad, part)) if len(records) > 1 else part[0]
    return head + listing(begins) + body


@pytest.mark.parametrize("version", [1, 2, 5])
def test_classic_format(version):
    a = {"p0": np.arange(5.0), "n": np.array([7], np.int32), "t": np.arange(12, dtype=np.float32).reshape(3, 4), "s": np.arange(3.0)}
    f = classic.ClassicFile(classic_bytes(a, version, ("t", "s")))
    assert f.attributes == {"title": "a les"} and f.variables["p0"].attributes["scale"][0] == 1.5 and f.variables["t"].dims[0] == "time"
    assert all((f.variable(k) == v).all() and f.variable(k).shape == v.shape for k, v in a.items())
    one = {"s": np.arange(5, dtype=np.float32)}
    assert (classic.ClassicFile(classic_bytes(one, version, ("s",))).variable("s") == one["s"]).all()
    whole = classic_bytes(a, version, ("t", "s"))
    for cut in (0, 3, 20, 60, 150):
        with pytest.raises(ValueError):
            classic.ClassicFile(whole[:cut])
    with pytest.raises(ValueError):
        classic.ClassicFile(whole[:-20]).variable("t")
    with pytest.raises(ValueError):
        classic.ClassicFile(b"\x89HDF" + whole)


def test_ranks_make_up_the_field(spark, tmp_path):
    """Four ranks and two times, whose folders' names sort otherwise as text; what lies in other folders does not count."""
    field = {t: np.random.default_rng(t).standard_normal((4, 6, 3)).astype(np.float32) for t in (900, 86400)}
    for t, a in field.items():
        (tmp_path / "fields" / str(t)).mkdir(parents=True)
        for r, (i, j) in enumerate([(0, 0), (0, 2), (1, 0), (1, 2)]):
            block = a[i * 1 : 1 if i == 0 else 4, j : 2 if j == 0 else 6]
            told = {f"nl_{k}": np.array([n], np.int32) for k, n in enumerate(block.shape)} | {f"indx_lo_{k}": np.array([n], np.int32) for k, n in enumerate((i, j, 0))}
            if r != 3:
                told["ql"] = -block.ravel().astype(np.float64)
            (tmp_path / "fields" / str(t) / f"{r}.nc").write_bytes(classic_bytes(told | {"temperature": block.ravel()}))
    (tmp_path / "fields" / "latest").mkdir()
    (tmp_path / "fields" / "latest" / "0.nc").write_bytes(b"no file")
    rows = classic.rank_fields(spark, f"file://{tmp_path}", ["temperature", "ql"]).collect()
    assert {(r.time, r.timestep) for r in rows} == {(900, 0), (86400, 1)}
    assert {(r.time, r.i, r.j, r.k): r.temperature for r in rows} == {(t, *at): v for t, a in field.items() for at, v in np.ndenumerate(a)}
    assert all((r.ql is None) == (r.i > 0 and r.j > 1) and (r.ql is None or r.ql == -r.temperature) for r in rows)
    (tmp_path / "fields" / "900" / "0.nc").write_bytes(classic_bytes({f"nl_{k}": np.array([2], np.int32) for k in range(3)} | {f"indx_lo_{k}": np.array([0], np.int32) for k in range(3)} | {"temperature": np.zeros(7)}))
    with pytest.raises(Exception, match="7 values, not 2 x 2 x 2"):
        classic.rank_fields(spark, str(tmp_path), ["temperature"]).collect()


def test_profiles_of_good_and_broken_files(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(classic_bytes({"profiles/p0": np.arange(3.0) * 100, "z": np.arange(2, dtype=np.float32)}))
    (tmp_path / "b.nc").write_bytes(b"\x89HDF\r\n")
    rows = sorted(((r["path"][-4:], r["k"], r["p0"], r["z"], r["none"]) for r in classic.profiles(spark, f"{tmp_path}/*.nc", ["p0", "z", "none"]).collect()), key=repr)
    assert rows == [("a.nc", 0, 0.0, 0.0, None), ("a.nc", 1, 100.0, 1.0, None), ("a.nc", 2, 200.0, None, None), ("b.nc", None, None, None, None)]


def test_epochs_yield_every_row_once(spark):
    df = spark.range(1000).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 13).cast("double").alias("b"), F.when(F.col("id") % 100 == 7, float("nan")).otherwise(F.col("id") * 2.0).alias("y"))
    data = Batches(df, ["a", "b"], ["y"], size=64, rows_a_file=300, scale=False)
    assert len(data) == 990 and len(data.files) > 1
    first = list(data.epoch(1))
    assert [len(x) for x, _ in first] == [64] * 15 + [30] and first[0][0].dtype == np.float32
    rows = lambda batches: np.concatenate([np.concatenate(b, 1) for b in batches])
    a, again, other = rows(first), rows(data.epoch(1)), rows(data.epoch(2))
    assert (a == again).all() and (a != other).any() and (np.sort(a[:, 0]) == np.sort(other[:, 0])).all()
    assert sorted(a[:, 0]) == [k for k in range(1000) if k % 100 != 7] and (a[:, 2] == 2 * a[:, 0]).all()
    scaled = rows(Batches(df, ["a", "b"], ["y"]).epoch(0))
    assert np.allclose(scaled.mean(0), 0, atol=1e-5) and np.allclose(scaled.std(0), 1, atol=1e-3)


def test_truth_analysis_writes_its_tables(spark, tmp_path):
    rng = np.random.default_rng(0)
    names = ["resolution_h", "resolution_z", "tke", "liq_fraction", "ice_fraction", *VARIANCES, *COVARIANCES]
    rows = [(float(100 * (1 + k % 9)), float(50 * (1 + k % 2)), *map(float, np.abs(rng.standard_normal(3 + len(VARIANCES)))), *map(float, rng.standard_normal(len(COVARIANCES))), "LES" if k % 3 else "other", "m", "amip") for k in range(720)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", data_source string, forcing_model string, experiment string").coalesce(1)
    done = T.truth_analysis(df, str(tmp_path / "out"), data_source="LES")
    read = {n: spark.read.parquet(str(tmp_path / "out" / n)) for n in done}
    assert {r["target"] for r in read["density_resolution_z"].select("target").distinct().collect()} == {*VARIANCES, *COVARIANCES, *(c.replace("cov", "corr") for c in COVARIANCES)}
    assert read["tke"].agg(F.sum("n")).first()[0] == 474 * len(COVARIANCES)  # of 480 rows those between the limits
    assert read["fractions"].select("x").distinct().count() == 2 and read["tke_by_resolution_h"].count() == 0  # no stratum has a hundred rows
    assert read["resolution_grid"].where("target = 'cov_qt_w'").agg(F.sum("n")).first()[0] == 720
    views = T.conditional_views(df.select(F.col("tke").alias("qt"), F.col("var_w").alias("theta_li"), *(F.col("cov_qt_w").alias(c) for c in ("q_liq", "q_ice", "pred_q_liq")), F.lit(None).cast("double").alias("pred_q_ice")))
    assert {(r["x"], r["target"]) for r in views.select("x", "target").distinct().collect()} == {(x, t) for x in ("qt", "theta_li") for t in ("q_liq", "pred_q_liq", "q_ice")}


def test_paths_of_cases(spark, tmp_path):
    from gridmoments.sources import library

    folder = library.case_folder("/data", 10, month=1)
    assert library.fields_folder(folder) == "/data/01/HadGEM2-A/amip/Output.cfsite10_HadGEM2-A_amip_2004-2008.01.4x/fields/432000"
    combined = library.combined_file("/data", 10, month=1, time=86400)
    assert combined == "/data/01/HadGEM2-A/amip/fields_combined/Fields.cfsite10_HadGEM2-A_amip_2004-2008.01.86400.nc"
    paths = [folder, combined, library.case_folder("/data", 15, month=1), library.case_folder("/data", 10, "Other"), library.case_folder("/data", 10, month=3), library.case_folder("/data", 10, experiment="x")]
    cases = spark.createDataFrame([(p,) for p in paths], "path string").select("path", *library.parse_case_path("path"))
    told = {r["path"]: r["problem"] for r in library.valid_cases(cases).collect()}
    assert [told[p] for p in paths] == [None, None, "cfSite_number 15 is not known", "forcing_model Other is not known", "month 3 is not known", "experiment x is not known"]
    case = tmp_path / "case"
    case.mkdir()
    with pytest.raises(FileNotFoundError):
        library.stats_file(spark, str(case))
    (case / "a.txt").write_bytes(b"x")
    assert library.stats_file(spark, str(case)).endswith("/case/a.txt")
    (case / "stats").mkdir()
    (case / "stats" / "Stats.nc").write_bytes(b"x")
    (case / "stats" / "note.txt").write_bytes(b"x")
    assert library.stats_file(spark, str(case)).endswith("/case/stats/Stats.nc")
    (case / "stats" / "More.nc").write_bytes(b"x")
    with pytest.raises(ValueError, match="several"):
        library.stats_file(spark, str(case))
