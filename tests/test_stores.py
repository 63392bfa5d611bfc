"""Chunked stores: what is written is read back, and only the chunks that filters ask for."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from gridmoments.sources import chunks, grid


def voxels(spark, a):
    return spark.createDataFrame([(*map(int, at), float(v), -float(v)) for at, v in np.ndenumerate(a)], "timestep int, i int, j int, k int, hus double, wa double").repartition(3)


@pytest.mark.parametrize("codec, dims", [("zlib", "txyz"), ("gzip", "zyxt"), (None, "tzyx")])
def test_store_is_read_back(spark, tmp_path, codec, dims):
    a = np.random.default_rng(0).standard_normal((3, 5, 4, 7)).astype(np.float32)
    path = f"file://{tmp_path}/a.zarr"
    files = chunks.write_store(voxels(spark, a), path, ["hus", "wa"], dict(zip("txyz", a.shape)), {"t": 2, "x": 3, "y": 4, "z": 2}, dims, codec)
    assert files == 2 * 2 * 2 * 1 * 4
    grid.register(spark)
    df = spark.read.format("les_grid").options(path=path, kind="zarr", fields="wa,hus", month="4").load()
    got = {(r.timestep, r.i, r.j, r.k): (r.hus, r.wa, r.month) for r in df.collect()}
    assert got == {at: (v, -v, 4) for at, v in np.ndenumerate(a)}
    assert df.where("timestep > 1 and k in (0, 6)").count() == 40


def test_only_chunks_that_hold_wanted_places_are_read(spark, tmp_path, monkeypatch):
    a = np.arange(4 * 2 * 2 * 40, dtype=np.float32).reshape(4, 2, 2, 40)
    path = str(tmp_path / "b.zarr")
    chunks.write_store(voxels(spark, a), path, ["hus"], dict(zip("txyz", a.shape)), {"t": 1, "x": 2, "y": 1, "z": 5})
    read, chunk = [], chunks.ChunkedArray.chunk
    monkeypatch.setattr(chunks.ChunkedArray, "chunk", lambda self, index: (read.append(index), chunk(self, index))[1])

    def rows(*filters):
        read.clear()
        reader = grid.GridReader({"path": path, "kind": "zarr"}, ["hus"])
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    got = rows(EqualTo(("timestep",), 2), In(("k",), (1, 38, None)))
    assert {r[3] for r in got} == {1, 38} and all(r[4] == a[r[:4]] for r in got) and len(got) == 8
    assert sorted(read) == [(2, 0, y, z) for y in (0, 1) for z in (0, 7)]
    rows(GreaterThan(("timestep",), 0), LessThanOrEqual(("timestep",), 1), In(("k",), (3, 4, 5)))
    assert len(read) == 4 and {i[0] for i in read} == {1}
    assert rows(In(("k",), ())) == [] and rows(EqualTo(("timestep",), 9)) == [] and not read
    rows(EqualTo(("timestep",), None))
    assert len(read) == 4 * 2 * 8


def test_metadata_of_other_writers(tmp_path):
    root = tmp_path / "c.zarr" / "hus"
    root.mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": [2, 3, 2, 2], "chunks": [1, 2, 2, 2], "dtype": ">f8", "compressor": {"id": "gzip"}, "fill_value": 7.5, "order": "F", "filters": None, "dimension_separator": "/"}
    (tmp_path / "c.zarr" / ".zmetadata").write_text(json.dumps({"metadata": {"hus/.zarray": meta, "hus/.zattrs": {"_ARRAY_DIMENSIONS": ["time", "z", "y", "x"]}, "time/.zarray": meta | {"shape": [2], "chunks": [2]}}}))
    block = np.arange(8.0).reshape(1, 2, 2, 2)
    (root / "1/0/0").mkdir(parents=True)
    (root / "1/0/0/0").write_bytes(gzip.compress(block.astype(">f8").tobytes(order="F")))
    store = chunks.ChunkStore(str(tmp_path / "c.zarr"))
    assert list(store.fields) == ["hus"] and store.dims == {"hus": "tzyx"} and (store.chunk, store.times) == (2, 1)
    field = store.fields["hus"]
    assert (field[1, slice(0, 2), slice(None), slice(None)] == block[0]).all() and (field[slice(0, 2), slice(2, 3), 0, 0] == 7.5).all()
    with pytest.raises(ValueError, match="blosc"):
        chunks.unpacked(b"", {"id": "blosc"})
    with pytest.raises(ValueError, match="filters"):
        chunks.ChunkedArray(None, "x", meta | {"filters": [{}]}, {})
