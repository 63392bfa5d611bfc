"""Chunked array stores (Zarr, version 2) by their own JSON metadata, read and written chunk by chunk.

A store is a folder of arrays, each a folder with .zarray, .zattrs and one file for each chunk. Files are reached through
pyarrow's file systems, so a path may name any store that these know (file:, s3:, gs:, hdfs: ...).
"""

from __future__ import annotations

import gzip
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = {"t": "timestep", "x": "i", "y": "j", "z": "k"}
#: Level of the compression of chunks that are written.
LEVEL = 1


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, root.rstrip("/")


def read_bytes(fs: pafs.FileSystem, path: str) -> bytes | None:
    """The file's bytes, or None where there is no such file."""
    try:
        with fs.open_input_stream(path, compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return None


def write_bytes(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes beside the file and moves it there, so that a reader, or a second try, never meets half of it."""
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, path)


def packed(data: bytes, codec: str | None) -> bytes:
    return data if codec is None else zlib.compress(data, LEVEL) if codec == "zlib" else gzip.compress(data, LEVEL)


def unpacked(data: bytes, codec: dict | None) -> bytes:
    name = codec["id"] if codec else None
    if name is None:
        return data
    if name in ("zlib", "gzip"):
        return zlib.decompress(data, 47)  # either header
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"chunks are compressed with {name!r}; known are zlib, gzip and zstd")


class ChunkedArray:
    """One array of a store. Reading a slice reads the chunks that it meets, each once; a chunk without a file holds the fill value."""

    def __init__(self, fs: pafs.FileSystem, root: str, meta: dict, attributes: dict):
        if meta.get("zarr_format") != 2 or meta.get("filters"):
            raise ValueError(f"{root}: only arrays of format 2 without filters are read")
        self.fs, self.root, self.codec = fs, root, meta.get("compressor")
        self.shape, self.chunks, self.dtype = tuple(meta["shape"]), tuple(meta["chunks"]), np.dtype(meta["dtype"])
        self.order, self.separator = meta.get("order", "C"), meta.get("dimension_separator", ".")
        self.fill = np.dtype(self.dtype).type(float(meta["fill_value"])) if meta.get("fill_value") is not None else self.dtype.type(0)
        self.dims = "".join(n[0].lower() for n in attributes.get("_ARRAY_DIMENSIONS", "txyz"))

    def chunk(self, index: tuple[int, ...]) -> np.ndarray:
        data = read_bytes(self.fs, f"{self.root}/{self.separator.join(map(str, index))}")
        if data is None:
            return np.full(self.chunks, self.fill, self.dtype)
        return np.frombuffer(unpacked(data, self.codec), self.dtype).reshape(self.chunks, order=self.order)

    def __getitem__(self, cut: tuple[int | slice, ...]) -> np.ndarray:
        ranges = [range(c, c + 1) if isinstance(c, int) else range(*c.indices(n)) for c, n in zip(cut, self.shape)]
        out = np.empty([len(r) for r in ranges], self.dtype)
        for index in itertools.product(*(range(r.start // c, -(-r.stop // c)) if len(r) else range(0) for r, c in zip(ranges, self.chunks))):
            low = [max(r.start, i * c) for r, i, c in zip(ranges, index, self.chunks)]
            high = [min(r.stop, (i + 1) * c) for r, i, c in zip(ranges, index, self.chunks)]
            here = tuple(slice(a - r.start, b - r.start) for a, b, r in zip(low, high, ranges))
            there = tuple(slice(a - i * c, b - i * c) for a, b, i, c in zip(low, high, index, self.chunks))
            out[here] = self.chunk(index)[there]
        return out[tuple(0 if isinstance(c, int) else slice(None) for c in cut)]


class ChunkStore:
    """The four-dimensional arrays of a store as the grid reader takes them: fields, dims, the levels of a chunk and its time steps."""

    def __init__(self, path: str):
        fs, root = file_system(path)
        every = read_bytes(fs, f"{root}/.zmetadata")
        if every is not None:
            told = {k: v for k, v in json.loads(every)["metadata"].items()}
        else:
            names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory]
            read = {f"{n}/{k}": read_bytes(fs, f"{root}/{n}/{k}") for n in names for k in (".zarray", ".zattrs")}
            told = {k: json.loads(v) for k, v in read.items() if v is not None}
        arrays = {k.removesuffix("/.zarray"): v for k, v in told.items() if k.endswith("/.zarray")}
        self.fields = {n: ChunkedArray(fs, f"{root}/{n}", m, told.get(f"{n}/.zattrs", {})) for n, m in sorted(arrays.items()) if len(m["shape"]) == 4}
        self.dims = {n: a.dims for n, a in self.fields.items()}
        size = lambda axis: max((a.chunks[a.dims.index(axis)] for a in self.fields.values() if axis in a.dims), default=0)
        self.chunk, self.times = size("z"), size("t")


def write_store(voxels: DataFrame, path: str, fields: list[str], shape: dict[str, int], chunks: dict[str, int], dims: str = "txyz", codec: str | None = "zlib") -> int:
    """Writes fields of voxels (timestep, i, j, k) as a store and returns the number of chunk files.

    shape and chunks tell the extents by axis, t, x, y and z. The voxels of a chunk meet in one task, which writes the chunk's file
    for each field; cells without a voxel are NaN, chunks without any have no file. A second try writes the same files.
    """
    fs, root = file_system(path)
    for f in fields:
        fs.create_dir(f"{root}/{f}")
        meta = {"zarr_format": 2, "shape": [shape[a] for a in dims], "chunks": [chunks[a] for a in dims], "dtype": "<f4", "compressor": {"id": codec, "level": LEVEL} if codec else None, "fill_value": "NaN", "order": "C", "filters": None}
        write_bytes(fs, f"{root}/{f}/.zarray", json.dumps(meta).encode())
        write_bytes(fs, f"{root}/{f}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": list(dims)}).encode())
    write_bytes(fs, f"{root}/.zgroup", b'{"zarr_format": 2}')

    def write(t: pa.Table) -> pa.Table:
        fs, root = file_system(path)
        at = [t.column(AXES[a]).to_numpy() for a in dims]
        index = [int(v[0]) // chunks[a] for v, a in zip(at, dims)]
        inner = tuple(v - i * chunks[a] for v, i, a in zip(at, index, dims))
        for f in fields:
            block = np.full([chunks[a] for a in dims], np.nan, np.float32)
            block[inner] = t.column(f).to_numpy()
            write_bytes(fs, f"{root}/{f}/{'.'.join(map(str, index))}", packed(block.tobytes(), codec))
        return pa.table({"files": pa.array([len(fields)], pa.int64())})

    by = [F.floor(F.col(AXES[a]) / chunks[a]).alias(f"_{a}") for a in dims]
    done = voxels.select(*AXES.values(), *(F.col(f).cast("float").alias(f) for f in fields)).groupBy(*by).applyInArrow(write, "files long")
    return done.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
