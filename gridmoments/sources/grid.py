"""A data source of chunked grid stores: each field an array of (t, x, y, z), read by time step and chunk of levels.

The store is any Python object that `opener(path)` returns with `fields` (name -> array-like of four dimensions, of which
a slice is read alone), `dims` (name -> the order of its axes), `chunk` (levels) and, where chunks span several time steps,
`times`. Zarr stores (see chunks.py), folders of .npy files and .npz archives are built in; NetCDF-4 files need the library
that reads them.
"""

from __future__ import annotations

import importlib
import json
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..schema import METADATA
from .chunks import ChunkStore

ORDER = "txyz"


class Member:
    """A field of an archive; its shape comes from its header, its data are read when first asked for."""

    def __init__(self, path: str, name: str):
        self.path, self.name, self.data = path, name, None
        with zipfile.ZipFile(path) as z, z.open(f"{name}.npy") as f:
            np.lib.format.read_magic(f)
            self.shape = np.lib.format.read_array_header_1_0(f)[0]

    def __getitem__(self, cut):
        if self.data is None:
            with np.load(self.path, allow_pickle=False) as f:
                self.data = f[self.name]
        return self.data[cut]


class NpzStore:
    """Fields of a .npz file; an entry `dims` (such as 'zyxt') tells the axes' order, `chunk` the levels of a chunk."""

    def __init__(self, path: str):
        with np.load(path, allow_pickle=False) as f:
            names = [k for k in f.files if k not in ("dims", "dz", "chunk")]
            order = str(f["dims"]) if "dims" in f.files else ORDER
            self.chunk = int(f["chunk"]) if "chunk" in f.files else 0
        self.fields = {k: Member(path, k) for k in names}
        self.dims = dict.fromkeys(names, order)


class NpyStore:
    """A folder of <field>.npy, mapped into memory so that only the slabs asked for are read, and <field>.json with dims and chunk."""

    def __init__(self, path: str):
        root = Path(path)
        self.fields = {f.stem: np.load(f, mmap_mode="r", allow_pickle=False) for f in sorted(root.glob("*.npy"))}
        told = {k: json.loads((root / f"{k}.json").read_text()) for k in self.fields}
        self.dims = {k: t["dims"] for k, t in told.items()}
        self.chunk = max((t["chunk"] for t in told.values()), default=0)


def save(path: str, name: str, field: np.ndarray, dims: str = ORDER, chunk: int = 0) -> None:
    """Adds a field to a folder that NpyStore reads."""
    Path(path).mkdir(parents=True, exist_ok=True)
    np.save(Path(path) / f"{name}.npy", field)
    (Path(path) / f"{name}.json").write_text(json.dumps({"dims": dims, "chunk": chunk}))


def _store(fields: dict, names: Callable[[object], list[str]], chunks: Callable[[object], list[int] | None]) -> SimpleNamespace:
    dims = {k: "".join(n[0].lower() for n in names(v)) for k, v in fields.items()}
    levels = [c[dims[k].index("z")] for k, v in fields.items() if (c := chunks(v))]
    return SimpleNamespace(fields=fields, dims=dims, chunk=max(levels, default=0))


def netcdf_store(path: str) -> SimpleNamespace:
    """The four-dimensional variables of a NetCDF file, if that library is there; axes are known by their names' first letters."""
    found = importlib.import_module("netCDF4").Dataset(path, "r").variables
    return _store({k: v for k, v in found.items() if len(v.shape) == 4}, lambda v: v.dimensions, lambda v: None if v.chunking() == "contiguous" else v.chunking())


OPENERS = {"npz": NpzStore, "npy": NpyStore, "zarr": ChunkStore, "netcdf": netcdf_store}


def axes(dims: str) -> tuple[int, ...]:
    """The permutation from the stored axes to t, x, y, z."""
    if sorted(dims) != sorted(ORDER):
        raise ValueError(f"axes {dims!r} are not t, x, y and z")
    return tuple(dims.index(a) for a in ORDER)


def scatter(blocks: list[tuple[tuple[int, int, int], np.ndarray]], shape: tuple[int, int, int]) -> np.ndarray:
    """A field from the ranks' blocks, each stored with the level fastest, at their 0-based offsets."""
    out = np.full(shape, np.nan, np.float32)
    for (a, b, c), block in blocks:
        x, y, z = block.shape
        out[a : a + x, b : b + y, c : c + z] = block
    return out


def level_chunks(nz: int, chunk: int, levels: range) -> list[tuple[int, int]]:
    """Parts of the levels by storage chunk, so that none is read twice."""
    return [(p.start, p.stop) for p in chunk_parts(nz, chunk, Wanted(levels.start, levels.stop))]


class Wanted:
    """The whole numbers that filters leave of an axis: a half-open range, and a set if one is told."""

    def __init__(self, low: int = 0, high: int | None = None, only: frozenset[int] | None = None):
        self.low, self.high, self.only = low, high, only

    def narrowed(self, f: Filter) -> Wanted:
        """What a filter leaves; one that tells nothing leaves all."""
        if isinstance(f, In):
            told = frozenset(v for v in f.value if v is not None)
            return Wanted(self.low, self.high, told if self.only is None else self.only & told)
        if getattr(f, "value", None) is None:
            return self
        if isinstance(f, EqualTo):
            return self.narrowed(In(f.attribute, (f.value,)))
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return Wanted(max(self.low, f.value + isinstance(f, GreaterThan)), self.high, self.only)
        if isinstance(f, (LessThan, LessThanOrEqual)):
            most = f.value + isinstance(f, LessThanOrEqual)
            return Wanted(self.low, most if self.high is None else min(self.high, most), self.only)
        return self

    def of(self, some: range) -> list[int]:
        inside = range(max(self.low, some.start), some.stop if self.high is None else min(self.high, some.stop))
        return [v for v in inside if self.only is None or v in self.only]


def chunk_parts(n: int, chunk: int, wanted: Wanted) -> list[range]:
    """Of each storage chunk that holds wanted places the range from the first to the last of them."""
    size = chunk or n
    held = (wanted.of(range(a, min(a + size, n))) for a in range(0, n, max(size, 1)))
    return [range(v[0], v[-1] + 1) for v in held if v]


@dataclass
class Slab(InputPartition):
    """Time steps and levels of one chunk group."""

    times: range
    levels: range


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.kind = options["path"], options.get("kind", "npz")
        self.names = names
        self.told = {n: (int if isinstance(v, int) else str)(options[n.lower()]) for n, v in METADATA.items() if n.lower() in options}
        self.wanted = {"timestep": Wanted(), "k": Wanted()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Time steps and levels that filters leave narrow what is read, to chunks that hold some; all filters are still applied behind."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name in self.wanted:
                self.wanted[name] = self.wanted[name].narrowed(f)
            yield f

    def partitions(self) -> list[Slab]:
        store = OPENERS[self.kind](self.path)
        shape = self._shape(store)
        times = chunk_parts(shape[0], getattr(store, "times", 0) or 1, self.wanted["timestep"])
        levels = chunk_parts(shape[3], getattr(store, "chunk", 0), self.wanted["k"])
        return [Slab(t, k) for t in times for k in levels]

    def _shape(self, store) -> tuple[int, ...]:
        shapes = {tuple(np.array(store.fields[n].shape)[list(axes(store.dims[n]))]) for n in self.names}
        if len(shapes) != 1:
            raise ValueError(f"fields differ in shape: {shapes}")
        return shapes.pop()

    def read(self, part: Slab) -> Iterator[pa.RecordBatch]:
        store = OPENERS[self.kind](self.path)
        columns = {}
        for n in self.names:
            order = store.dims[n]
            cut = tuple({"t": slice(part.times.start, part.times.stop), "z": slice(part.levels.start, part.levels.stop)}.get(a, slice(None)) for a in order)
            columns[n] = np.asarray(store.fields[n][cut], np.float32).transpose([order.index(a) for a in ORDER])
        for m, t in enumerate(part.times):
            i, j, k = (a.ravel().astype(np.int32) for a in np.indices(next(iter(columns.values())).shape[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), t, np.int32)), pa.array(i), pa.array(j), pa.array(k + np.int32(part.levels.start)), *(pa.array(c[m].ravel()) for c in columns.values()), *(pa.array([v] * len(i)) for v in self.told.values())], ["timestep", "i", "j", "k", *columns, *self.told])


class GridSource(DataSource):
    """Options: path, kind (npz, npy, zarr or netcdf), fields (comma-separated, required), and any metadata column (month=1, experiment=amip, ...), which every row then has."""

    @classmethod
    def name(cls) -> str:
        return "les_grid"

    def schema(self) -> str:
        told = [f"{n} {'long' if isinstance(v, int) else 'string'}" for n, v in METADATA.items() if n.lower() in self.options]
        return ", ".join(["timestep int, i int, j int, k int", *(f"{n} float" for n in self._names()), *told])

    def _names(self) -> list[str]:
        return [n.strip() for n in self.options["fields"].split(",")]

    def reader(self, schema) -> GridReader:
        return GridReader({k.lower(): v for k, v in self.options.items()}, self._names())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
