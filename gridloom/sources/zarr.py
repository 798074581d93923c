"""Zarr v2 arrays and OME-Zarr groups: a Python data source and a writer.

Chunks are read one partition each, pruned before anything is opened when ranges
are given.  Writing shuffles by *storage chunk*, so each chunk has one writer and no
locks are needed; a chunk appears by rename.  Codecs: see codecs.py.
"""

from __future__ import annotations

import json
import uuid
from itertools import product
from math import prod
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.arrayframe import NUMPY, ArrayMeta, block_to_long, default_axes
from gridloom.sources.codecs import COMPRESSORS, codec

BLOCK_SCHEMA = "block array<int>, origin array<bigint>, extent array<int>, data binary"


def normalise_path(path: str) -> str:
    """Without quotes and outer spaces; a local path absolute, with ~ resolved."""
    text = str(path).strip().strip("'\"").strip()
    if not text or "\0" in text:
        raise ValueError("the path of a store must not be empty")
    return text.rstrip("/") if "://" in text else str(Path(text).expanduser().resolve())


class Store:
    """Bytes by key below a path or URI."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.root = normalise_path(root)
        self.fs, self.path = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def read(self, key: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.path}/{key}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def write(self, key: str, data: bytes) -> None:
        """Complete or not at all: written beside, then renamed."""
        target = f"{self.path}/{key}"
        self.fs.create_dir(target.rpartition("/")[0], recursive=True)
        beside = f"{target}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(beside) as f:
            f.write(data)
        self.fs.move(beside, target)

    def json(self, key: str) -> dict | None:
        data = self.read(key)
        return None if data is None else json.loads(data)

    def children(self) -> list[str]:
        from pyarrow import fs

        return sorted(i.base_name for i in self.fs.get_file_info(fs.FileSelector(self.path)) if i.type == fs.FileType.Directory)

    def exists(self) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self.path).type != fs.FileType.NotFound

    def is_directory(self) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self.path).type == fs.FileType.Directory

    def remove(self) -> None:
        from pyarrow import fs

        kind = self.fs.get_file_info(self.path).type
        if kind == fs.FileType.Directory:
            self.fs.delete_dir(self.path)
        elif kind == fs.FileType.File:
            self.fs.delete_file(self.path)


def resolve_array(store: Store, array_path: str = "", multiscale: int = 0, level: int = 0) -> str:
    """Key prefix of the array: the root itself, else the path asked for, else a
    dataset of the group's multiscales, else '0', else the only child array."""
    if store.read(".zarray") is not None:
        return ""
    if array_path.strip("/"):
        if store.read(f"{array_path.strip('/')}/.zarray") is None:
            raise ValueError(f"no array at {array_path!r}")
        return array_path.strip("/") + "/"
    scales = (store.json(".zattrs") or {}).get("multiscales") or []
    if scales:
        if not 0 <= multiscale < len(scales):
            raise ValueError(f"multiscale {multiscale} is outside 0..{len(scales) - 1}")
        sets = scales[multiscale].get("datasets") or []
        if not 0 <= level < len(sets):
            raise ValueError(f"level {level} is outside 0..{len(sets) - 1}")
        return sets[level]["path"].strip("/") + "/"
    arrays = [c for c in store.children() if store.read(f"{c}/.zarray") is not None]
    if "0" in arrays:
        return "0/"
    if len(arrays) == 1:
        return arrays[0] + "/"
    raise ValueError(f"cannot choose among arrays {arrays}")


def compressor(name: str) -> dict | None:
    if name not in COMPRESSORS:
        raise ValueError(f"unknown compressor {name!r}: use one of {sorted(COMPRESSORS)}")
    return COMPRESSORS[name]


class ZarrArray:
    def __init__(self, store: Store, prefix: str = ""):
        self.store, self.prefix = store, prefix
        self.header = store.json(f"{prefix}.zarray")
        if self.header is None:
            raise ValueError(f"no array at {store.root}/{prefix}")
        if self.header.get("zarr_format") != 2:
            raise ValueError("only format 2 is supported")
        if self.header.get("filters"):
            raise ValueError("filters are not supported")
        self.shape, self.chunks = tuple(self.header["shape"]), tuple(self.header["chunks"])
        self.dtype = np.dtype(self.header["dtype"])
        self.separator, self.order = self.header.get("dimension_separator", "."), self.header.get("order", "C")
        self.pack, self.unpack = codec(self.header.get("compressor"), self.dtype.itemsize)

    def key(self, at) -> str:
        return self.prefix + self.separator.join(map(str, at))

    def read_chunk(self, at) -> np.ndarray:
        """The chunk at full size; edge chunks are stored padded."""
        data = self.store.read(self.key(at))
        if data is None:
            fill = self.header.get("fill_value")
            return np.full(self.chunks, {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf, None: 0}.get(fill, fill) if not isinstance(fill, (int, float)) else fill, self.dtype)
        return np.frombuffer(self.unpack(data), self.dtype).reshape(self.chunks, order=self.order).copy()

    def write_chunk(self, at, block: np.ndarray) -> None:
        self.store.write(self.key(at), self.pack(np.asarray(block, self.dtype).tobytes(self.order)))


def target_chunks(shape, native, axes, mode="by_axes", sizes=None, keep_first=False) -> tuple[int, ...]:
    """Block size of the scan.  by_axes: X, Y, Z by parameter, C whole, T one (whole
    with ``keep_first``), another first axis whole with ``keep_first``, else native."""
    sizes = sizes or {}
    if mode == "native":
        return tuple(native)
    if mode != "by_axes":
        raise ValueError(f"unknown chunk mode {mode!r}")
    out = []
    for i, (a, n, c) in enumerate(zip(axes, shape, native)):
        if a in "XYZ":
            out.append(max(1, min(sizes.get(a, 64), n)))
        elif a == "C" or (keep_first and i == 0):
            out.append(max(1, n))
        elif a == "T":
            out.append(1)
        else:
            out.append(c or 64)
    return tuple(out)


def parse_axes(text: str, ndim: int) -> tuple[str, ...]:
    axes = tuple(a.strip().upper() for a in text.split(",") if a.strip()) if text else default_axes(ndim)
    if len(axes) != ndim:
        raise ValueError(f"{len(axes)} axes for {ndim} dimensions")
    return axes


class _Chunk(InputPartition):
    def __init__(self, at):
        self.at = at


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _array(self) -> ZarrArray:
        return ZarrArray(Store(self.options["path"]), self.options.get("prefix", ""))

    def partitions(self):
        array = self._array()
        ranges = json.loads(self.options.get("ranges", "null")) or [[0, n] for n in array.shape]
        sizes = json.loads(self.options["blocks"])
        spans = [range(a // s, -(-min(b, n) // s)) for (a, b), s, n in zip(ranges, sizes, array.shape)]
        return [_Chunk(at) for at in product(*spans)] or [_Chunk(None)]

    def read(self, partition):
        schema = pa.schema([("block", pa.list_(pa.int32())), ("origin", pa.list_(pa.int64())), ("extent", pa.list_(pa.int32())), ("data", pa.binary())])
        if partition.at is None:
            return
        array = self._array()
        sizes = json.loads(self.options["blocks"])
        origin = [k * s for k, s in zip(partition.at, sizes)]
        stop = [min(o + s, n) for o, s, n in zip(origin, sizes, array.shape)]
        block = np.empty([b - a for a, b in zip(origin, stop)], array.dtype)
        for at in product(*[range(a // c, -(-b // c)) for a, b, c in zip(origin, stop, array.chunks)]):
            lo = [max(a, k * c) for a, k, c in zip(origin, at, array.chunks)]
            hi = [min(b, (k + 1) * c) for b, k, c in zip(stop, at, array.chunks)]
            block[tuple(slice(x - a, y - a) for x, y, a in zip(lo, hi, origin))] = array.read_chunk(at)[tuple(slice(x - k * c, y - k * c) for x, y, k, c in zip(lo, hi, at, array.chunks))]
        row = [[list(partition.at)], [origin], [list(block.shape)], [block.astype(block.dtype.newbyteorder("="), copy=False).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)


class ZarrBlocks(DataSource):
    """``spark.read.format("zarr_blocks")``: one row a block, in block form."""

    @classmethod
    def name(cls):
        return "zarr_blocks"

    def schema(self):
        return BLOCK_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_zarr(spark: SparkSession, path: str, array_path="", multiscale=0, level=0, axes="", chunk_mode="by_axes", sizes=None, keep_first=False, ranges=None):
    """(block form, meta) of a Zarr array; ``ranges`` prunes blocks before the scan."""
    store = Store(path)
    if not store.is_directory():
        raise NotADirectoryError(store.root)
    prefix = resolve_array(store, array_path, multiscale, level)
    array = ZarrArray(store, prefix)
    names = parse_axes(axes, len(array.shape))
    blocks = target_chunks(array.shape, array.chunks, names, chunk_mode, sizes, keep_first)
    meta = ArrayMeta.regular(array.shape, blocks, names, array.dtype.newbyteorder("=").name)
    spark.dataSource.register(ZarrBlocks)
    options = {"path": store.root, "prefix": prefix, "blocks": json.dumps(blocks)} | ({"ranges": json.dumps(ranges)} if ranges else {})
    return spark.read.format("zarr_blocks").options(**options).load(), meta


def read_zarr_long(spark: SparkSession, path: str, **options):
    """Long form of a Zarr array; ranges asked of it later prune the scan."""
    rows, meta = read_zarr(spark, path, **options)
    return block_to_long(rows, meta, lambda ranges: read_zarr(spark, path, **options | {"ranges": ranges})[0])


def is_aligned(start: int, stop: int, chunk: int, size: int) -> bool:
    """Whether a write of [start, stop) covers whole storage chunks only."""
    return start % chunk == 0 and (stop % chunk == 0 or stop == size)


def partial_chunks(origin, extent, chunks, shape) -> list[tuple[int, ...]]:
    """Storage chunks that a region touches without covering them, in C order."""
    out = []
    for at in product(*[range(o // c, -(-(o + e) // c)) for o, e, c in zip(origin, extent, chunks)]):
        whole = all(o <= k * c and o + e >= min((k + 1) * c, n) for k, o, e, c, n in zip(at, origin, extent, chunks, shape))
        if not whole:
            out.append(at)
    return out


def voxel_sizes(text, ndim: int) -> list[float]:
    """One positive size an axis; all 1.0 where none is given."""
    given = [p for p in text.split(",") if p.strip()] if isinstance(text, str) else list(text or [])
    sizes = [float(v) for v in given] or [1.0] * ndim
    if len(sizes) != ndim:
        raise ValueError(f"{len(sizes)} voxel sizes for {ndim} axes")
    if not all(0 < v < float("inf") for v in sizes):
        raise ValueError(f"voxel sizes {sizes} must be positive and finite")
    return sizes


def prepare_store(path: str, meta: ArrayMeta, kind="array", dataset="0", compressor_name="default", overwrite=True, resume=False, voxel_size=None, metadata=True) -> str:
    """Create the store once, on the driver; returns the array's key prefix.

    Storage chunks are the first chunk of each axis.  ``resume`` changes nothing
    and checks shape, chunks and dtype instead.
    """
    if kind not in ("array", "ome_zarr"):
        raise ValueError(f"unknown kind of store {kind!r}")
    store = Store(path)
    if not store.root.endswith(".zarr"):
        raise ValueError("an output path must end with .zarr")
    prefix = "" if kind == "array" else dataset.strip("/") + "/"
    chunks = [max(1, c[0]) for c in meta.chunks]
    dtype = NUMPY[meta.dtype].newbyteorder("<").str if NUMPY[meta.dtype].itemsize > 1 else NUMPY[meta.dtype].str
    if resume:
        array = ZarrArray(store, prefix)
        for what, have, want in (("shape", array.shape, meta.shape), ("chunks", array.chunks, tuple(chunks)), ("dtype", array.dtype, np.dtype(dtype))):
            if have != want:
                raise ValueError(f"{what} of the store is {have}, not {want}")
        return prefix
    if store.exists():
        if not overwrite:
            raise FileExistsError(path)
        store.remove()
    header = {"zarr_format": 2, "shape": list(meta.shape), "chunks": chunks, "dtype": dtype, "compressor": compressor(compressor_name), "fill_value": False if meta.dtype == "bool" else 0, "order": "C", "filters": None, "dimension_separator": "."}
    dump = lambda x: json.dumps(x, sort_keys=True, allow_nan=False).encode()
    store.write(f"{prefix}.zarray", dump(header))
    size = voxel_sizes(voxel_size, len(meta.shape))
    if kind == "ome_zarr":
        store.write(".zgroup", dump({"zarr_format": 2}))
    if not metadata:
        return prefix
    if kind == "ome_zarr":
        scale = {"path": dataset.strip("/"), "coordinateTransformations": [{"type": "scale", "scale": size}]}
        axes = [{"name": a.lower()} for a in meta.axes]
        store.write(".zattrs", dump({"multiscales": [{"version": "0.4", "name": dataset.strip("/"), "datasets": [scale], "axes": axes}]}))
    else:
        store.write(".zattrs", dump({"axes": [a.lower() for a in meta.axes], "voxel_size": size}))
    return prefix


def write_blocks(blocks: DataFrame, meta: ArrayMeta, path: str, prefix: str = "") -> DataFrame:
    """Write block rows; returns one token row a storage chunk (chunk, status 1).

    Rows are cut at storage chunk borders and grouped by chunk: one writer each.
    A chunk that the rows don't cover is merged with what the store holds.
    """
    chunks, shape, dtype = [max(1, c[0]) for c in meta.chunks], meta.shape, NUMPY[meta.dtype]

    def cut(batches):
        for batch in batches:
            rows = {"chunk": [], "lo": [], "n": [], "data": []}
            for origin, extent, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                block = np.frombuffer(data, dtype).reshape(extent)
                if any(o < 0 or o + e > s for o, e, s in zip(origin, extent, shape)):
                    raise ValueError(f"block at {origin} of {extent} is outside {shape}")
                for at in product(*[range(o // c, -(-(o + e) // c)) for o, e, c in zip(origin, extent, chunks)]):
                    lo = [max(o, k * c) for o, k, c in zip(origin, at, chunks)]
                    hi = [min(o + e, (k + 1) * c) for o, e, k, c in zip(origin, extent, at, chunks)]
                    part = block[tuple(slice(a - o, b - o) for a, b, o in zip(lo, hi, origin))]
                    rows["chunk"].append(list(at))
                    rows["lo"].append([a - k * c for a, k, c in zip(lo, at, chunks)])
                    rows["n"].append(list(part.shape))
                    rows["data"].append(part.tobytes())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(rows["chunk"], ints), pa.array(rows["lo"], ints), pa.array(rows["n"], ints), pa.array(rows["data"], pa.binary())], names=list(rows))

    def put(key, pdf):
        import pandas as pd

        array = ZarrArray(Store(path), prefix)
        at = [int(v) for v in pdf["chunk"].iloc[0]]
        inside = prod(min(c, n - k * c) for k, c, n in zip(at, array.chunks, array.shape))
        covered = sum(prod(int(x) for x in n) for n in pdf["n"])
        whole = np.zeros(array.chunks, array.dtype) if covered >= inside else array.read_chunk(at)
        for lo, n, data in zip(pdf["lo"], pdf["n"], pdf["data"]):
            whole[tuple(slice(a, a + m) for a, m in zip(lo, n))] = np.frombuffer(data, dtype).reshape(tuple(n))
        array.write_chunk(at, whole)
        return pd.DataFrame({"chunk": [at], "status": [1]})

    parts = blocks.select("block", "origin", "extent", "data").mapInArrow(cut, "chunk array<int>, lo array<int>, n array<int>, data binary")
    flat = F.aggregate(F.zip_with("chunk", F.array(*[F.lit(-(-n // c)) for n, c in zip(shape, chunks)]), lambda k, m: F.struct(k.alias("k"), m.alias("m"))), F.lit(0).cast("long"), lambda a, s: a * s["m"] + s["k"])
    return parts.withColumn("__flat", flat).groupBy("__flat").applyInPandas(put, "chunk array<int>, status int")
