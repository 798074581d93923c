"""Arrays as DataFrames: a descriptor, the long form and the block form.

Long form: one row an element, one BIGINT column an axis (lower case) and
``value``.  Block form: one row a chunk, ``block`` (index), ``origin``, ``extent``
arrays and ``data`` (C-order bytes of the element type).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_AXES = {2: "YX", 3: "ZYX", 4: "CZYX", 5: "TCZYX"}


def default_axes(ndim: int) -> tuple[str, ...]:
    return tuple(DEFAULT_AXES[ndim]) if ndim in DEFAULT_AXES else tuple(f"DIM_{i}" for i in range(ndim))


@dataclass(frozen=True)
class ArrayMeta:
    shape: tuple[int, ...]
    chunks: tuple[tuple[int, ...], ...]
    axes: tuple[str, ...]
    dtype: str

    @staticmethod
    def regular(shape, chunk, axes=None, dtype="float32") -> "ArrayMeta":
        """Chunks of the given size on each axis, the last one ragged."""
        chunks = tuple(tuple(min(c, n - s) for s in range(0, n, c)) if n else (0,) for n, c in zip(shape, chunk))
        return ArrayMeta(tuple(shape), chunks, tuple(axes or default_axes(len(shape))), dtype)

    @property
    def columns(self) -> list[str]:
        return [a.lower() for a in self.axes]

    @property
    def numblocks(self) -> tuple[int, ...]:
        return tuple(map(len, self.chunks))

    @property
    def total_blocks(self) -> int:
        return prod(self.numblocks)

    def starts(self, axis: int) -> list[int]:
        out, at = [], 0
        for c in self.chunks[axis]:
            out.append(at)
            at += c
        return out

    def is_regular(self, axis: int) -> bool:
        sizes = self.chunks[axis]
        return all(c == sizes[0] for c in sizes[:-1]) and sizes[-1] <= sizes[0]

    def block_of(self, axis: int, position: Column) -> Column:
        """Block index of a position: a division where chunks are regular."""
        if self.is_regular(axis):
            return F.floor(position / F.lit(max(1, self.chunks[axis][0]))).cast("long")
        starts = F.array(*[F.lit(s) for s in self.starts(axis)])
        return (F.size(F.filter(starts, lambda s: s <= position)) - 1).cast("long")

    def start_of(self, axis: int, block: Column) -> Column:
        if self.is_regular(axis):
            return block * F.lit(self.chunks[axis][0]).cast("long")
        return F.element_at(F.array(*[F.lit(s).cast("long") for s in self.starts(axis)]), (block + 1).cast("int"))

    def length_of(self, axis: int, block: Column) -> Column:
        if self.is_regular(axis):
            return F.least(F.lit(self.chunks[axis][0]).cast("long"), F.lit(self.shape[axis]).cast("long") - self.start_of(axis, block))
        return F.element_at(F.array(*[F.lit(c).cast("long") for c in self.chunks[axis]]), (block + 1).cast("int"))

    def flat(self, blocks: list[Column]) -> Column:
        """C-order flat index of a block."""
        return reduce(lambda acc, nb: acc * F.lit(nb[0]) + nb[1], zip(self.numblocks, blocks), F.lit(0).cast("long"))


@dataclass(frozen=True)
class ArrayFrame:
    """The long form and its descriptor.

    ``load``, where known, gives the elements of half-open ranges, one an axis, or
    more than these: it reaches back to the scan, which then opens no other chunks.
    """

    df: DataFrame
    meta: ArrayMeta
    load: Callable[[list[tuple[int, int]]], DataFrame] | None = None

    def with_df(self, df: DataFrame, load=None, **changes) -> "ArrayFrame":
        return ArrayFrame(df, replace(self.meta, **changes) if changes else self.meta, load)

    def mapped(self, change: Callable[[DataFrame], DataFrame], **changes) -> "ArrayFrame":
        """``change`` on the long form, where it leaves elements at their positions."""
        return self.with_df(change(self.df), self.load and (lambda ranges: change(self.load(ranges))), **changes)

    def within(self, ranges: list[tuple[int, int]]) -> "ArrayFrame":
        """Only the elements of the ranges; shape and chunks stay as they are."""

        def cut(ranges):
            df = self.load(ranges) if self.load else self.df
            for c, n, (a, b) in zip(self.meta.columns, self.meta.shape, ranges):
                if (a, b) != (0, n):
                    df = df.where((F.col(c) >= a) & (F.col(c) < b))
            return df

        narrower = lambda more: cut([(max(a, x), min(b, y)) for (a, b), (x, y) in zip(ranges, more)])
        return self.with_df(cut(ranges), narrower)

    def block_span(self, axis: int, start: int, stop: int) -> tuple[int, int]:
        """The positions of all blocks that [start, stop) meets."""
        at, low, high = 0, None, 0
        for c in self.meta.chunks[axis]:
            if at < stop and at + c > start:
                low, high = at if low is None else low, at + c
            at += c
        return (low or 0, high)

    def with_blocks(self) -> DataFrame:
        """Long form plus b_<axis> and l_<axis>: block index and local position."""
        meta = self.meta
        out = self.df
        for i, c in enumerate(meta.columns):
            out = out.withColumn(f"b_{c}", meta.block_of(i, F.col(c)))
        for i, c in enumerate(meta.columns):
            out = out.withColumn(f"l_{c}", F.col(c) - meta.start_of(i, F.col(f"b_{c}")))
        return out


def block_grid(spark, meta: ArrayMeta) -> DataFrame:
    """One row a block: flat, b_<axis>, o_<axis> (origin), n_<axis> (length)."""
    out = spark.range(meta.total_blocks).select(F.col("id").alias("flat"))
    step = meta.total_blocks
    for i, c in enumerate(meta.columns):
        step //= meta.numblocks[i]
        out = out.withColumn(f"b_{c}", F.expr(f"(flat div {step}) % {meta.numblocks[i]}"))
    for i, c in enumerate(meta.columns):
        out = out.withColumn(f"o_{c}", meta.start_of(i, F.col(f"b_{c}"))).withColumn(f"n_{c}", meta.length_of(i, F.col(f"b_{c}")))
    return out


NUMPY = {d: np.dtype(d) for d in ("uint8", "uint16", "uint32", "uint64", "int16", "int32", "float32", "float64", "bool")}


TOP = 1 << 64


def to_bits(value: Column, dtype: str) -> Column:
    """An exact column for the way to NumPy: uint64 as the long of the same bits."""
    if dtype != "uint64":
        return value
    wide = value.cast("decimal(20,0)")
    return F.when(wide >= F.lit(str(TOP // 2)).cast("decimal(20,0)"), (wide - F.lit(str(TOP)).cast("decimal(21,0)")).cast("long")).otherwise(F.when(wide < F.lit(str(TOP // 2)).cast("decimal(20,0)"), wide).cast("long"))


def from_bits(value: Column, dtype: str) -> Column:
    """The way back of ``to_bits``."""
    if dtype != "uint64":
        return value
    wide = value.cast("decimal(21,0)")
    return F.when(value < 0, wide + F.lit(str(TOP)).cast("decimal(21,0)")).otherwise(wide).cast("decimal(20,0)")


def spark_kind(dtype: str) -> str:
    """Type of the value column on its way from NumPy."""
    return {"f": "double", "b": "boolean"}.get(NUMPY[dtype].kind, "bigint")


def numpy_values(block: np.ndarray) -> np.ndarray:
    """The elements of a block as ``spark_kind`` has them."""
    flat = block.ravel()
    return flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype({"f": np.float64, "b": np.bool_}.get(flat.dtype.kind, np.int64))


def long_to_block(frame: ArrayFrame, fill=0) -> DataFrame:
    """Block form: absent elements (a sparse mask's background) become ``fill``.

    A block's positions and values travel as two Arrow arrays and become the block by
    one NumPy assignment.
    """
    import pyarrow as pa

    meta, cols = frame.meta, frame.meta.columns
    keyed = frame.with_blocks()
    spot = F.lit(0).cast("long")
    for i, c in enumerate(cols):
        spot = spot * meta.length_of(i, F.col(f"b_{c}")) + F.col(f"l_{c}")
    element = F.struct(spot.cast("int").alias("at"), to_bits(F.col("value"), meta.dtype).cast(spark_kind(meta.dtype)).alias("v"))
    held = keyed.groupBy(*[f"b_{c}" for c in cols]).agg(F.collect_list(element).alias("e"))
    full = block_grid(keyed.sparkSession, meta).join(held, [f"b_{c}" for c in cols], "left")
    packed = full.select(
        F.array(*[F.col(f"b_{c}").cast("int") for c in cols]).alias("block"),
        F.array(*[F.col(f"o_{c}") for c in cols]).alias("origin"),
        F.array(*[F.col(f"n_{c}").cast("int") for c in cols]).alias("extent"),
        F.col("e.at").alias("at"),
        F.col("e.v").alias("v"),
    )
    dtype = NUMPY[meta.dtype]

    def pack(batches):
        for batch in batches:
            data = []
            for i in range(batch.num_rows):
                block = np.full(prod(batch.column(2)[i].as_py()), fill, dtype)
                at, v = batch.column(3)[i].values, batch.column(4)[i].values
                if at is not None:
                    values = v.to_numpy(zero_copy_only=False)
                    block[at.to_numpy()] = values.view(np.uint64) if dtype == np.uint64 else values
                data.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(data, pa.binary())], names=["block", "origin", "extent", "data"])

    return packed.mapInArrow(pack, "block array<int>, origin array<bigint>, extent array<int>, data binary")


def block_to_long(blocks: DataFrame, meta: ArrayMeta, load=None) -> ArrayFrame:
    """Long form of block rows; ``load`` (ranges -> block rows) prunes the scan."""
    import pyarrow as pa

    dtype, cols = NUMPY[meta.dtype], meta.columns

    def unpack(batches):
        for batch in batches:
            for origin, extent, data in zip(*(batch.column(i) for i in range(3))):
                block = np.frombuffer(data.as_buffer(), dtype).reshape(tuple(extent.as_py()))
                at = np.indices(block.shape, np.int64).reshape(block.ndim, -1)
                columns = [pa.array(at[i] + o) for i, o in enumerate(origin.as_py())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(numpy_values(block))], names=[*cols, "value"])

    schema = ", ".join(f"{c} bigint" for c in cols) + f", value {spark_kind(meta.dtype)}"

    def long(rows: DataFrame) -> DataFrame:
        return rows.select("origin", "extent", "data").mapInArrow(unpack, schema).withColumn("value", from_bits(F.col("value"), meta.dtype))

    return ArrayFrame(long(blocks), meta, load and (lambda ranges: long(load(ranges))))


def from_vectors(df: DataFrame, key: str, vector: str, rows: int, width: int, chunk=(128, 16), dtype="float32") -> ArrayFrame:
    """A table of vectors as a (Y, X) array: y = key, x = position."""
    long = df.select(F.col(key).cast("long").alias("y"), F.posexplode(vector).alias("p", "value"))
    return ArrayFrame(long.select("y", F.col("p").cast("long").alias("x"), "value"), ArrayMeta.regular((rows, width), chunk, "YX", dtype))
