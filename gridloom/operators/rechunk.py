"""Rechunk: parse the four forms of a chunk request and change the block layout."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.arrayframe import ArrayFrame, ArrayMeta


def _size(text: str) -> int:
    text = str(text).strip()
    if text.lower() == "auto":
        raise ValueError("chunk size 'auto' is not supported")
    size = int(text)
    if size == 0 or size < -1:
        raise ValueError(f"chunk size {size} must be positive or -1")
    return size


def _regular(size: int, extent: int) -> tuple[int, ...]:
    size = extent if size == -1 else size
    return tuple(min(size, extent - s) for s in range(0, extent, size)) if extent else (0,)


def explicit_chunks(request, meta: ArrayMeta) -> tuple[tuple[int, ...], ...]:
    """'64,64,-1', a list of sizes, or a nested list of sizes for each axis."""
    if isinstance(request, str):
        request = ast.literal_eval(request) if request.strip().startswith(("(", "[")) else [p for p in request.split(",") if p.strip()]
    request = list(request)
    if len(request) != len(meta.shape):
        raise ValueError(f"{len(request)} chunk sizes for {len(meta.shape)} axes")
    out = []
    for want, extent in zip(request, meta.shape):
        if isinstance(want, (list, tuple)):
            sizes = tuple(_size(c) for c in want)
            if -1 in sizes or sum(sizes) != extent:
                raise ValueError(f"chunk sizes {sizes} do not add up to {extent}")
            out.append(sizes)
        else:
            out.append(_regular(_size(want), extent))
    return tuple(out)


def axis_chunks(request: str, meta: ArrayMeta, by_name: bool) -> tuple[tuple[int, ...], ...]:
    """'Z:16,Y:512' by name or '0:16,-1:64' by index; other axes stay as they are."""
    names = [a.upper() for a in meta.axes]
    out = list(meta.chunks)
    for part in filter(None, (p.strip() for p in re.split(r",", request))):
        if part.count(":") != 1:
            raise ValueError(f"{part!r} is not axis:size")
        key, size = (s.strip() for s in part.split(":"))
        if by_name:
            if key.upper() not in names:
                raise ValueError(f"axis {key!r} is not one of {names}")
            axis = names.index(key.upper())
        else:
            axis = int(key)
            if not -len(names) <= axis < len(names):
                raise ValueError(f"axis {axis} is out of bounds")
        out[axis] = _regular(_size(size), meta.shape[axis])
    return tuple(out)


def rechunk(frame: ArrayFrame, mode: str = "explicit", chunks="", axis_sizes: str = "", reference: ArrayFrame | None = None) -> ArrayFrame:
    """The long form doesn't move: only the descriptor changes, and with it the
    block columns that later operators shuffle by."""
    meta = frame.meta
    if mode == "explicit":
        new = explicit_chunks(chunks, meta)
    elif mode in ("axis_index", "axis_name"):
        new = axis_chunks(axis_sizes, meta, mode == "axis_name")
    elif mode == "match_reference":
        if reference is None or reference.meta.shape != meta.shape:
            raise ValueError("match_reference needs a reference of the same shape")
        new = reference.meta.chunks
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return frame.with_df(frame.df, frame.load, chunks=new)


def check_strict(a: ArrayMeta, b: ArrayMeta) -> None:
    """Policy 'strict': shape, chunks and numbers of blocks must be equal."""
    for what in ("shape", "chunks", "numblocks"):
        if getattr(a, what) != getattr(b, what):
            raise ValueError(f"{what} differ: {getattr(a, what)} and {getattr(b, what)}")


def align(primary: ArrayFrame, other: ArrayFrame, policy: str = "strict") -> ArrayFrame:
    """``other`` under a chunk policy: none/relaxed, strict, rechunk_to_primary."""
    if policy in ("none", "relaxed"):
        return other
    if policy == "strict":
        check_strict(primary.meta, other.meta)
        return other
    if policy == "rechunk_to_primary":
        return rechunk(other, "match_reference", reference=primary)
    raise ValueError(f"unknown policy {policy!r}")


def block_sizes(frame: ArrayFrame) -> DataFrame:
    """flat block index and its number of elements present."""
    meta = frame.meta
    keyed = frame.with_blocks().withColumn("flat", meta.flat([F.col(f"b_{c}") for c in meta.columns]))
    return keyed.groupBy("flat").agg(F.count(F.lit(1)).alias("n"))
