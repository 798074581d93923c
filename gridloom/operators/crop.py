"""Crop: a range filter on the last axes, positions re-based to 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.arrayframe import ArrayFrame


def check_range(name: str, start: int, end: int, extent: int) -> tuple[int, int]:
    """The half-open range; end 0 stands for the extent."""
    if start < 0:
        raise ValueError(f"{name}: start {start} is negative")
    if end < 0:
        raise ValueError(f"{name}: end {end} is negative")
    end = end or extent
    if start >= extent:
        raise ValueError(f"{name}: start {start} is outside the extent {extent}")
    if end > extent:
        raise ValueError(f"{name}: end {end} is beyond the extent {extent}")
    if start >= end:
        raise ValueError(f"{name}: start {start} is not before end {end}")
    return start, end


def _clip_chunks(sizes: tuple[int, ...], start: int, end: int) -> tuple[int, ...]:
    out, at = [], 0
    for c in sizes:
        kept = min(end, at + c) - max(start, at)
        if kept > 0:
            out.append(kept)
        at += c
    return tuple(out)


def crop(frame: ArrayFrame, x=(0, 0), y=(0, 0), z=(0, 0)) -> ArrayFrame:
    """Crop X (last axis), Y and, from three dimensions on, Z; others stay whole.

    The scan is asked for the ranges only; what it gives beyond them is filtered.
    """
    meta, ndim = frame.meta, len(frame.meta.shape)
    if not 2 <= ndim <= 5:
        raise ValueError(f"crop takes 2 to 5 dimensions, not {ndim}")
    ranges = [(0, n) for n in meta.shape]
    for back, name, (start, end) in ((1, "X", x), (2, "Y", y), (3, "Z", z)):
        if back < 3 or ndim > 2:
            ranges[ndim - back] = check_range(name, start, end, meta.shape[ndim - back])
    inside = frame.within(ranges)

    def rebased(df):
        for c, (start, _) in zip(meta.columns, ranges):
            if start:
                df = df.withColumn(c, F.col(c) - start)
        return df

    shape = tuple(end - start for start, end in ranges)
    chunks = tuple(_clip_chunks(sizes, *span) for sizes, span in zip(meta.chunks, ranges))
    load = lambda more: rebased(inside.load([(a + start, b + start) for (a, b), (start, _) in zip(more, ranges)]))
    return frame.with_df(rebased(inside.df), load, shape=shape, chunks=chunks)
