"""Multi-input alignment, channel choice and axis changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gridloom.arrayframe import ArrayFrame, ArrayMeta
from gridloom.operators.rechunk import align


def zip_arrays(frames: list[ArrayFrame], policy: str = "strict") -> ArrayFrame:
    """Inner equi-join on position: columns value, value_1, value_2, ..."""
    first = frames[0]
    sides = [align(first, f, policy) if i else f for i, f in enumerate(frames)]
    named = [f.mapped(lambda df, i=i: df.withColumnRenamed("value", f"value_{i}")) if i else f for i, f in enumerate(sides)]
    joined = lambda parts: reduce(lambda a, b: a.join(b, first.meta.columns), parts)
    return first.with_df(joined([f.df for f in named]), lambda ranges: joined([f.within(ranges).df for f in named]))


def _axis(meta: ArrayMeta, axis: int | str) -> int:
    if isinstance(axis, str):
        names = [a.upper() for a in meta.axes]
        if axis.upper() not in names:
            raise ValueError(f"axis {axis!r} is not one of {names}")
        return names.index(axis.upper())
    if not -len(meta.shape) <= axis < len(meta.shape):
        raise ValueError(f"axis {axis} is out of bounds")
    return axis % len(meta.shape)


def select_channel(frame: ArrayFrame, channel: int, secondary: int | None = None, axis: str = "C") -> ArrayFrame:
    """One channel (its axis goes), or two, the second one stacked last."""
    at = _axis(frame.meta, axis)
    column, extent = frame.meta.columns[at], frame.meta.shape[at]
    for c in (channel, secondary):
        if c is not None and not 0 <= c < extent:
            raise ValueError(f"channel {c} is outside 0..{extent - 1}")
    if secondary is None:
        only = [(channel, channel + 1) if i == at else (0, n) for i, n in enumerate(frame.meta.shape)]
        return drop_axis(frame.within(only), at, keep_size=False)
    picked = frame.df.where(F.col(column).isin(channel, secondary))
    stacked = picked.withColumn(column, F.when(F.col(column) == channel, 0).otherwise(1).cast("long")) if channel != secondary else picked.withColumn(column, F.explode(F.array(F.lit(0), F.lit(1))).cast("long"))
    order = [i for i in range(len(frame.meta.shape)) if i != at]
    meta = frame.meta
    moved = ArrayMeta(
        tuple(meta.shape[i] for i in order) + (2,),
        tuple(meta.chunks[i] for i in order) + ((2,),),
        tuple(meta.axes[i] for i in order) + (meta.axes[at],),
        meta.dtype,
    )
    return ArrayFrame(stacked.select(*moved.columns, "value"), moved)


def drop_axis(frame: ArrayFrame, axis: int | str, keep_size: bool = True) -> ArrayFrame:
    """Remove an axis; with ``keep_size`` it must have one position only."""
    meta, at = frame.meta, _axis(frame.meta, axis)
    if keep_size and meta.shape[at] != 1:
        raise ValueError(f"axis {meta.axes[at]} has {meta.shape[at]} positions")
    cut = lambda t: t[:at] + t[at + 1 :]
    load = frame.load and (lambda ranges: frame.load([*ranges[:at], (0, meta.shape[at]), *ranges[at:]]).drop(meta.columns[at]))
    return ArrayFrame(frame.df.drop(meta.columns[at]), ArrayMeta(cut(meta.shape), cut(meta.chunks), cut(meta.axes), meta.dtype), load)


def new_axis(frame: ArrayFrame, name: str, at: int = 0) -> ArrayFrame:
    meta = frame.meta
    if name.upper() in [a.upper() for a in meta.axes]:
        raise ValueError(f"axis {name} exists")
    add = lambda t, v: t[:at] + (v,) + t[at:]
    made = ArrayMeta(add(meta.shape, 1), add(meta.chunks, (1,)), add(meta.axes, name.upper()), meta.dtype)
    add_column = lambda df: df.withColumn(name.lower(), F.lit(0).cast("long")).select(*made.columns, "value")
    return ArrayFrame(add_column(frame.df), made, frame.load and (lambda ranges: add_column(frame.load([*ranges[:at], *ranges[at + 1 :]]))))


def permute(frame: ArrayFrame, axes: str) -> ArrayFrame:
    """Axes in another order, by names."""
    order = [_axis(frame.meta, a) for a in axes]
    if sorted(order) != list(range(len(frame.meta.shape))):
        raise ValueError(f"{axes} is no order of {frame.meta.axes}")
    pick = lambda t: tuple(t[i] for i in order)
    meta = frame.meta
    made = ArrayMeta(pick(meta.shape), pick(meta.chunks), pick(meta.axes), meta.dtype)
    back = lambda ranges: [ranges[order.index(i)] for i in range(len(order))]
    return ArrayFrame(frame.df.select(*made.columns, "value"), made, frame.load and (lambda ranges: frame.load(back(ranges)).select(*made.columns, "value")))
