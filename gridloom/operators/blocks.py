"""User functions over blocks, with and without a halo of neighbours.

The long form is grouped by block and handed to the function as dense NumPy
blocks in Arrow-backed groups; one group is one block, so memory is bounded by the
chunk size (plus halo), never by the array.
"""

from __future__ import annotations

import inspect
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.arrayframe import NUMPY, ArrayFrame, ArrayMeta, from_bits, numpy_values, spark_kind, to_bits
from gridloom.operators.rechunk import align, rechunk

_CACHE: dict = {}
_LOCK = threading.Lock()


def clear_cache(namespace: str | None = None) -> None:
    """Forget a namespace, or everything, in this process; disposes what it held."""
    with _LOCK:
        gone = [_CACHE.pop(k) for k in list(_CACHE) if namespace is None or k[0] == namespace]
    for value, dispose in gone:
        if dispose is not None:
            dispose(value)


@dataclass(frozen=True)
class BlockContext:
    """What a block function may ask for as ``ctx``.

    ``inputs``: for each input by name its dtype, and the origin and extent of the array
    it gets (with the halo).  ``resources``: what Spark gave the task, by name.
    """

    block: tuple[int, ...]
    origin: tuple[int, ...]
    extent: tuple[int, ...]
    meta: ArrayMeta
    params: dict = field(default_factory=dict)
    inputs: dict = field(default_factory=dict)

    @property
    def resources(self) -> dict[str, list[str]]:
        from pyspark import TaskContext

        task = TaskContext.get()
        return {k: list(v.addresses) for k, v in task.resources().items()} if task else {}

    @property
    def device(self) -> str:
        return "gpu" if self.resources.get("gpu") else "cpu"

    @staticmethod
    def cached(namespace: str, key, factory: Callable, dispose: Callable | None = None):
        """A value kept by the Python worker, for models and the like.

        It is made outside the lock; of two made at once the later one is disposed of.
        """
        with _LOCK:
            if (namespace, key) in _CACHE:
                return _CACHE[namespace, key][0]
        made = factory()
        with _LOCK:
            kept = _CACHE.setdefault((namespace, key), (made, dispose))[0]
        if kept is not made and dispose is not None:
            dispose(made)
        return kept

    def model(self, folder: str, name: str, factory: Callable, dispose: Callable | None = None):
        """``factory(path)`` of a model of the provider's folder, once a worker."""
        from gridloom.sources.documents import resolve_model

        return self.cached(f"model:{folder}", name, lambda: factory(str(resolve_model(folder, name))), dispose)


@dataclass(frozen=True)
class OutputSpec:
    """The shape of a block function's result, beside its dtype.

    drop_axis: an axis (name or index) of one block that the result lacks; new_axis:
    (name, place, size); chunks: 'same', or 'token' for one element a block.
    """

    drop_axis: str | int | None = None
    new_axis: tuple[str, int, int] | None = None
    chunks: str = "same"

    def meta(self, meta: ArrayMeta, dtype: str) -> ArrayMeta:
        axes, chunks = list(meta.axes), list(meta.chunks)
        if self.chunks == "token":
            chunks = [(1,) * len(c) for c in chunks]
        elif self.chunks != "same":
            raise ValueError(f"unknown chunks {self.chunks!r}")
        if self.drop_axis is not None:
            at = [a.upper() for a in axes].index(self.drop_axis.upper()) if isinstance(self.drop_axis, str) else self.drop_axis % len(axes)
            if len(chunks[at]) != 1:
                raise ValueError(f"axis {axes[at]} has {len(chunks[at])} blocks: rechunk it first")
            del axes[at], chunks[at]
        if self.new_axis is not None:
            name, at, size = self.new_axis
            axes.insert(at, name.upper())
            chunks.insert(at, (size,))
        return ArrayMeta(tuple(map(sum, chunks)), tuple(chunks), tuple(axes), dtype)

    def place(self, block: tuple, meta: ArrayMeta) -> tuple:
        """Index of the result's block."""
        out = list(block)
        if self.drop_axis is not None:
            at = [a.upper() for a in meta.axes].index(self.drop_axis.upper()) if isinstance(self.drop_axis, str) else self.drop_axis % len(out)
            del out[at]
        if self.new_axis is not None:
            out.insert(self.new_axis[1], 0)
        return tuple(out)


PRIMARY_NAMES = ("block", "arr", "array", "dask_arr", "x")


def bind(fn: Callable, arrays: dict[str, np.ndarray], params: dict, ctx: BlockContext) -> dict:
    """Arguments by name: arrays, parameters, ctx; the fallback names take the
    primary array once; ``**kwargs`` gets what is left; a missing one raises."""
    known = {**params, **arrays, "ctx": ctx}
    primary = next(iter(arrays.values()))
    out, used, rest = {}, bool(set(arrays) & set(inspect.signature(fn).parameters)), None
    for name, p in inspect.signature(fn).parameters.items():
        if p.kind is p.VAR_KEYWORD:
            rest = name
        elif name in known:
            out[name] = known[name]
        elif name in PRIMARY_NAMES and not used:
            out[name], used = primary, True
        elif p.default is p.empty:
            raise TypeError(f"block function needs {name!r}")
    if rest:
        out |= {k: v for k, v in known.items() if k not in out}
    return out


def _rows(block: np.ndarray, origin, columns) -> pd.DataFrame:
    at = np.indices(block.shape).reshape(block.ndim, -1)
    out = {c: at[i].astype(np.int64) + int(origin[i]) for i, c in enumerate(columns)}
    return pd.DataFrame(out | {"value": numpy_values(block)})


def _schema(columns, dtype: str) -> str:
    return ", ".join(f"{c} bigint" for c in columns) + f", value {spark_kind(dtype)}"


def _inputs(parts: list, dtypes: list[str], columns: list[str]):
    """Rows of all inputs in one table: whole numbers in __i (exact, uint64 by its
    bits), others in __f, the input's number in __input."""
    tagged = []
    for k, (df, dtype) in enumerate(zip(parts, dtypes)):
        real = NUMPY[dtype].kind == "f"
        value = F.col("value").cast("int") if dtype == "bool" else to_bits(F.col("value"), dtype)
        whole = F.lit(None).cast("long") if real else value.cast("long")
        tagged.append(df.select(*columns, whole.alias("__i"), F.when(F.lit(real), F.col("value").cast("double")).alias("__f"), F.lit(k).alias("__input")))
    return reduce(lambda a, b: a.unionByName(b), tagged)


def _dense(pdf: pd.DataFrame, k: int, columns: list[str], lows, extent, dtype: str) -> np.ndarray:
    """The block of input k; absent elements are 0."""
    own = pdf[pdf["__input"] == k]
    out = np.zeros(extent, NUMPY[dtype])
    spots = tuple(own[c].to_numpy() - lo for c, lo in zip(columns, lows))
    if NUMPY[dtype].kind == "f":
        out[spots] = own["__f"].to_numpy()
    else:
        values = own["__i"].to_numpy().astype(np.int64)
        out[spots] = values.view(np.uint64) if dtype == "uint64" else values
    return out


def _result(grouped, run, columns, dtype: str):
    made = grouped.applyInPandas(run, _schema(columns, dtype))
    return made.withColumn("value", from_bits(F.col("value"), dtype))


def _planned(frames: ArrayFrame | dict[str, ArrayFrame], input_chunks: dict | None) -> dict[str, ArrayFrame]:
    """The inputs by name, rechunked as the plan (input -> explicit chunks) says."""
    frames = {"block": frames} if isinstance(frames, ArrayFrame) else frames
    unknown = set(input_chunks or {}) - set(frames)
    if unknown:
        raise ValueError(f"no inputs {sorted(unknown)}")
    return {n: rechunk(f, "explicit", input_chunks[n]) if n in (input_chunks or {}) else f for n, f in frames.items()}


def map_blocks(frames: ArrayFrame | dict[str, ArrayFrame], fn: Callable, dtype: str | None = None, policy: str = "strict", output: OutputSpec | None = None, input_chunks: dict | None = None, **params) -> ArrayFrame:
    """``fn`` on aligned blocks; it returns a block of the same shape, or as ``output`` says.

    The function sees every block that has an element; absent elements are 0.
    Values keep their dtype exactly.  A range of the result asks its inputs for the
    blocks it meets only.
    """
    frames = _planned(frames, input_chunks)
    names = list(frames)
    first = frames[names[0]]
    meta, cols = first.meta, first.meta.columns
    sides = [align(first, f, policy) if i else f for i, f in enumerate(frames.values())]
    dtypes = [f.meta.dtype for f in sides]
    spec, out_dtype = output or OutputSpec(), dtype or meta.dtype
    out_meta = spec.meta(meta, out_dtype)
    starts, out_starts = ([m.starts(i) for i in range(len(m.shape))] for m in (meta, out_meta))

    def run(key, pdf):
        block = tuple(int(k) for k in key)
        origin = tuple(s[b] for s, b in zip(starts, block))
        extent = tuple(c[b] for c, b in zip(meta.chunks, block))
        arrays = {name: _dense(pdf, i, cols, origin, extent, dtypes[i]) for i, name in enumerate(names)}
        inputs = {n: {"dtype": d, "origin": origin, "extent": extent} for n, d in zip(names, dtypes)}
        made = np.asarray(fn(**bind(fn, arrays, params, BlockContext(block, origin, extent, meta, params, inputs)))).astype(NUMPY[out_dtype])
        at = spec.place(block, meta)
        want = tuple(c[b] for c, b in zip(out_meta.chunks, at))
        if made.shape != want:
            raise ValueError(f"block function returned {made.shape}, not {want}")
        return _rows(made, tuple(s[b] for s, b in zip(out_starts, at)), out_meta.columns)

    def over(parts):
        keyed = first.with_df(_inputs(parts, dtypes, cols)).with_blocks()
        return _result(keyed.groupBy(*[f"b_{c}" for c in cols]), run, out_meta.columns, out_dtype)

    def load(ranges):
        spans = [first.block_span(i, *r) for i, r in enumerate(ranges)]
        return over([f.within(spans).df for f in sides])

    return ArrayFrame(over([f.df for f in sides]), out_meta, load if output is None else None)


BOUNDARIES = ("none", "reflect", "nearest", "periodic")


def resolve_depth(depth, meta: ArrayMeta) -> list[tuple[int, int]]:
    """(before, after) for each axis from an int, a sequence or a dict by axis."""
    n = len(meta.shape)
    if isinstance(depth, dict):
        names = [a.upper() for a in meta.axes]
        each = [0] * n
        for k, v in depth.items():
            each[names.index(k.upper()) if isinstance(k, str) else k % n] = v
    elif isinstance(depth, int):
        each = [depth] * n
    else:
        each = list(depth)
    if len(each) != n:
        raise ValueError(f"{len(each)} depths for {n} axes")
    pairs = [(d, d) if isinstance(d, int) else tuple(d) for d in each]
    if any(d < 0 for p in pairs for d in p):
        raise ValueError("depth must not be negative")
    return [(min(a, s), min(b, s)) for (a, b), s in zip(pairs, meta.shape)]


def check_overlap(pairs, boundary, trim: bool, same_shape: bool = True, allow_untrimmed: bool = False) -> None:
    if not (isinstance(boundary, (int, float)) or boundary in BOUNDARIES):
        raise ValueError(f"unknown boundary {boundary!r}")
    if boundary != "none" and any(a != b for a, b in pairs):
        raise ValueError("asymmetric depth needs boundary 'none'")
    if not trim and same_shape and not allow_untrimmed:
        raise ValueError("untrimmed output has another shape")


def merge_small(meta: ArrayMeta, pairs) -> ArrayMeta:
    """Chunks smaller than the depth are merged, so that a halo reaches only the next block."""
    from dataclasses import replace

    chunks = []
    for sizes, (a, b) in zip(meta.chunks, pairs):
        least, merged = max(a, b), []
        for c in sizes:
            if merged and merged[-1] < least:
                merged[-1] += c
            else:
                merged.append(c)
        if len(merged) > 1 and merged[-1] < least:
            merged[-2:] = [sum(merged[-2:])]
        chunks.append(tuple(merged))
    return replace(meta, chunks=tuple(chunks))


def halo_rows(frame: ArrayFrame, depth, boundary="none", meta: ArrayMeta | None = None):
    """(rows, meta, pairs): each element once for every block whose halo holds it.

    Columns b_<axis> (block), v_<axis> (position, beyond the array for boundary
    elements) and value.  An element explodes to at most 2 blocks an axis away
    from it, so the shuffle grows as (1 + 2 depth / chunk) an axis.
    """
    pairs = resolve_depth(depth, frame.meta)
    check_overlap(pairs, boundary, True)
    meta = meta or merge_small(frame.meta, pairs)  # blocks at least as long as the depth
    rows = frame.df
    for i, c in enumerate(meta.columns):
        (before, after), n = pairs[i], meta.shape[i]
        v = F.col(c)
        spots = [F.array(v)]
        if boundary != "none" and (before or after):
            empty = F.array().cast("array<bigint>")
            if boundary == "reflect":
                spots += [F.when(v < before, F.array(-1 - v)).otherwise(empty), F.when(v >= n - after, F.array(2 * n - 1 - v)).otherwise(empty)]
            elif boundary == "periodic":
                spots += [F.when(v >= n - before, F.array(v - n)).otherwise(empty), F.when(v < after, F.array(v + n)).otherwise(empty)]
            else:
                spots += [F.when(v == 0, F.sequence(F.lit(-before).cast("long"), F.lit(-1).cast("long"))).otherwise(empty), F.when(v == n - 1, F.sequence(F.lit(n).cast("long"), F.lit(n + after - 1).cast("long"))).otherwise(empty)]
        rows = rows.withColumn(f"v_{c}", F.explode(F.flatten(F.array(*spots))) if len(spots) > 1 else v)
        p = F.col(f"v_{c}")
        inside = lambda q: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), q))
        first, last = meta.block_of(i, inside(p - after)), meta.block_of(i, inside(p + before))
        rows = rows.withColumn(f"b_{c}", F.explode(F.sequence(first, last)) if before or after else meta.block_of(i, p))
    if isinstance(boundary, (int, float)) and not isinstance(boundary, bool):
        outside = reduce(lambda a, b: a | b, [(F.col(f"v_{c}") < 0) | (F.col(f"v_{c}") >= n) for c, n in zip(meta.columns, meta.shape)])
        own = rows.schema["value"].dataType
        rows = rows.withColumn("value", F.when(outside, F.lit(boundary).cast(own)).otherwise(F.col("value")))
    return rows.select(*[f"b_{c}" for c in meta.columns], *[f"v_{c}" for c in meta.columns], "value"), meta, pairs


def map_overlap(frames: ArrayFrame | dict[str, ArrayFrame], fn: Callable, depth=0, boundary="none", dtype: str | None = None, policy: str = "strict", depth_by_input: dict | None = None, trim: bool = True, allow_untrimmed: bool = False, input_chunks: dict | None = None, **params) -> ArrayFrame:
    """``fn`` on blocks padded by their halo; the result is trimmed to the block.

    Several inputs are aligned by ``policy`` and may have depths of their own by name;
    chunks are merged for the deepest.  With one depth for all the function returns the
    padded shape; where depths differ, the shape of the first input's padded block.
    ``trim=False`` (with ``allow_untrimmed``) keeps the halo: the result's chunks, and
    so its shape, grow by it.
    """
    frames = _planned(frames, input_chunks)
    names = list(frames)
    first = frames[names[0]]
    sides = [align(first, f, policy) if i else f for i, f in enumerate(frames.values())]
    cols, shape = first.meta.columns, first.meta.shape
    unknown = set(depth_by_input or {}) - set(names)
    if unknown:
        raise ValueError(f"no inputs {sorted(unknown)}")
    pairs = [resolve_depth((depth_by_input or {}).get(n, depth), first.meta) for n in names]
    for p in pairs:
        check_overlap(p, boundary, trim, allow_untrimmed=allow_untrimmed)
    deepest = [(max(p[i][0] for p in pairs), max(p[i][1] for p in pairs)) for i in range(len(cols))]
    meta = merge_small(first.meta, deepest)
    out_dtype, dtypes = dtype or first.meta.dtype, [f.meta.dtype for f in sides]
    starts = [meta.starts(i) for i in range(len(cols))]
    edge = boundary == "none"

    def bounds(block, own):
        lows = [s[b] - a for s, b, (a, _) in zip(starts, block, own)]
        highs = [s[b] + c[b] + z for s, b, c, (_, z) in zip(starts, block, meta.chunks, own)]
        return ([max(0, v) for v in lows], [min(n, v) for n, v in zip(shape, highs)]) if edge else (lows, highs)

    def padded(axis, b):
        low, high = bounds([b if i == axis else 0 for i in range(len(cols))], pairs[0])
        return high[axis] - low[axis]

    grown = [tuple(padded(axis, b) for b in range(n)) for axis, n in enumerate(meta.numblocks)]
    out_meta = ArrayMeta(shape, meta.chunks, meta.axes, out_dtype) if trim else ArrayMeta(tuple(map(sum, grown)), tuple(grown), meta.axes, out_dtype)
    out_starts = [out_meta.starts(i) for i in range(len(cols))]

    def run(key, pdf):
        block = tuple(int(k) for k in key)
        origin = tuple(s[b] for s, b in zip(starts, block))
        extent = tuple(c[b] for c, b in zip(meta.chunks, block))
        arrays, inputs = {}, {}
        for i, name in enumerate(names):
            lows, highs = bounds(block, pairs[i])
            arrays[name] = _dense(pdf, i, [f"v_{c}" for c in cols], lows, [h - lo for lo, h in zip(lows, highs)], dtypes[i])
            inputs[name] = {"dtype": dtypes[i], "origin": tuple(lows), "extent": arrays[name].shape}
        want = arrays[names[0]].shape
        made = np.asarray(fn(**bind(fn, arrays, params, BlockContext(block, origin, extent, meta, params, inputs)))).astype(NUMPY[out_dtype])
        if made.shape != want:
            raise ValueError(f"halo function returned {made.shape}, not {want}")
        if not trim:
            return _rows(made, tuple(s[b] for s, b in zip(out_starts, block)), cols)
        lows, _ = bounds(block, pairs[0])
        return _rows(made[tuple(slice(o - lo, o - lo + e) for o, lo, e in zip(origin, lows, extent))], origin, cols)

    def over(parts, only=None):
        rows = []
        for i, (df, f) in enumerate(zip(parts, sides)):
            halo, _, _ = halo_rows(ArrayFrame(df, f.meta), pairs[i], boundary, meta)
            rows.append(halo)
        keys, spots = [f"b_{c}" for c in cols], [f"v_{c}" for c in cols]
        table = _inputs(rows, dtypes, [*keys, *spots])
        for c, (a, b) in zip(keys, only or []):
            table = table.where((F.col(c) >= a) & (F.col(c) < b))
        return _result(table.groupBy(*keys), run, cols, out_dtype)

    def load(ranges):
        spans, needed = [], []
        for i, ((a, b), n) in enumerate(zip(ranges, shape)):
            hit = [k for k, (s, c) in enumerate(zip(starts[i], meta.chunks[i])) if s < b and s + c > a]
            spans.append((hit[0], hit[-1] + 1) if hit else (0, 0))
            low, high = (starts[i][hit[0]], starts[i][hit[-1]] + meta.chunks[i][hit[-1]]) if hit else (0, 0)
            needed.append((0, n) if boundary == "periodic" and any(deepest[i]) else (max(0, low - deepest[i][0]), min(n, high + deepest[i][1])))
        return over([f.within(needed).df for f in sides], spans)

    return ArrayFrame(over([f.df for f in sides]), out_meta, load if trim else None)


def window_sum(frame: ArrayFrame, radius: int = 1, boundary="none") -> ArrayFrame:
    """Neighbourhood sums natively: an element adds to every position near it."""
    meta = frame.meta
    pairs = [(radius, radius)] * len(meta.shape)
    rows, meta, _ = halo_rows(ArrayFrame(frame.df, ArrayMeta(meta.shape, tuple((n,) for n in meta.shape), meta.axes, meta.dtype)), pairs, boundary)
    for c, n in zip(meta.columns, meta.shape):
        v = F.col(f"v_{c}")
        first = F.greatest(v - radius, F.lit(0).cast("long"))
        last = F.least(v + radius, F.lit(n - 1).cast("long"))
        rows = rows.withColumn(c, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return ArrayFrame(rows.groupBy(*meta.columns).agg(F.sum("value").alias("value")), frame.meta)
