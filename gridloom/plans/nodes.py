"""The seven node types over ArrayFrames.

Fixed values: the names of node types and inputs, their type strings and defaults, as
saved graphs have them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from gridloom.arrayframe import ArrayFrame, ArrayMeta, block_grid, long_to_block
from gridloom.operators import align, blocks, cast, crop, rechunk, segment
from gridloom.plans.graph import Node, register_node
from gridloom.sources import fragments, zarr
from gridloom.types import ARRAY_DTYPES, parse_port

ANY = "DASK_ARRAY[any]"


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # other threads have none active


@dataclass
class Token:
    """A sink's result: one position a source block; run(window) writes those blocks."""

    meta: ArrayMeta
    write: object

    def run(self, window=None) -> None:
        self.write(window)


def _token(frame: ArrayFrame, write) -> Token:
    counts = frame.meta.numblocks
    return Token(ArrayMeta(counts, tuple((1,) * n for n in counts), frame.meta.axes, "uint8"), write)


def _of_window(frame: ArrayFrame, window) -> ArrayFrame:
    """Only the elements of the window's blocks; the scan opens no others."""
    if window is None:
        return frame
    ranges = []
    for i, (a, b) in enumerate(zip(window.starts, window.stops)):
        starts = frame.meta.starts(i)
        ranges.append((starts[a], starts[b] if b < len(starts) else frame.meta.shape[i]))
    return frame.within(ranges)


@register_node("OMEZarrReader")
class ZarrReaderNode(Node):
    INPUTS = {
        "file_path": ("STRING", {}),
        "array_path": ("STRING", {"default": "", "optional": True}),
        "multiscale_index": ("INT", {"default": 0, "optional": True}),
        "scale_level": ("INT", {"default": 0, "optional": True}),
        "axes": ("STRING", {"default": "", "optional": True}),
        "chunk_mode": (["by_axes", "native"], {"default": "by_axes"}),
        "chunk_z": ("INT", {"default": 64, "optional": True}),
        "chunk_y": ("INT", {"default": 64, "optional": True}),
        "chunk_x": ("INT", {"default": 64, "optional": True}),
        "keep_first_dim": ("BOOLEAN", {"default": False, "optional": True}),
    }
    RETURNS = (ANY,)
    CATEGORY = "source"

    def execute(self, file_path, array_path, multiscale_index, scale_level, axes, chunk_mode, chunk_z, chunk_y, chunk_x, keep_first_dim):
        sizes = {"Z": chunk_z, "Y": chunk_y, "X": chunk_x}
        return zarr.read_zarr_long(_spark(), file_path, array_path=array_path, multiscale=multiscale_index, level=scale_level, axes=axes, chunk_mode=chunk_mode, sizes=sizes, keep_first=keep_first_dim)


class _SameType(Node):
    RETURNS = (ANY,)
    CATEGORY = "array"

    def resolve_types(self, inputs, types):
        return (types.get("dask_arr", ANY),)


@register_node("DaskROI")
class CropNode(_SameType):
    INPUTS = {"dask_arr": (ANY, {})} | {f"{side}_{a}": ("INT", {"default": 0, "optional": True}) for a in "xyz" for side in ("start", "end")}

    def execute(self, dask_arr, start_x, end_x, start_y, end_y, start_z, end_z):
        return crop.crop(dask_arr, (start_x, end_x), (start_y, end_y), (start_z, end_z))


@register_node("DaskTypeCast")
class CastNode(Node):
    INPUTS = {"dask_arr": (ANY, {}), "target_dtype": (list(ARRAY_DTYPES), {"default": "float32"}), "clip": ("BOOLEAN", {"default": True, "optional": True})}
    RETURNS = (ANY,)
    CATEGORY = "array"

    def resolve_types(self, inputs, types):
        return (f"DASK_ARRAY[{inputs['target_dtype']}]",)

    def execute(self, dask_arr, target_dtype, clip):
        return cast.cast(dask_arr, target_dtype, clip)


@register_node("DaskRechunk")
class RechunkNode(_SameType):
    INPUTS = {
        "dask_arr": (ANY, {}),
        "mode": (["explicit", "axis_index", "axis_name", "match_reference"], {"default": "explicit"}),
        "chunks": ("STRING", {"default": "", "optional": True, "visible_when": {"mode": "explicit"}}),
        "axis_chunks": ("STRING", {"default": "", "optional": True, "visible_when": {"mode": ["axis_index", "axis_name"]}}),
        "reference_arr": (ANY, {"optional": True, "visible_when": {"mode": "match_reference"}}),
        "axes": ("STRING", {"default": "", "optional": True, "visible_when": {"mode": "axis_name"}}),
    }

    def execute(self, dask_arr, mode, chunks, axis_chunks, reference_arr, axes):
        dask_arr = _named(dask_arr, axes)
        return rechunk.rechunk(dask_arr, mode, chunks, axis_chunks, reference_arr)


def axes_of(ndim: int, declared: str = "", given: dict | None = None, name: str = "array", inputs: int = 1) -> tuple[str, ...]:
    """Axes of an input: by the number of dimensions, over that the node's declaration,
    over that ``axes`` (of a node with one input only), over that ``<name>_axes``."""
    given = given or {}
    text = given.get(f"{name}_axes") or (given.get("axes") if inputs == 1 else "") or ",".join(declared)
    return zarr.parse_axes(text, ndim)


def _named(frame: ArrayFrame, axes: str) -> ArrayFrame:
    """The frame with other axis names, if any are given."""
    if not axes:
        return frame
    names = axes_of(len(frame.meta.shape), given={"axes": axes})
    return frame.mapped(lambda df: df.toDF(*[c.lower() for c in names], "value"), axes=names)


@register_node("Cellpose")
class SegmentNode(Node):
    """Instance segmentation by block; the segmenter is a plug-in (see segment.py).

    It gets the parameters below whose names it asks for.  The built-in one marks what
    is above ``cellprob_threshold`` and ignores the rest.
    """

    INPUTS = {
        "image": (ANY, {}),
        "primary_channel": ("INT", {"default": 0}),
        "secondary_channel": ("INT", {"default": -1}),
        "model_name": ("STRING", {"default": ""}),
        "diameter": ("FLOAT", {"default": 0.0}),
        "flow_threshold": ("FLOAT", {"default": 0.4}),
        "cellprob_threshold": ("FLOAT", {"default": 0.0}),
        "gpu_batch_size": ("INT", {"default": 8}),
        "do_3d": (["auto", "true", "false"], {"default": "auto"}),
        "normalize": ("BOOLEAN", {"default": True}),
    }
    RETURNS = ("DASK_ARRAY[uint32]",)
    CATEGORY = "segmentation"
    segmenter = staticmethod(segment.threshold_components)

    def execute(self, image, primary_channel, secondary_channel, **params):
        frame = image
        if "C" in image.meta.axes:
            # a model sees both channels as the last axis; the built-in segmenter the first
            frame = align.select_channel(image, primary_channel)
        elif primary_channel > 0 or secondary_channel > 0:
            raise ValueError("the image has no channel axis")
        # labels number components of one position of the other axes at a time; planes
        # are segmented one by one unless three dimensions are asked for
        flat = params["do_3d"] == "false" or params["do_3d"] == "auto" and "Z" not in frame.meta.axes
        spatial = {"Y", "X"} if flat else {"Z", "Y", "X"}
        sizes = [1 if a not in spatial else None for a in frame.meta.axes]
        if any(sizes):
            parts = [tuple([1] * n) if s else c for s, n, c in zip(sizes, frame.meta.shape, frame.meta.chunks)]
            frame = frame.with_df(frame.df, frame.load, chunks=tuple(parts))
        return segment.segment(frame, type(self).segmenter, **params)


@register_node("ZarrWriter")
class ZarrWriterNode(Node):
    INPUTS = {
        "array": (ANY, {}),
        "output_path": ("STRING", {}),
        "store_kind": (["array", "ome_zarr"], {"default": "array"}),
        "dataset_path": ("STRING", {"default": "0", "optional": True}),
        "axes": ("STRING", {"default": "", "optional": True}),
        "voxel_size": ("STRING", {"default": "", "optional": True}),
        "compressor_name": (["default", "zstd", "zlib", "blosc", "lz4", "none"], {"default": "default"}),
        "overwrite": ("BOOLEAN", {"default": True, "optional": True}),
        "write_metadata": ("BOOLEAN", {"default": True, "optional": True}),
    }
    RETURNS = ("DASK_ARRAY[uint8]",)
    OUTPUT, OUTPUT_PATH_INPUT, CATEGORY = True, "output_path", "sink"

    def preprocess(self, array, output_path, store_kind, dataset_path, axes, voxel_size, compressor_name, overwrite, write_metadata):
        meta = _named(array, axes).meta
        zarr.prepare_store(output_path, meta, store_kind, dataset_path, compressor_name, overwrite, voxel_size=voxel_size, metadata=write_metadata)

    def validate(self, output_path, store_kind, dataset_path, array, axes, **_):
        """On resume: the store must be the one this node would make."""
        zarr.prepare_store(output_path, _named(array, axes).meta, store_kind, dataset_path, resume=True)

    def execute(self, array, output_path, store_kind, dataset_path, axes, **_):
        array = _named(array, axes)
        prefix = "" if store_kind == "array" else dataset_path.strip("/") + "/"

        def write(window):
            rows = long_to_block(_of_window(array, window))
            if window is not None:
                for i, (a, b) in enumerate(zip(window.starts, window.stops)):
                    rows = rows.where((rows["block"][i] >= a) & (rows["block"][i] < b))
            zarr.write_blocks(rows, array.meta, output_path, prefix).count()

        return _token(array, write)


@register_node("WriteParquetCellTable")
class CellTableNode(Node):
    INPUTS = {
        "mask": (ANY, {}),
        "output_dir": ("STRING", {}),
        "axes": ("STRING", {"default": "", "optional": True}),
        "tile_z": ("INT", {"default": 16, "optional": True}),
        "tile_y": ("INT", {"default": 512, "optional": True}),
        "tile_x": ("INT", {"default": 512, "optional": True}),
        "compression": (["zstd", "snappy"], {"default": "zstd"}),
        "row_group_size": ("INT", {"default": 100000, "optional": True}),
        "overwrite": ("BOOLEAN", {"default": True, "optional": True}),
        "write_block_metadata": ("BOOLEAN", {"default": True, "optional": True}),
        "sort_by_spatial_key": ("BOOLEAN", {"default": True, "optional": True}),
    }
    RETURNS = ("DASK_ARRAY[uint8]",)
    OUTPUT, OUTPUT_PATH_INPUT, CATEGORY = True, "output_dir", "sink"

    def preprocess(self, output_dir, overwrite, **_):
        store = zarr.Store(output_dir)
        if store.exists() and not overwrite:
            raise FileExistsError(output_dir)
        store.remove()

    def execute(self, mask, output_dir, axes, tile_z, tile_y, tile_x, compression, row_group_size, overwrite, write_block_metadata, sort_by_spatial_key):
        mask = _named(mask, axes)

        def write(window):
            blocks_ = None
            if window is not None:
                grid = block_grid(mask.df.sparkSession, mask.meta)
                for c, a, b in zip(mask.meta.columns, window.starts, window.stops):
                    grid = grid.where((grid[f"b_{c}"] >= a) & (grid[f"b_{c}"] < b))
                blocks_ = grid
            fragments.write_fragments(_of_window(mask, window), output_dir, (tile_z, tile_y, tile_x), compression, row_group_size, write_block_metadata, sort_by_spatial_key, overwrite=False, grid=blocks_).count()

        return _token(mask, write)


__all__ = ["Token", "blocks", "parse_port"]
