"""Parquet object-table sink: one fragment and one JSON sidecar a block.

Exact unsigned schema through PyArrow, written where the group is; a fragment
appears by rename, the Parquet file before its sidecar.  A block whose fragment and
sidecar are complete is skipped, so a run can be repeated.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.arrayframe import ArrayFrame, block_grid
from gridloom.operators.celltable import COLUMNS, cell_table, fragment_path
from gridloom.sources.zarr import Store

WIDE = {"global_cell_id", "spatial_key", "source_block_id", "area_or_volume"}


def arrow_schema(label: str = "uint32") -> pa.Schema:
    kinds = {"cell_id_str": pa.string(), "touches_block_boundary": pa.bool_()}
    kinds |= {f"centroid_{a}": pa.float32() for a in "zyx"} | {c: pa.uint64() for c in WIDE}
    kinds["label"] = pa.uint64() if label == "uint64" else pa.uint32()
    return pa.schema([(c, kinds.get(c, pa.uint32())) for c in COLUMNS])


def write_fragments(mask: ArrayFrame, output_dir: str, tile=(16, 512, 512), compression="zstd", row_group_size=100_000, sidecars=True, sort=True, overwrite=True, resume=False, grid: DataFrame | None = None) -> DataFrame:
    """Write the fragments of all blocks, or of those in ``grid``.

    Returns source_block_id, path, row_count, skipped.
    """
    if mask.meta.dtype not in ("uint32", "uint64"):
        raise ValueError("a mask is uint32 or uint64")
    if compression not in ("zstd", "snappy"):
        raise ValueError(f"unknown compression {compression!r}")
    store = Store(output_dir)
    if resume and not store.exists():
        raise FileNotFoundError(output_dir)
    if overwrite and not resume:
        store.remove()
    schema = arrow_schema(mask.meta.dtype)
    grid = block_grid(mask.df.sparkSession, mask.meta) if grid is None else grid
    planned = grid.select(F.col("flat").alias("source_block_id"), fragment_path(mask.meta).alias("path"), F.array(*[F.col(f"b_{c}").cast("int") for c in mask.meta.columns]).alias("index"))
    cells = cell_table(mask, tile)
    both = planned.groupBy("source_block_id").cogroup(cells.groupBy("source_block_id"))

    def put(plan: pa.Table, rows: pa.Table) -> pa.Table:
        target = Store(output_dir)
        block, path, index = (plan[c][0].as_py() for c in ("source_block_id", "path", "index"))
        side = path.removesuffix(".parquet") + ".json"
        out = {"source_block_id": [block], "path": [path], "row_count": [rows.num_rows], "skipped": [False]}
        there = target.read(path) is not None
        old = target.json(side) if there and sidecars else None
        if there and (not sidecars or old is not None and {"fragment_path", "schema", "block_index"} <= set(old)):
            return pa.table(out | {"skipped": [True]}, schema=result)
        if there and not overwrite:
            raise FileExistsError(path)
        if sort and rows.num_rows:
            unsigned = rows["global_cell_id"].combine_chunks().cast(pa.int64()).view(pa.uint64())
            import pyarrow.compute as pc

            rows = rows.take(pc.sort_indices(pa.table({"k": rows["spatial_key"], "g": unsigned}), [("k", "ascending"), ("g", "ascending")]))
        columns = []
        for f in schema:
            c = rows[f.name].combine_chunks() if rows.num_rows else pa.array([], f.type)
            columns.append(c.view(pa.uint64()) if f.type == pa.uint64() and c.type == pa.int64() else c.cast(f.type))
        table = pa.Table.from_arrays(columns, schema=schema)
        sink = pa.BufferOutputStream()
        pq.write_table(table, sink, compression=compression, row_group_size=row_group_size)
        target.write(path, sink.getvalue().to_pybytes())
        if sidecars:
            key = rows["spatial_key"].to_pylist()
            meta = {
                "fragment_path": path,
                "row_count": rows.num_rows,
                "block_id": block,
                "block_index": index,
                "spatial_key_min": min(key, default=None),
                "spatial_key_max": max(key, default=None),
                "schema": [[f.name, str(f.type)] for f in schema],
                "compression": compression,
                "created_at": datetime.now(timezone.utc).isoformat(),
            }
            target.write(side, json.dumps(meta, sort_keys=True, allow_nan=False).encode())
        return pa.table(out, schema=result)

    result = pa.schema([("source_block_id", pa.int64()), ("path", pa.string()), ("row_count", pa.int64()), ("skipped", pa.bool_())])
    return both.applyInArrow(put, "source_block_id bigint, path string, row_count bigint, skipped boolean")
