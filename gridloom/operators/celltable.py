"""The object table of a label mask: one row a label and block.

Groups are (block, non-spatial coordinates, label > 0); an object that crosses a
block edge is several rows.  One aggregation with map-side combine makes the
statistics, one window over the (small) groups of a block makes the ordinals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.arrayframe import ArrayFrame, ArrayMeta, block_grid
from gridloom.functions import keys

COLUMNS = """global_cell_id cell_id_str spatial_key source_block_id block_z block_y block_x tile_z tile_y tile_x
local_ordinal label centroid_z centroid_y centroid_x bbox_z_min bbox_z_max bbox_y_min bbox_y_max bbox_x_min bbox_x_max
area_or_volume touches_block_boundary""".split()


def cell_table(mask: ArrayFrame, tile=(16, 512, 512)) -> DataFrame:
    """23 columns, ids as signed 64 bits, centroids FLOAT, boxes inclusive."""
    meta = mask.meta
    if not {"Y", "X"} <= set(meta.axes):
        raise ValueError("a mask needs axes Y and X")
    bits = keys.ordinal_bits(meta.total_blocks)
    spatial = [a for a in "ZYX" if a in meta.axes]
    batch = [a.lower() for a in meta.axes if a not in "ZYX"]
    rows = mask.with_df(mask.df.where(F.col("value") > 0)).with_blocks()
    blocks = [f"b_{c}" for c in meta.columns]
    aggregates = [F.count(F.lit(1)).alias("area_or_volume")]
    for a in spatial:
        c = a.lower()
        aggregates += [F.min(f"l_{c}").alias(f"lo_{c}"), F.max(f"l_{c}").alias(f"hi_{c}"), F.sum(f"l_{c}").alias(f"sum_{c}")]
    cells = rows.groupBy(*blocks, *batch, F.col("value").alias("label")).agg(*aggregates)
    cells = cells.withColumn("source_block_id", meta.flat([F.col(b) for b in blocks]))
    rank = Window.partitionBy("source_block_id").orderBy(*batch, "label")
    cells = cells.withColumn("local_ordinal", F.row_number().over(rank).cast("long"))
    touches = F.lit(False)
    for a, size in zip("zyx", tile):
        if a.upper() in spatial:
            axis = meta.axes.index(a.upper())
            origin = meta.start_of(axis, F.col(f"b_{a}"))
            center = origin + F.col(f"sum_{a}") / F.col("area_or_volume")
            touches = touches | (F.col(f"lo_{a}") == 0) | (F.col(f"hi_{a}") == meta.length_of(axis, F.col(f"b_{a}")) - 1)
            cells = cells.withColumns({f"block_{a}": F.col(f"b_{a}"), f"bbox_{a}_min": origin + F.col(f"lo_{a}"), f"bbox_{a}_max": origin + F.col(f"hi_{a}"), f"c64_{a}": center.cast("double")})
        else:
            zero = F.lit(0).cast("long")
            cells = cells.withColumns({f"block_{a}": zero, f"bbox_{a}_min": zero, f"bbox_{a}_max": zero, f"c64_{a}": F.lit(0.0)})
        cells = cells.withColumn(f"tile_{a}", F.floor(F.floor(F.col(f"c64_{a}")) / size).cast("long")).withColumn(f"centroid_{a}", F.col(f"c64_{a}").cast("float"))
    prefix, other = keys.block_prefix(meta), keys.nonspatial_prefix(meta)
    name = F.concat(prefix, F.format_string("%06d", F.col("label").cast("long")))
    cells = cells.withColumns(
        {
            "touches_block_boundary": touches,
            "spatial_key": keys.spatial_key(F.col("tile_z"), F.col("tile_y"), F.col("tile_x")),
            "cell_id_str": F.concat(other, F.lit("_"), name) if other is not None else name,
        }
    )
    cells = cells.withColumn("global_cell_id", keys.global_id(F.col("spatial_key"), keys.local_id(F.col("source_block_id"), F.col("local_ordinal"), bits)))
    return cells.select(*COLUMNS)


def fragment_path(meta: ArrayMeta):
    """Path of a block's fragment, from b_<axis> columns."""
    at = {a: F.format_string("%04d", F.col(f"b_{a}")) if a.upper() in meta.axes else F.lit("0000") for a in "zyx"}
    other = keys.nonspatial_prefix(meta)
    stem = F.concat(keys.block_prefix(meta), F.lit("cell.parquet"))
    stem = F.concat(other, F.lit("_"), stem) if other is not None else stem
    return F.concat(F.lit("fragments/block_z="), at["z"], F.lit("/block_y="), at["y"], F.lit("/block_x="), at["x"], F.lit("/"), stem)


def fragment_stats(mask: ArrayFrame, tile=(16, 512, 512)) -> DataFrame:
    """One row a block, empty blocks too: path, row_count, key min and max."""
    cells = cell_table(mask, tile)
    held = cells.groupBy(F.col("source_block_id").alias("flat")).agg(F.count(F.lit(1)).alias("n"), F.min("spatial_key").alias("spatial_key_min"), F.max("spatial_key").alias("spatial_key_max"))
    grid = block_grid(cells.sparkSession, mask.meta).withColumn("fragment_path", fragment_path(mask.meta))
    return grid.join(held, "flat", "left").select(F.col("flat").alias("source_block_id"), "fragment_path", F.coalesce("n", F.lit(0)).cast("long").alias("row_count"), "spatial_key_min", "spatial_key_max")
