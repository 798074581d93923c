"""Driver queries of the array engine and the same in DuckDB SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.arrayframe import ArrayFrame, ArrayMeta, block_grid, block_to_long, from_vectors, long_to_block
from gridloom.operators import align, blocks, crop, rechunk, segment
from gridloom.operators.cast import cast, cast_column
from gridloom.operators.celltable import COLUMNS, cell_table, fragment_stats
from gridloom.plans import graph, resources, windows
from gridloom.sources import zarr
from gridloom.streaming import events

QUERIES: dict = {}
ORACLE_SQL: dict = {}
WIDTH = 64


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, removed when the driver exits; one of this
    machine only where the session has none and is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, base, True)
    base = base.removeprefix("file://") if base.startswith("file:///") else base
    path = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    atexit.register(zarr.Store(path).remove)
    return path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _e2(spark, sf_dir) -> ArrayFrame:
    df = _table(spark, sf_dir, "embeddings")
    rows = (df.agg(F.max("vec_id")).collect()[0][0] or 0) + 1  # one number
    return from_vectors(df.select("vec_id", "embedding"), "vec_id", "embedding", rows, WIDTH)


def _i2(spark, sf_dir) -> ArrayFrame:
    e2 = _e2(spark, sf_dir)
    return e2.with_df(e2.df.withColumn("value", F.floor(F.col("value").cast("double") * 1000).cast("long")), dtype="int32")


def _e3(spark, sf_dir) -> ArrayFrame:
    e2 = _e2(spark, sf_dir)
    df = e2.df.select(F.col("y").alias("z"), F.expr("x div 8").alias("y"), F.expr("x % 8").alias("x"), "value")
    return ArrayFrame(df, ArrayMeta.regular((e2.meta.shape[0], 8, 8), (64, 8, 8), "ZYX", "float32"))


def _m2(spark, sf_dir) -> ArrayFrame:
    e2 = _e2(spark, sf_dir)
    label = F.when(F.col("value").cast("double") > 0.1, F.expr("1 + (y div 16) * 8 + (x div 8)")).otherwise(0)
    return e2.with_df(e2.df.withColumn("value", label.cast("long")), dtype="uint32")


E2 = "e2 AS (SELECT vec_id AS y, unnest(range(64)) AS x, unnest(embedding) AS v FROM embeddings)"
I2 = f"{E2}, i2 AS (SELECT y, x, CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT) AS value FROM e2)"
SIZE = "n AS (SELECT max(vec_id) + 1 AS n FROM embeddings)"


@query(f"WITH {E2} SELECT x, count(*) AS n, min(CAST(v AS DOUBLE)) AS lo, max(CAST(v AS DOUBLE)) AS hi FROM e2 GROUP BY x")
def array_scan_stats(spark, sf_dir):
    v = F.col("value").cast("double")
    return _e2(spark, sf_dir).df.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@query(f"WITH {E2} SELECT y - 10 AS y, x - 8 AS x, CAST(v AS DOUBLE) AS value FROM e2 WHERE y >= 10 AND y < 300 AND x >= 8 AND x < 40")
def roi_crop_2d(spark, sf_dir):
    return crop.crop(_e2(spark, sf_dir), x=(8, 40), y=(10, 300)).df.select("y", "x", F.col("value").cast("double").alias("value"))


@query(f"WITH {E2} SELECT y - 5 AS z, (x // 8) - 2 AS y, x % 8 AS x, CAST(v AS DOUBLE) AS value FROM e2 WHERE y >= 5 AND y < 400 AND x // 8 >= 2 AND x // 8 < 6")
def roi_crop_3d(spark, sf_dir):
    return crop.crop(_e3(spark, sf_dir), x=(0, 0), y=(2, 6), z=(5, 400)).df.select("z", "y", "x", F.col("value").cast("double").alias("value"))


_CAST_COLUMNS = {"l_extendedprice": "float64", "l_orderkey": "uint32"}
_CAST_TARGETS = ("uint8", "uint16", "int16")


def _cast_query(spark, sf_dir, clip):
    lines = _table(spark, sf_dir, "lineitem")
    sums = [F.sum(cast_column(F.col(c), d, t, clip).cast("long")).alias(f"{c}_{t}") for c, d in _CAST_COLUMNS.items() for t in _CAST_TARGETS]
    return lines.groupBy("l_returnflag").agg(*sums)


def _cast_sql(clip):
    span = {"uint8": (0, 255), "uint16": (0, 65535), "int16": (-32768, 32767)}
    out = []
    for c, d in _CAST_COLUMNS.items():
        for t, (lo, hi) in span.items():
            v = f"CAST(trunc({c}) AS BIGINT)" if d == "float64" else f"CAST({c} AS BIGINT)"
            m = hi - lo + 1
            wrapped = f"((({v} - ({lo})) % {m}) + {m}) % {m} + ({lo})"
            e = f"greatest({lo}, least({hi}, {v}))" if clip else wrapped
            out.append(f"CAST(sum({e}) AS BIGINT) AS {c}_{t}")
    return f"SELECT l_returnflag, {', '.join(out)} FROM lineitem GROUP BY l_returnflag"


@query(_cast_sql(True))
def type_cast_clip(spark, sf_dir):
    return _cast_query(spark, sf_dir, True)


@query(_cast_sql(False))
def type_cast_wrap(spark, sf_dir):
    return _cast_query(spark, sf_dir, False)


@query("SELECT l_returnflag, count(*) FILTER (l_discount <> 0) AS n_true, count(*) AS n FROM lineitem GROUP BY 1")
def type_cast_bool(spark, sf_dir):
    flag = cast_column(F.col("l_discount"), "float64", "bool")
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(flag).alias("n_true"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {E2} SELECT (y // 100) * 3 + x // 24 AS flat, count(*) AS n FROM e2 GROUP BY 1")
def rechunk_explicit(spark, sf_dir):
    return rechunk.block_sizes(rechunk.rechunk(_e2(spark, sf_dir), "explicit", "100,24"))


@query(f"WITH {E2} SELECT (y // 128) * 7 + x // 10 AS flat, count(*) AS n FROM e2 GROUP BY 1")
def rechunk_axis(spark, sf_dir):
    return rechunk.block_sizes(rechunk.rechunk(_e2(spark, sf_dir), "axis_name", axis_sizes="X:10"))


@query(f"WITH {E2} SELECT (y // 100) * 3 + x // 24 AS flat, count(*) AS n FROM e2 GROUP BY 1")
def rechunk_match(spark, sf_dir):
    e2 = _e2(spark, sf_dir)
    return rechunk.block_sizes(rechunk.rechunk(e2, "match_reference", reference=rechunk.rechunk(e2, "axis_index", axis_sizes="0:100,-1:24")))


@query(f"""WITH {SIZE}, g AS (SELECT unnest(range(CAST((n + 127) // 128 * 4 AS BIGINT))) AS flat, n FROM n)
SELECT flat, flat // 4 AS b_y, flat % 4 AS b_x, flat // 4 * 128 AS o_y, least(128, n - flat // 4 * 128) AS n_y, flat % 4 * 16 AS o_x, CAST(16 AS BIGINT) AS n_x FROM g""")
def block_grid_rows(spark, sf_dir):
    return block_grid(spark, _e2(spark, sf_dir).meta)


@query(f"""WITH {I2}, z AS (SELECT y, x, value, greatest(-100, least(100, value)) AS w FROM i2)
SELECT (y // 128) * 4 + x // 16 AS flat, CAST(sum(value * w) AS BIGINT) AS dot, count(*) AS n FROM z GROUP BY 1""")
def blockwise_zip(spark, sf_dir):
    a = _i2(spark, sf_dir)
    b = a.with_df(a.df.withColumn("value", F.greatest(F.lit(-100), F.least(F.lit(100), F.col("value")))))
    both = align.zip_arrays([a, b])
    keyed = both.with_blocks().withColumn("flat", both.meta.flat([F.col("b_y"), F.col("b_x")]))
    return keyed.groupBy("flat").agg(F.sum(F.col("value") * F.col("value_1")).alias("dot"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {E2} SELECT y // 4 AS z, x // 8 AS y, x % 8 AS x, CAST(v AS DOUBLE) AS value FROM e2 WHERE y % 4 = 2")
def channel_select(spark, sf_dir):
    e3 = _e3(spark, sf_dir)
    depth = -(-e3.meta.shape[0] // 4)
    df = e3.df.select(F.expr("z % 4").alias("c"), F.expr("z div 4").alias("z"), "y", "x", F.col("value").cast("double").alias("value"))
    stacked = ArrayFrame(df, ArrayMeta.regular((4, depth, 8, 8), (1, 64, 8, 8), "CZYX", "float64"))
    return align.select_channel(stacked, 2).df


@query(f"WITH {E2} SELECT x // 8 AS x, x % 8 AS y, CAST(v AS DOUBLE) AS value FROM e2 WHERE y = 7")
def drop_axis(spark, sf_dir):
    one = crop.crop(_e3(spark, sf_dir), z=(7, 8))
    flat = align.permute(align.drop_axis(one, "Z"), "XY")
    return flat.df.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("value").cast("double").alias("value"))


# each element adds to the nine positions around it, as far as these are in the array
_NEAR = """, d AS (SELECT dy, dx FROM range(-1, 2) r(dy), range(-1, 2) c(dx)),
near AS (SELECT b.y + dy AS y, b.x + dx AS x, sum(b.value) AS total FROM {b} b, d GROUP BY ALL)
SELECT y, x, CAST(total AS BIGINT) AS value FROM i2 JOIN near USING (y, x)"""
_EDGE = """, ys AS (SELECT DISTINCT y AS p, y FROM i2 UNION ALL SELECT -1, 0 UNION ALL SELECT max(y) + 1, max(y) FROM i2),
xs AS (SELECT DISTINCT x AS p, x FROM i2 UNION ALL SELECT -1, 0 UNION ALL SELECT 64, 63),
r2 AS (SELECT ys.p AS y, xs.p AS x, i2.value FROM i2 JOIN ys USING (y) JOIN xs USING (x))"""


def _sum3(block):
    import numpy as np

    padded = np.pad(block.astype("int64"), 1)
    return sum(padded[i : i + block.shape[0], j : j + block.shape[1]] for i in range(3) for j in range(3))


@query(f"WITH {I2}{_NEAR.format(b='i2')}")
def overlap_sum_none(spark, sf_dir):
    return blocks.window_sum(_i2(spark, sf_dir), 1, "none").df


@query(f"WITH {I2}{_EDGE}{_NEAR.format(b='r2')}")
def overlap_sum_reflect(spark, sf_dir):
    return blocks.window_sum(_i2(spark, sf_dir), 1, "reflect").df


@query(f"WITH {I2}{_NEAR.format(b='i2')}")
def overlap_user_function(spark, sf_dir):
    return blocks.map_overlap(_i2(spark, sf_dir), _sum3, 1, "none").df


def _left_and_near(left, right, ctx):
    """Twice the left element and the sum of the right ones around it."""
    (y, x), (oy, ox) = ctx.inputs["right"]["origin"], ctx.origin
    near = _sum3(right)[oy - y : oy - y + left.shape[0], ox - x : ox - x + left.shape[1]]
    return left.astype("int64") * 2 + near


@query(f"""WITH {I2}, w2 AS (SELECT y, x, value % 7 AS value FROM i2), d AS (SELECT dy, dx FROM range(-1, 2) r(dy), range(-1, 2) c(dx)),
near AS (SELECT b.y + dy AS y, b.x + dx AS x, sum(b.value) AS total FROM w2 b, d GROUP BY ALL)
SELECT y, x, CAST(2 * i2.value + total AS BIGINT) AS value FROM i2 JOIN near USING (y, x)""")
def overlap_two_inputs(spark, sf_dir):
    left = _i2(spark, sf_dir)
    right = rechunk.rechunk(left.with_df(left.df.withColumn("value", F.col("value") % 7)), "explicit", "100,24")
    return blocks.map_overlap({"left": left, "right": right}, _left_and_near, dtype="int32", policy="rechunk_to_primary", depth_by_input={"right": 1}).df


@query(f"WITH {E2} SELECT y, x, CAST(18446744073709551000 + (y * 64 + x) % 600 + 1 AS VARCHAR) AS value FROM e2")
def block_function_unsigned(spark, sf_dir):
    e2 = _e2(spark, sf_dir)
    large = F.lit("18446744073709551000").cast("decimal(20,0)") + F.expr("(y * 64 + x) % 600").cast("decimal(3,0)")
    frame = e2.with_df(e2.df.withColumn("value", large.cast("decimal(20,0)")), dtype="uint64")
    made = blocks.map_blocks(frame, lambda block: block + block.dtype.type(1))
    return made.df.withColumn("value", F.col("value").cast("string"))


@query(f"WITH {I2} SELECT y // 128 AS y, x // 16 AS x, CAST(max(value) AS BIGINT) AS value FROM i2 GROUP BY ALL")
def block_function_tokens(spark, sf_dir):
    return blocks.map_blocks(_i2(spark, sf_dir), lambda block: block.max(keepdims=True), output=blocks.OutputSpec(chunks="token")).df


@query(f"WITH {I2} SELECT y, CAST(sum(value) AS BIGINT) AS value FROM i2 GROUP BY y")
def block_function_drop_axis(spark, sf_dir):
    i2 = _i2(spark, sf_dir)
    return blocks.map_blocks(i2, lambda block: block.sum(axis=1), dtype="int32", output=blocks.OutputSpec(drop_axis="X"), input_chunks={"block": "128,-1"}).df


@query(f"WITH {E2} SELECT y // 4 AS z, (x // 8) AS y, x % 8 AS x, CASE WHEN y % 4 = 3 THEN 0 ELSE 1 END::BIGINT AS c, CAST(v AS DOUBLE) AS value FROM e2 WHERE y % 4 IN (1, 3)")
def channel_pair(spark, sf_dir):
    e3 = _e3(spark, sf_dir)
    depth = -(-e3.meta.shape[0] // 4)
    df = e3.df.select(F.expr("z % 4").alias("c"), F.expr("z div 4").alias("z"), "y", "x", F.col("value").cast("double").alias("value"))
    stacked = ArrayFrame(df, ArrayMeta.regular((4, depth, 8, 8), (1, 64, 8, 8), "CZYX", "float64"))
    return align.select_channel(stacked, 3, 1).df


@query(f"WITH {E2} SELECT CAST(0 AS BIGINT) AS c, y, x, CAST(v AS DOUBLE) AS value FROM e2")
def new_axis(spark, sf_dir):
    return align.new_axis(_e2(spark, sf_dir), "C").df.withColumn("value", F.col("value").cast("double"))


@query(f"WITH {I2} SELECT y, x, value * 2 + 1 AS value FROM i2")
def block_user_function(spark, sf_dir):
    return blocks.map_blocks(_i2(spark, sf_dir), lambda block, scale: block * scale + 1, scale=2).df


@query(f"""WITH {E2}, {SIZE}, g AS (SELECT unnest(range(CAST((n + 127) // 128 * 4 AS BIGINT))) AS flat FROM n)
SELECT flat // 4 AS b_y, flat % 4 AS b_x, count(*) AS n FROM g JOIN e2
ON y BETWEEN flat // 4 * 128 - 16 AND flat // 4 * 128 + 143 AND x BETWEEN flat % 4 * 16 - 4 AND flat % 4 * 16 + 19 GROUP BY 1, 2""")
def overlap_membership(spark, sf_dir):
    rows, _, _ = blocks.halo_rows(_e2(spark, sf_dir), (16, 4), "none")
    return rows.groupBy("b_y", "b_x").agg(F.count(F.lit(1)).alias("n"))


_TABLE = f"""WITH RECURSIVE {E2}, {SIZE}, k AS (SELECT n, (n + 127) // 128 AS ny, 24 - length(bin((n + 127) // 128 * 4 - 1)) AS bits FROM n),
{{mask}}
c AS (SELECT blky, bx, label, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, sum(y - blky * 128) AS sy, sum(x - bx * 16) AS sx FROM m GROUP BY ALL),
d AS (SELECT *, blky * 4 + bx AS blk, row_number() OVER (PARTITION BY blky, bx ORDER BY label) AS ord, blky * 128 + CAST(sy AS DOUBLE) / area AS cy, bx * 16 + CAST(sx AS DOUBLE) / area AS cx FROM c),
t AS (SELECT *, CAST(floor(cy) AS BIGINT) // 64 AS ty, CAST(floor(cx) AS BIGINT) // 16 AS tx FROM d),
s AS (SELECT t.*, k.*, (ty << 15) | tx AS skey FROM t, k),
cells AS (SELECT CAST((skey << 24) | ((blk << bits) | ord) AS BIGINT) AS global_cell_id, '00' || lpad(CAST(blky AS VARCHAR), 2, '0') || lpad(CAST(bx AS VARCHAR), 2, '0') || printf('%06d', label) AS cell_id_str,
 CAST(skey AS BIGINT) AS spatial_key, CAST(blk AS BIGINT) AS source_block_id, CAST(0 AS BIGINT) AS block_z, CAST(blky AS BIGINT) AS block_y, CAST(bx AS BIGINT) AS block_x, CAST(0 AS BIGINT) AS tile_z, ty AS tile_y, tx AS tile_x,
 ord AS local_ordinal, CAST(label AS BIGINT) AS label, CAST(0 AS FLOAT) AS centroid_z, CAST(cy AS FLOAT) AS centroid_y, CAST(cx AS FLOAT) AS centroid_x,
 CAST(0 AS BIGINT) AS bbox_z_min, CAST(0 AS BIGINT) AS bbox_z_max, CAST(y0 AS BIGINT) AS bbox_y_min, CAST(y1 AS BIGINT) AS bbox_y_max, CAST(x0 AS BIGINT) AS bbox_x_min, CAST(x1 AS BIGINT) AS bbox_x_max, area AS area_or_volume,
 y0 = blky * 128 OR y1 = least(blky * 128 + 127, n - 1) OR x0 = bx * 16 OR x1 = bx * 16 + 15 AS touches_block_boundary FROM s)"""
_MASK = "m AS (SELECT y, x, y // 128 AS blky, x // 16 AS bx, 1 + (y // 16) * 8 + x // 8 AS label FROM e2 WHERE CAST(v AS DOUBLE) > 0.1),"
# labels of face-connected cells of a block, numbered by their first cell
_COMPONENTS = """f AS (SELECT y, x, y // 128 AS blky, x // 16 AS bx, y * 64 + x AS id FROM e2 WHERE CAST(v AS DOUBLE) > 0.1),
l AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON b.id = a.id + 1 AND b.y = a.y AND b.bx = a.bx UNION ALL SELECT a.id, b.id FROM f a JOIN f b ON b.id = a.id + 64 AND b.blky = a.blky),
w AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, root) AS (SELECT id, id FROM f UNION SELECT w.b, reach.root FROM reach JOIN w ON w.a = reach.id WHERE w.b > reach.root),
r AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
m AS (SELECT y, x, blky, bx, dense_rank() OVER (PARTITION BY blky, bx ORDER BY root) AS label FROM f JOIN r USING (id)),"""
_CELLS = _TABLE.format(mask=_MASK)

_TILE = (16, 64, 16)


@query(f"{_CELLS} SELECT * FROM cells")
def cell_table_rows(spark, sf_dir):
    return cell_table(_m2(spark, sf_dir), _TILE)


QUERIES["cell_table"] = QUERIES.pop("cell_table_rows")
ORACLE_SQL["cell_table"] = ORACLE_SQL.pop("cell_table_rows")


@query(f"""{_CELLS}, g AS (SELECT unnest(range(CAST(ny * 4 AS BIGINT))) AS f FROM k)
SELECT f AS source_block_id, 'fragments/block_z=0000/block_y=' || lpad(CAST(f // 4 AS VARCHAR), 4, '0') || '/block_x=' || lpad(CAST(f % 4 AS VARCHAR), 4, '0') || '/00' || lpad(CAST(f // 4 AS VARCHAR), 2, '0') || lpad(CAST(f % 4 AS VARCHAR), 2, '0') || 'cell.parquet' AS fragment_path,
count(source_block_id) AS row_count, min(spatial_key) AS spatial_key_min, max(spatial_key) AS spatial_key_max FROM g LEFT JOIN cells ON f = source_block_id GROUP BY f""")
def cell_fragments(spark, sf_dir):
    return fragment_stats(_m2(spark, sf_dir), _TILE)


@query(f"{_CELLS} SELECT source_block_id, global_cell_id, spatial_key, row_number() OVER (PARTITION BY source_block_id ORDER BY spatial_key, global_cell_id) AS rank FROM cells")
def cell_table_sorted_rank(spark, sf_dir):
    from pyspark.sql import Window

    from gridloom.functions.keys import unsigned_order

    w = Window.partitionBy("source_block_id").orderBy("spatial_key", unsigned_order(F.col("global_cell_id")))
    return cell_table(_m2(spark, sf_dir), _TILE).select("source_block_id", "global_cell_id", "spatial_key", F.row_number().over(w).cast("long").alias("rank"))


def _written(spark, sf_dir) -> str:
    """The fragments of M2, written twice: the second time finds them complete."""
    from gridloom.sources import fragments

    path = f"{_scratch(spark)}/cells"
    write = lambda: fragments.write_fragments(_m2(spark, sf_dir), path, _TILE, overwrite=False)
    write().count()
    again = write().agg(F.count_if(~F.col("skipped"))).collect()[0][0]
    if again:
        raise RuntimeError(f"{again} fragments were written again")
    return path


@query(f"{_CELLS} SELECT * FROM cells")
def fragments_read_back(spark, sf_dir):
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(_written(spark, sf_dir))
    kinds = dict(cell_table(_m2(spark, sf_dir), _TILE).dtypes)
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS])


@query(f"""{_CELLS}, g AS (SELECT unnest(range(CAST(ny * 4 AS BIGINT))) AS f FROM k)
SELECT f AS block_id, count(source_block_id) AS row_count, min(spatial_key) AS spatial_key_min, max(spatial_key) AS spatial_key_max, CAST(23 AS BIGINT) AS n_columns, 'zstd' AS compression FROM g LEFT JOIN cells ON f = source_block_id GROUP BY f""")
def fragment_sidecars(spark, sf_dir):
    schema = "block_id long, row_count long, spatial_key_min long, spatial_key_max long, schema array<array<string>>, compression string"
    side = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(_written(spark, sf_dir))
    return side.withColumn("n_columns", F.size("schema").cast("long")).drop("schema")


@query(f"{_CELLS} SELECT CAST(source_block_id AS BIGINT) AS source_block_id, CAST(count(*) AS BIGINT) AS n, true AS in_order FROM cells GROUP BY 1")
def fragment_order(spark, sf_dir):
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(_written(spark, sf_dir))
    # a fragment is one file of one row group: rows come in the order of its lines
    lines = rows.select(F.col("source_block_id").cast("long").alias("source_block_id"), F.col("spatial_key").cast("decimal(20,0)").alias("k"), F.col("global_cell_id").cast("decimal(20,0)").alias("g"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    from pyspark.sql import Window

    before = F.lag(F.struct("k", "g")).over(Window.partitionBy("f").orderBy("i"))
    ordered = lines.withColumn("ok", before.isNull() | (before < F.struct("k", "g")))
    return ordered.groupBy("source_block_id").agg(F.count(F.lit(1)).alias("n"), F.every("ok").alias("in_order"))


_FRAGMENT_AXES = f"""WITH {E2}, {SIZE},
m AS (SELECT y % 2 AS t, (y // 2) % 3 AS c, y // 6 AS y, x, 1 + x // 8 AS label, (n + 5) // 6 AS ny FROM e2, n WHERE CAST(v AS DOUBLE) > 0.1),
q AS (SELECT *, y // 32 AS blky, x // 16 AS blkx FROM m)
SELECT 't0' || t || '_c0' || c || '_00' || lpad(CAST(blky AS VARCHAR), 2, '0') || lpad(CAST(blkx AS VARCHAR), 2, '0') || printf('%06d', label) AS cell_id_str,
 CAST(((t * 3 + c) * ((any_value(ny) + 31) // 32) + blky) * 4 + blkx AS BIGINT) AS source_block_id, label, count(*) AS area_or_volume, min(y) AS bbox_y_min, max(y) AS bbox_y_max FROM q GROUP BY t, c, blky, blkx, label"""


@query(_FRAGMENT_AXES)
def cell_table_axes(spark, sf_dir):
    """Time and channel axes: their block index goes into the names."""
    e2 = _e2(spark, sf_dir)
    rows = e2.meta.shape[0]
    label = F.when(F.col("value").cast("double") > 0.1, F.expr("1 + x div 8")).otherwise(0).cast("long")
    df = e2.df.select(F.expr("y % 2").alias("t"), F.expr("(y div 2) % 3").alias("c"), F.expr("y div 6").alias("y"), "x", label.alias("value"))
    mask = ArrayFrame(df, ArrayMeta.regular((2, 3, -(-rows // 6), WIDTH), (1, 1, 32, 16), "TCYX", "uint32"))
    return cell_table(mask, _TILE).select("cell_id_str", "source_block_id", "label", "area_or_volume", "bbox_y_min", "bbox_y_max")


_WINDOWS = f"WITH {SIZE}, g AS (SELECT unnest(range(CAST((n + 99) // 100 * 3 AS BIGINT))) AS i, n FROM n)"


@query(f"{_WINDOWS} SELECT i AS index, i // 3 AS c_0, i % 3 AS c_1, i // 3 * 100 AS start_0, least(i // 3 * 100 + 100, n) AS stop_0, i % 3 * 24 AS start_1, least(i % 3 * 24 + 24, 64) AS stop_1 FROM g")
def window_grid(spark, sf_dir):
    return windows.WindowGrid(_e2(spark, sf_dir).meta.shape, (100, 24)).frame(spark)


@query(f"{_WINDOWS} SELECT i AS index, row_number() OVER (ORDER BY i) AS position, (SELECT 100.0::DOUBLE * count(*) FILTER (i % 3 = 1) / count(*) FROM g) AS progress FROM g WHERE i % 3 <> 1")
def window_pending(spark, sf_dir):
    grid = windows.WindowGrid(_e2(spark, sf_dir).meta.shape, (100, 24))
    with tempfile.TemporaryDirectory() as folder:
        bitmap = windows.Bitmap(f"{folder}/bitmap")
        bitmap.create(grid.total)
        for i in range(1, grid.total, 3):
            bitmap.mark(i)
        todo, progress = bitmap.pending(grid.total), bitmap.progress(grid.total)
    return spark.createDataFrame([(i, k + 1, progress) for k, i in enumerate(todo)], "index long, position long, progress double")


@query(f"""WITH {SIZE}, blocks AS (SELECT a * 100 AS y0, b * 24 AS x0, least(a * 100 + 100, n) AS y1, least(b * 24 + 24, 64) AS x1, n FROM n, range(CAST((n + 99) // 100 AS BIGINT)) r(a), range(3) c(b)),
touched AS (SELECT y0, x0, y1, x1, n, unnest(range(y0 // 64, (y1 + 63) // 64)) AS cy FROM blocks),
cells AS (SELECT *, unnest(range(x0 // 10, (x1 + 9) // 10)) AS cx FROM touched)
SELECT y0, x0, bool_and(y0 % 64 = 0 AND (y1 % 64 = 0 OR y1 = n) AND x0 % 10 = 0 AND (x1 % 10 = 0 OR x1 = 64)) AS aligned,
count(*) FILTER (NOT (y0 <= cy * 64 AND y1 >= least(cy * 64 + 64, n) AND x0 <= cx * 10 AND x1 >= least(cx * 10 + 10, 64))) AS partial_chunks FROM cells GROUP BY y0, x0""")
def zarr_unaligned_chunks(spark, sf_dir):
    """The blocks of E2 at 100 x 24 against storage chunks of 64 x 10."""
    meta, chunks = ArrayMeta.regular(_e2(spark, sf_dir).meta.shape, (100, 24)), (64, 10)
    shape = meta.shape

    def asked(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for oy, ox, ny, nx in pdf.itertuples(index=False):
                origin, extent = (oy, ox), (ny, nx)
                aligned = all(zarr.is_aligned(o, o + e, c, n) for o, e, c, n in zip(origin, extent, chunks, shape))
                rows.append((oy, ox, aligned, len(zarr.partial_chunks(origin, extent, chunks, shape))))
            yield pd.DataFrame(rows, columns=["y0", "x0", "aligned", "partial_chunks"])

    grid = block_grid(spark, meta).select("o_y", "o_x", "n_y", "n_x")
    return grid.mapInPandas(asked, "y0 long, x0 long, aligned boolean, partial_chunks long")


@query(f"WITH {I2} SELECT x, CAST(sum(value) AS BIGINT) AS total, count(*) AS n FROM i2 GROUP BY x")
def zarr_roundtrip(spark, sf_dir):
    path = f"{_scratch(spark)}/array.zarr"
    i2 = rechunk.rechunk(_i2(spark, sf_dir), "explicit", "100,24")
    prefix = zarr.prepare_store(path, i2.meta, "ome_zarr")
    zarr.write_blocks(long_to_block(i2), i2.meta, path, prefix).count()
    back = zarr.read_zarr_long(spark, path, sizes={"Y": 64, "X": 64})
    return back.df.groupBy("x").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


_NODES = [("read", False, "any", None), ("segment", False, "gpu", 2), ("zarr", True, "cpu", None), ("table", True, "cpu", 3), ("unused", False, "cpu", 7)]
_LINKS = [("read", "segment"), ("segment", "zarr"), ("segment", "table"), ("read", "unused")]
_GRAPH = f"""nodes(id, output, resource, workers) AS (VALUES {', '.join(f"('{a}', {b}, '{c}', CAST({'NULL' if d is None else d} AS BIGINT))" for a, b, c, d in _NODES)}),
links(source, target) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _LINKS)})"""


def _graph(spark):
    return spark.createDataFrame(_NODES, "id string, output boolean, resource string, workers long"), spark.createDataFrame(_LINKS, "source string, target string")


@query(f"""WITH RECURSIVE {_GRAPH}, up AS (SELECT id FROM nodes WHERE output AND id NOT IN (SELECT source FROM links)
UNION SELECT l.source FROM links l JOIN up ON l.target = up.id)
SELECT CASE WHEN resource = 'gpu' THEN 'gpu' ELSE 'cpu' END AS pool, CAST(sum(coalesce(workers, CASE WHEN resource = 'any' THEN 0 ELSE 1 END)) AS BIGINT) AS workers FROM nodes JOIN up USING (id) GROUP BY 1""")
def resource_plan(spark, sf_dir):
    nodes, links = _graph(spark)
    return graph.resource_totals(nodes, graph.reachable_nodes(nodes, links))


@query(f"WITH {_GRAPH} SELECT id FROM nodes WHERE output AND id NOT IN (SELECT source FROM links)")
def terminal_roots(spark, sf_dir):
    return graph.terminal_roots(*_graph(spark))


@query("SELECT i AS node, CASE WHEN i < 10 % 3 THEN 4 ELSE 3 END::BIGINT AS gpu, CASE WHEN i < 10 % 3 THEN 0 ELSE 6 END::BIGINT AS cpu FROM range(3) t(i)")
def worker_placement(spark, sf_dir):
    placed = resources.place(12, 10)
    return spark.createDataFrame([(i, g, c) for i, (c, g) in enumerate(placed)], "node long, gpu long, cpu long")


@query("SELECT user_id, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS last_type, bool_or(event_type = 'error') AS has_error FROM events GROUP BY user_id")
def event_state(spark, sf_dir):
    return events.last_state(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "error")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 100")
def event_log_tail(spark, sf_dir):
    return events.tail(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("back").cast("long").alias("back"))


@query("""WITH l AS (SELECT user_id, event_id <= lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bad FROM events)
SELECT user_id, count(*) AS n_events, CAST(coalesce(sum(CAST(bad AS INT)), 0) AS BIGINT) AS breaks FROM l GROUP BY user_id""")
def event_sequence_check(spark, sf_dir):
    return events.sequence_breaks(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id")


@query(f"WITH {E2} SELECT (y // 128) * 4 + x // 16 AS flat, count(*) FILTER (CAST(v AS DOUBLE) > 0.1) AS foreground FROM e2 GROUP BY 1")
def segment_threshold_count(spark, sf_dir):
    mask = segment.segment(_e2(spark, sf_dir), threshold=0.1)
    keyed = mask.with_blocks().withColumn("flat", mask.meta.flat([F.col("b_y"), F.col("b_x")]))
    return keyed.groupBy("flat").agg(F.count_if(F.col("value") > 0).alias("foreground"))


@query(f"{_TABLE.format(mask=_COMPONENTS)} SELECT * FROM cells")
def segment_components(spark, sf_dir):
    mask = segment.segment(_e2(spark, sf_dir), threshold=0.1)
    return cell_table(mask, _TILE).select(*COLUMNS)


@query(f"WITH {I2} SELECT y, x, CAST(greatest(-128, least(127, value)) AS BIGINT) AS value FROM i2 WHERE y >= 3 AND y < 60")
def cast_after_crop(spark, sf_dir):
    cropped = crop.crop(_i2(spark, sf_dir), y=(3, 60))
    small = cast(cropped, "int16").df
    return small.select((F.col("y") + 3).alias("y"), "x", F.greatest(F.lit(-128), F.least(F.lit(127), F.col("value"))).cast("long").alias("value"))
