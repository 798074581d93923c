"""The array engine against NumPy, and its plans, stores, windows and events."""

import json
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import plan_queries, queries  # noqa: F401
from gridloom.arrayframe import ArrayFrame, ArrayMeta, block_to_long, long_to_block
from gridloom.functions import keys
from gridloom.operators import align, blocks, cast, celltable, crop, rechunk, segment
from gridloom.plans import graph, nodes, recovery, resources, windows
from gridloom.sources import documents, fragments, zarr
from gridloom.streaming import events
from gridloom.types import can_connect, coerce


def frame_of(spark, array, chunk, axes=None, dtype=None):
    meta = ArrayMeta.regular(array.shape, chunk, axes, dtype or array.dtype.name)
    at = np.indices(array.shape).reshape(array.ndim, -1)
    data = {c: at[i] for i, c in enumerate(meta.columns)} | {"value": array.ravel()}
    return ArrayFrame(spark.createDataFrame(pd.DataFrame(data)), meta)


def array_of(frame):
    out = np.zeros(frame.meta.shape)
    pdf = frame.df.toPandas()
    out[tuple(pdf[c].to_numpy() for c in frame.meta.columns)] = pdf["value"].astype(float)
    return out


@pytest.fixture(scope="module")
def tables():
    """The smallest of the given tables; the SQL runs on the same files."""
    folder = Path("/root/testdata/sf0.001")
    if not folder.is_dir():
        pytest.skip("no tables here")
    return str(folder)


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(0).integers(-50, 200, (13, 17)).astype("int32")


def test_crop(spark, image):
    got = crop.crop(frame_of(spark, image, (5, 6)), x=(2, 0), y=(3, 11))
    assert (array_of(got) == image[3:11, 2:]).all() and got.meta.chunks == ((2, 5, 1), (4, 6, 5))
    for bad in ((-1, 0), (0, -1), (5, 5), (0, 99), (17, 0)):
        with pytest.raises(ValueError):
            crop.crop(frame_of(spark, image, (5, 6)), x=bad)


@pytest.mark.parametrize("source", ["uint8", "int16", "int32", "uint32"])
def test_integer_casts(spark, source):
    low, high = cast.INTEGER_RANGES[source]
    values = np.array([low, low + 1, 0, 1, 44, 127, 200, high - 1, high], dtype=np.int64)
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "v": values}))
    for target in ("uint8", "uint16", "int16", "int32", "uint32", "uint64"):
        if target == source:
            continue
        lo, hi = cast.INTEGER_RANGES[target]
        got = df.select("i", cast.cast_column(F.col("v"), source, target, True).alias("c"), cast.cast_column(F.col("v"), source, target, False).alias("w")).orderBy("i").collect()
        assert [int(r["c"]) for r in got] == [min(max(int(v), lo), hi) for v in values]
        assert [int(r["w"]) for r in got] == [int(v) for v in values.astype(source).astype(target)]


def test_float_casts(spark):
    df = spark.createDataFrame([(0, -1.9), (1, 2.5), (2, 300.7), (3, float("nan")), (4, 1e30), (5, -1e30)], "i int, v double")
    got = [int(r[0]) for r in df.orderBy("i").select(cast.cast_column(F.col("v"), "float64", "uint8")).collect()]
    assert got == [0, 2, 255, 0, 255, 0]
    assert [int(r[0]) for r in df.orderBy("i").select(cast.cast_column(F.col("v"), "float64", "uint64")).collect()][:4] == [0, 2, 300, 0]
    assert df.select(cast.cast_column(F.col("v"), "float64", "bool").alias("b")).where("b").count() == 6
    with pytest.raises(Exception, match="no defined cast"):
        df.select(cast.cast_column(F.col("v"), "float64", "int32", clip=False)).collect()


def test_rechunk_parsing():
    meta = ArrayMeta.regular((10, 20), (4, 8))
    assert rechunk.explicit_chunks("5,-1", meta) == ((5, 5), (20,))
    assert rechunk.explicit_chunks([[3, 7], 10], meta) == ((3, 7), (10, 10))
    assert rechunk.axis_chunks("x:15", meta, True) == (meta.chunks[0], (15, 5))
    assert rechunk.axis_chunks("-2:10", meta, False) == ((10,), meta.chunks[1])
    for bad in ("auto,1", "0,1", "-2,1", "5"):
        with pytest.raises(ValueError):
            rechunk.explicit_chunks(bad, meta)
    for bad, named in (("Q:1", True), ("5:1", False), ("x", True)):
        with pytest.raises(ValueError):
            rechunk.axis_chunks(bad, meta, named)


def test_block_round_trip_and_user_function(spark, image):
    f = frame_of(spark, image, (5, 6))
    assert (array_of(block_to_long(long_to_block(f), f.meta)) == image).all()
    got = blocks.map_blocks({"a": f, "b": f}, lambda a, b, ctx, k=2: a * k + b + ctx.block[0])
    assert (array_of(got) == image * 3 + (np.arange(13) // 5)[:, None]).all()
    with pytest.raises(ValueError):
        align.zip_arrays([f, rechunk.rechunk(f, "explicit", "13,17")])


@pytest.mark.parametrize("boundary", ["none", "reflect", "nearest", "periodic", 7])
def test_halo(spark, image, boundary):
    f = frame_of(spark, image, (4, 6))

    def sum5(block):
        p = np.pad(block.astype("int64"), 2)
        return sum(p[i : i + block.shape[0], j : j + block.shape[1]] for i in range(5) for j in range(5))

    how = {"none": {"mode": "constant"}, "reflect": {"mode": "symmetric"}, "nearest": {"mode": "edge"}, "periodic": {"mode": "wrap"}}.get(boundary, {"mode": "constant", "constant_values": 7})
    p = np.pad(image.astype("int64"), 2, **how)
    want = sum(p[i : i + 13, j : j + 17] for i in range(5) for j in range(5))
    assert (array_of(blocks.map_overlap(f, sum5, 2, boundary)) == want).all()
    if boundary != 7:
        assert (array_of(blocks.window_sum(f, 2, boundary)) == want).all()


def test_halo_rules():
    meta = ArrayMeta.regular((10, 10), (3, 3))
    assert blocks.merge_small(meta, [(4, 4), (0, 0)]).chunks[0] == (6, 4)
    assert blocks.resolve_depth({"x": (1, 2)}, meta) == [(0, 0), (1, 2)]
    with pytest.raises(ValueError):
        blocks.check_overlap([(1, 2)], "reflect", True)
    with pytest.raises(ValueError):
        blocks.check_overlap([(1, 1)], "none", False)


def test_cell_table_and_fragments(spark, tmp_path):
    rng = np.random.default_rng(3)
    mask = rng.integers(0, 4, (2, 9, 10)).astype("uint32")
    mask[:, 5:, 5:] = 0
    f = frame_of(spark, mask, (2, 5, 5), "TYX")
    got = celltable.cell_table(f, (16, 4, 4)).toPandas()
    want = 0
    for by in range(2):
        for bx in range(2):
            part = mask[:, by * 5 : by * 5 + 5, bx * 5 : bx * 5 + 5]
            ordinal = 0
            for t in range(2):
                for label in range(1, 4):
                    y, x = np.nonzero(part[t] == label)
                    if not len(y):
                        continue
                    ordinal += 1
                    want += 1
                    row = got[(got.source_block_id == by * 2 + bx) & (got.local_ordinal == ordinal)].iloc[0]
                    assert row.label == label and row.area_or_volume == len(y)
                    assert row.centroid_y == np.float32(by * 5 + y.mean()) and row.bbox_x_max == bx * 5 + x.max()
                    assert row.touches_block_boundary == bool((y.min() == 0) | (y.max() == part.shape[1] - 1) | (x.min() == 0) | (x.max() == part.shape[2] - 1))
                    key = int(by * 5 + y.mean()) // 4 << 15 | int(bx * 5 + x.mean()) // 4
                    assert row.spatial_key == key and row.global_cell_id == key << 24 | (by * 2 + bx) << 22 | ordinal
                    assert row.cell_id_str == f"t00_00{by:02d}{bx:02d}{label:06d}"
    assert len(got) == want
    out = str(tmp_path / "cells")
    first = fragments.write_fragments(f, out).toPandas()
    assert len(first) == 4 and first.row_count.sum() == want and (first.row_count == 0).sum() == 1
    import pyarrow.parquet as pq

    table = pq.read_table(f"{out}/{first.path[0]}", partitioning=None)
    assert table.schema.field("global_cell_id").type == "uint64" and table.schema.names == celltable.COLUMNS
    assert fragments.write_fragments(f, out, resume=True).toPandas().skipped.all()


def test_unsigned_order(spark):
    got = spark.createDataFrame([(-1,), (5,), (-(1 << 63),)], "v long").orderBy(keys.unsigned_order(F.col("v"))).select(keys.unsigned(F.col("v"))).collect()
    assert [int(r[0]) for r in got] == [5, 1 << 63, (1 << 64) - 1]


@pytest.mark.parametrize("kind", ["array", "ome_zarr"])
def test_zarr(spark, tmp_path, image, kind):
    path = str(tmp_path / "a.zarr")
    f = frame_of(spark, image, (5, 6))
    prefix = zarr.prepare_store(path, f.meta, kind)
    rows = long_to_block(rechunk.rechunk(f, "explicit", "4,7"))  # blocks that don't fit the storage chunks
    zarr.write_blocks(rows, f.meta, path, prefix).collect()
    assert (array_of(zarr.read_zarr_long(spark, path, sizes={"Y": 3, "X": 8})) == image).all()
    pruned, _ = zarr.read_zarr(spark, path, chunk_mode="native", ranges=[[0, 5], [6, 12]])
    assert pruned.count() == 1
    assert zarr.prepare_store(path, f.meta, kind, resume=True) == prefix
    with pytest.raises(FileExistsError):
        zarr.prepare_store(path, f.meta, kind, overwrite=False)
    assert zarr.is_aligned(4, 8, 4, 10) and zarr.is_aligned(8, 10, 4, 10) and not zarr.is_aligned(2, 8, 4, 10)
    assert zarr.partial_chunks((2, 0), (6, 4), (4, 4), (10, 4)) == [(0, 0)]


def test_segmentation_is_local(spark):
    mask = np.ones((4, 8), "float32")
    got = array_of(segment.segment(frame_of(spark, mask, (4, 4)), threshold=0.5))
    assert (got == 1).all()
    assert segment.label_components(np.array([[1, 0, 1], [1, 0, 0], [0, 1, 1]], bool)).tolist() == [[1, 0, 2], [1, 0, 0], [0, 3, 3]]


def test_components_that_wind():
    rng = np.random.default_rng(4)
    for shape in ((9, 11), (4, 5, 6)):
        for _ in range(20):
            mask = rng.random(shape) < 0.55
            want, n = np.zeros(shape, int), 0
            for start in map(tuple, np.argwhere(mask)):
                if want[start]:
                    continue
                n += 1
                todo = [start]
                while todo:
                    at = todo.pop()
                    if all(0 <= i < s for i, s in zip(at, shape)) and mask[at] and not want[at]:
                        want[at] = n
                        todo += [(*at[:k], at[k] + d, *at[k + 1 :]) for k in range(len(shape)) for d in (-1, 1)]
            assert (segment.label_components(mask) == want).all()


def test_windows():
    assert windows.WindowGrid((391, 391, 391), (4, 4, 4)).total == 941192
    grid = windows.WindowGrid((10, 8, 6), (4, 4, 4))
    assert grid.total == 12 and grid[11].starts == (8, 4, 4) and grid[11].stops == (10, 8, 6)
    assert windows.WindowGrid((0, 4), (2, 2)).total == 0
    for bad in (((4,), (2, 2)), ((4,), (0,)), ((4,), (True,)), ((4,), (1.5,))):
        with pytest.raises(ValueError):
            windows.WindowGrid(*bad)


def test_types():
    assert can_connect("DASK_ARRAY[uint8]", "DASK_ARRAY[any]")[0]
    assert not can_connect("DASK_ARRAY[any]", "DASK_ARRAY[uint8]")[0]
    assert not can_connect("*", "DASK_ARRAY[any]")[0]
    assert not can_connect("DASK_ARRAY[int64]", "DASK_ARRAY[any]")[0]
    assert coerce("INT", "3.7") == 3 and coerce("BOOLEAN", "True") is True and coerce("INT", "x") == "x"


def saved_graph(source, out):
    return {
        "r": {"type": "OMEZarrReader", "inputs": {"file_path": source, "chunk_y": 5, "chunk_x": 6}},
        "c": {"type": "DaskTypeCast", "inputs": {"dask_arr": ["r", 0], "target_dtype": "float32"}},
        "s": {"type": "Cellpose", "inputs": {"image": ["c", 0], "cellprob_threshold": 20}},
        "z": {"type": "ZarrWriter", "inputs": {"array": ["s", 0], "output_path": f"{out}/m.zarr"}},
        "p": {"type": "WriteParquetCellTable", "inputs": {"mask": ["s", 0], "output_dir": f"{out}/cells"}},
    }


def test_graph_checks():
    g = saved_graph("/a.zarr", "/o")
    assert set(graph.roots(g)) == {"z", "p"} and graph.layers(g)["p"] == 3
    assert graph.check_types(g)["s"] == ("DASK_ARRAY[uint32]",)
    renamed = json.loads(json.dumps(g).replace('"s"', '"seg"'))
    assert graph.fingerprint(g, ["z", "p"]) == graph.fingerprint(renamed, ["p", "z"])
    assert graph.fingerprint(g, ["z"]) != graph.fingerprint(g, ["p"])
    with pytest.raises(ValueError, match="cycle"):
        graph.order({"a": {"type": "DaskROI", "inputs": {"dask_arr": ["b", 0]}}, "b": {"type": "DaskROI", "inputs": {"dask_arr": ["a", 0]}}})
    with pytest.raises(ValueError, match="unknown type"):
        graph.order({"a": {"type": "Nope"}})
    assert len(graph.describe_nodes()) == 7 and nodes.Token


def test_window_run_fails_and_resumes(spark, tmp_path, image):
    source, out = str(tmp_path / "in.zarr"), tmp_path / "out"
    f = frame_of(spark, image, (5, 6))
    zarr.write_blocks(long_to_block(f), f.meta, source, zarr.prepare_store(source, f.meta)).collect()
    g = saved_graph(source, str(out))
    where = str(tmp_path / "run")
    config = recovery.ExecutionConfig.parse({"mode": "window", "windowShape": [2, 2], "recoveryLocation": {"mode": "custom", "directory": where}})
    seen = []

    def fails(result, window):
        if window.index == 2:
            raise RuntimeError("lost")
        seen.append(window.index)
        result.run(window)

    with pytest.raises(RuntimeError, match="lost"):
        recovery.run_graph(g, config, fails)
    state = recovery.inspect(where)
    assert state["status"] == "failed" and state["completed"] == 2 and state["remaining"] == 2
    config.resume_action = "resume"
    assert recovery.run_graph(None, config)["windows"] == 2
    assert recovery.inspect(where)["progress"] == 100.0
    mask = array_of(zarr.read_zarr_long(spark, f"{out}/m.zarr"))
    assert ((mask > 0) == (image > 20)).all()
    found = [p for p in (out / "cells").rglob("*.parquet")]
    assert len(found) == 9
    recovery.delete_record(where)
    assert not (tmp_path / "run").exists() and found[0].exists()


def test_resources():
    plan = resources.plan_resources({"a": ("any", None), "b": ("gpu", 2), "c": ("cpu", None)})
    assert (plan.cpu_workers, plan.gpu_workers) == (1, 2)
    assert resources.plan_resources({"a": ("any", None)}).cpu_workers == 1
    placed = resources.place(12, 10)
    assert sum(c for c, _ in placed) == 12 and [g for _, g in placed] == [4, 3, 3]
    with pytest.raises(ValueError):
        resources.place(1, 1000)
    assert resources.time_limit_seconds("1-02:03:04") == 93784 and resources.time_limit_seconds("30") == 1800


def test_events(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    writer = events.EventWriter(path, "job")
    for k in range(3):
        writer.write("log", {"level": "info", "n": k})
    writer.write("execution_finished", {"status": "succeeded"})
    with path.open("a") as f:
        f.write('{"sequence": 5')
    session = events.Session()
    relay = events.EventRelay(path, tmp_path / "cursor", "job")
    assert relay.poll(session.apply) == 4 and relay.poll(session.apply) == 0
    assert session.status == "succeeded" and session.summary() == {"count": 3, "has_errors": False}
    with pytest.raises(ValueError):
        session.move("running")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(path.read_text().splitlines()[:4]))
    stream = events.windowed_counts(events.stream_events(spark, str(folder)))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {r["type"]: r["n"] for r in spark.table("counts").groupBy("type").agg(F.sum("n").alias("n")).collect()} == {"log": 3, "execution_finished": 1}
    kept = events.retained(spark.createDataFrame([(i, "failed" if i % 2 else "succeeded", float(i)) for i in range(30)], "id long, status string, finished_at double"), 30.0)
    assert [r["id"] for r in kept.collect()] == list(range(28, 8, -2))


def test_documents(tmp_path):
    documents.write_json(tmp_path / "a.json", {"x": 1}, overwrite=False)
    with pytest.raises(FileExistsError):
        documents.write_json(tmp_path / "a.json", {}, overwrite=False)
    with pytest.raises(ValueError):
        documents.write_json(tmp_path / "b.json", {"x": float("nan")})
    for d in ("b", "A", "c"):
        (tmp_path / d).mkdir()
    assert [d["name"] for d in documents.list_directories(tmp_path)["directories"]] == ["A", "b", "c"]
    (tmp_path / "m.onnx").write_text("")
    assert "m" in documents.list_models(tmp_path) and documents.resolve_model(tmp_path, "m").name == "m.onnx"
    with pytest.raises(ValueError):
        documents.resolve_model(tmp_path, "../x")


def test_random_crops_of_a_volume(spark):
    rng = random.Random(2)
    volume = np.arange(4 * 5 * 6 * 7).reshape(4, 5, 6, 7).astype("int32")
    f = frame_of(spark, volume, (2, 2, 4, 4))
    for _ in range(3):
        a, b, c = (sorted(rng.sample(range(n + 1), 2)) for n in (5, 6, 7))
        got = crop.crop(f, x=tuple(c), y=tuple(b), z=tuple(a))
        assert (array_of(got) == volume[:, a[0] : a[1], b[0] : b[1], c[0] : c[1]]).all()


def embeddings_of(spark, tmp_path, n):
    values = np.random.default_rng(3).normal(0, 0.2, (n, 64)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return np.floor(values.astype(float) * 1000).astype("int64")


def test_whole_overlap_queries(spark, tmp_path):
    array = embeddings_of(spark, tmp_path, 300)
    for name, mode in (("sum_none", "constant"), ("sum_reflect", "symmetric"), ("user_function", "constant")):
        padded = np.pad(array, 1, mode)
        want = sum(padded[i : i + 300, j : j + 64] for i in range(3) for j in range(3))
        got = np.full(array.shape, 10**9)
        pdf = queries.QUERIES[f"overlap_{name}"](spark, str(tmp_path)).toPandas()
        got[pdf["y"], pdf["x"]] = pdf["value"]
        assert len(pdf) == array.size and (got == want).all()


def test_window_pending_reads_the_bitmap(spark, tmp_path, monkeypatch):
    embeddings_of(spark, tmp_path, 300)
    good = queries.QUERIES["window_pending"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in good] == [(i, k + 1, pytest.approx(100 / 3)) for k, i in enumerate(i for i in range(9) if i % 3 != 1)]
    monkeypatch.setattr(windows.Bitmap, "mark", lambda self, index: None)
    assert queries.QUERIES["window_pending"](spark, str(tmp_path)).count() == 9


def test_unaligned_chunks_ask_the_store(spark, tmp_path):
    embeddings_of(spark, tmp_path, 300)

    def touched(y0, x0):
        cells = np.zeros((300, 64), bool)
        cells[y0 : y0 + 100, x0 : x0 + 24] = True
        parts = [cells[y : y + 64, x : x + 10] for y in range(0, 300, 64) for x in range(0, 64, 10)]
        return sum(p.any() and not p.all() for p in parts)

    got = {(r["y0"], r["x0"]): (r["aligned"], r["partial_chunks"]) for r in queries.QUERIES["zarr_unaligned_chunks"](spark, str(tmp_path)).collect()}
    assert got == {(y, x): (touched(y, x) == 0, touched(y, x)) for y in range(0, 300, 100) for x in range(0, 64, 24)}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) & set(queries.ORACLE_SQL)))
def test_queries_and_their_sql(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem", "nation", "supplier", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, tables), con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    assert names == sorted(got.columns)
    order = [c[0] for c in want.description]
    rows = lambda some: Counter(tuple(repr(float(v)) if isinstance(v, float) else repr(v) for v in r) for r in some)
    assert rows(tuple(r[c] for c in order) for r in got.collect()) == rows(want.fetchall())


def sum3():
    def near(block):
        p = np.pad(block.astype("int64"), 1)
        return sum(p[i : i + block.shape[0], j : j + block.shape[1]] for i in range(3) for j in range(3))

    return near


def store_of(spark, path, array, chunk):
    f = frame_of(spark, array, chunk)
    zarr.write_blocks(long_to_block(f), f.meta, path, zarr.prepare_store(path, f.meta)).collect()
    return f.meta


def spoil(path, meta, wanted):
    """Make all chunks but the wanted ones unreadable."""
    from itertools import product
    from pathlib import Path

    held = {}
    for at in product(*map(range, meta.numblocks)):
        if at not in wanted:
            chunk = Path(path, ".".join(map(str, at)))
            held[chunk] = chunk.read_bytes()
            chunk.write_bytes(b"not a chunk")
    return held


def test_only_wanted_chunks_are_opened(spark, tmp_path):
    path = str(tmp_path / "a.zarr")
    array = np.arange(12 * 20, dtype="uint16").reshape(12, 20)
    meta = store_of(spark, path, array, (4, 5))
    read = lambda: zarr.read_zarr_long(spark, path, chunk_mode="native")
    spoil(path, meta, {(1, 1), (1, 2)})
    roi = lambda: crop.crop(read(), x=(6, 14), y=(4, 8))
    assert (array_of(roi()) == array[4:8, 6:14]).all()
    assert (array_of(crop.crop(roi(), x=(1, 3), y=(0, 2))) == array[4:6, 7:9]).all()
    assert (array_of(cast.cast(roi(), "float32")) == array[4:8, 6:14]).all()
    assert (array_of(align.permute(roi(), "XY")) == array[4:8, 6:14].T).all()
    doubled = blocks.map_blocks(cast.cast(read(), "int32"), lambda block: block * 2)
    assert (array_of(crop.crop(doubled, x=(7, 13), y=(5, 8))) == 2 * array[5:8, 7:13]).all()
    both = align.zip_arrays([read(), cast.cast(read(), "uint16")])
    assert both.within([(4, 8), (5, 15)]).df.count() == 40
    with pytest.raises(Exception, match="zstd|Unknown|frame"):
        array_of(crop.crop(read(), x=(0, 14), y=(4, 8)))


@pytest.mark.parametrize("boundary", ["none", "reflect", "nearest", 7])
def test_halo_of_a_range_opens_its_neighbours_only(spark, tmp_path, boundary):
    path = str(tmp_path / "a.zarr")
    array = np.arange(12 * 20, dtype="int32").reshape(12, 20)
    meta = store_of(spark, path, array, (4, 5))
    whole = array_of(blocks.map_overlap(zarr.read_zarr_long(spark, path, chunk_mode="native"), sum3(), 1, boundary))
    spoil(path, meta, {(a, b) for a in (0, 1) for b in (2, 3)})
    near = blocks.map_overlap(zarr.read_zarr_long(spark, path, chunk_mode="native"), sum3(), 1, boundary)
    got = crop.crop(near, x=(16, 20), y=(0, 4))
    assert (array_of(got) == whole[0:4, 16:20]).all()


def test_each_window_opens_its_own_chunks(spark, tmp_path):
    from gridloom.plans import nodes as node_types
    from gridloom.plans.windows import WindowGrid

    path = str(tmp_path / "a.zarr")
    array = np.arange(12 * 20, dtype="int32").reshape(12, 20)
    meta = store_of(spark, path, array, (4, 5))
    for window in WindowGrid(meta.numblocks, (1, 2)):
        wanted = {(a, b) for a in range(window.starts[0], window.stops[0]) for b in range(window.starts[1], window.stops[1])}
        held = spoil(path, meta, wanted)
        made = blocks.map_blocks(zarr.read_zarr_long(spark, path, chunk_mode="native"), lambda block: block + 1)
        rows = node_types._of_window(made, window).df.collect()
        assert sorted(r["value"] for r in rows) == sorted(1 + v for a, b in wanted for v in array[4 * a : 4 * a + 4, 5 * b : 5 * b + 5].ravel().tolist())
        for chunk, data in held.items():
            chunk.write_bytes(data)


def test_unsigned_values_stay_exact(spark):
    from decimal import Decimal

    values = [0, 2**53 + 1, 2**63, 2**64 - 1, 2**63 - 1, 5]
    df = spark.createDataFrame([(i // 3, i % 3, Decimal(v)) for i, v in enumerate(values)], "y long, x long, value decimal(20,0)")
    f = ArrayFrame(df, ArrayMeta.regular((2, 3), (1, 2), "YX", "uint64"))
    got = lambda frame: [int(r["value"]) for r in frame.df.orderBy("y", "x").collect()]
    assert got(blocks.map_blocks(f, lambda block: block)) == values
    assert got(blocks.map_overlap(f, lambda block: block, 1)) == values
    assert got(block_to_long(long_to_block(f), f.meta)) == values
    assert got(blocks.map_blocks(f, lambda block: block + np.uint64(1))) == [(v + 1) % 2**64 for v in values]


def test_halo_of_several_inputs(spark):
    a, b = np.arange(60).reshape(6, 10).astype("int32"), (np.arange(60).reshape(6, 10) % 7).astype("float32")
    frames = {"left": frame_of(spark, a, (3, 5)), "right": frame_of(spark, b, (2, 4))}
    seen = lambda left, right: left * 2 + right.sum()
    got = array_of(blocks.map_overlap(frames, seen, dtype="float64", policy="rechunk_to_primary", depth_by_input={"right": 1}))
    for y in (0, 3):
        for x in (0, 5):
            near = b[max(0, y - 1) : y + 4, max(0, x - 1) : x + 6]
            assert (got[y : y + 3, x : x + 5] == a[y : y + 3, x : x + 5] * 2 + near.sum()).all()
    with pytest.raises(ValueError, match="no inputs"):
        blocks.map_overlap(frames, seen, policy="relaxed", depth_by_input={"other": 1})
    with pytest.raises(ValueError):
        blocks.map_overlap(frames, seen, 1, policy="strict")


def test_untrimmed_halo_grows(spark):
    a = np.arange(48).reshape(6, 8).astype("int32")
    with pytest.raises(ValueError, match="another shape"):
        blocks.map_overlap(frame_of(spark, a, (3, 4)), lambda block: block, 1, trim=False)
    grown = blocks.map_overlap(frame_of(spark, a, (3, 4)), lambda block: block, 1, trim=False, allow_untrimmed=True)
    assert grown.meta.shape == (8, 10) and grown.meta.chunks == ((4, 4), (5, 5))
    assert (array_of(grown) == np.block([[a[0:4, 0:5], a[0:4, 3:8]], [a[2:6, 0:5], a[2:6, 3:8]]])).all()


@pytest.mark.parametrize("name", ["default", "zstd", "zlib", "blosc", "lz4", "none"])
@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32", "uint64"])
def test_compressors_round_trip(tmp_path, name, dtype):
    rng = np.random.default_rng(1)
    meta = ArrayMeta.regular((90, 70), (64, 64), "YX", dtype)
    prefix = zarr.prepare_store(str(tmp_path / "a.zarr"), meta, compressor_name=name)
    made = zarr.ZarrArray(zarr.Store(str(tmp_path / "a.zarr")), prefix)
    for block in (np.arange(4096).reshape(64, 64).astype(dtype), rng.integers(0, 255, (64, 64)).astype(dtype), np.zeros((64, 64), dtype)):
        made.write_chunk((0, 0), block)
        assert (made.read_chunk((0, 0)) == block).all()


def blosc_frame(data, item, codec, pack, shuffle, block, split):
    """A frame written by the format's description, streams split by bytes or not."""
    import struct

    flags = (0 if split else 0x10) | codec << 5 | shuffle
    blocks = []
    for a in range(0, len(data), block):
        part = data[a : a + block]
        n = len(part) // item
        body = np.frombuffer(part[: n * item], np.uint8).reshape(n, item)
        if shuffle == 1:
            part = body.T.tobytes() + part[n * item :]
        elif shuffle == 4 and n % 8 == 0:
            bits = np.unpackbits(body, axis=1, bitorder="little").reshape(n, item * 8)
            part = np.packbits(bits.T, axis=1, bitorder="little").tobytes() + part[n * item :]
        parts = item if split and len(part) == block and block // item >= 128 and 1 < item <= 16 else 1
        size = len(part) // parts
        streams = [part[k * size : (k + 1) * size] for k in range(parts)]
        packed = [p if len(p) < size else s for s, p in ((s, pack(s)) for s in streams)]
        blocks.append(b"".join(struct.pack("<i", len(p)) + p for p in packed))
    at, offsets = 16 + 4 * len(blocks), []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    return struct.pack("<BBBBIII", 2, 1, flags, item, len(data), block, at) + struct.pack(f"<{len(offsets)}i", *offsets) + b"".join(blocks)


@pytest.mark.parametrize("item", [1, 2, 4, 8])
@pytest.mark.parametrize("shuffle", [0, 1, 4])
def test_blosc_frames_of_others(item, shuffle):
    import zlib as z

    import pyarrow as pa
    import zstandard

    from gridloom.sources import codecs

    data = (np.arange(5003, dtype=np.int64) // 7).astype(f"u{item}").tobytes()
    packs = {1: lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True), 2: lambda b: pa.Codec("snappy").compress(b, asbytes=True), 3: z.compress, 4: zstandard.ZstdCompressor().compress}
    for codec, pack in packs.items():
        for split in (True, False):
            for block in (1024 * item, 64 * item):
                assert codecs.blosc_decode(blosc_frame(data, item, codec, pack, shuffle, block, split)) == data
    with pytest.raises(ValueError, match="not supported"):
        codecs.blosc_decode(blosc_frame(data, item, 0, z.compress, 0, 1024 * item, False))


def test_fortran_order_and_paths(spark, tmp_path, monkeypatch):
    array = np.arange(24, dtype="<u2").reshape(4, 6)
    root = tmp_path / "f.zarr"
    root.mkdir()
    (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [4, 6], "chunks": [4, 6], "dtype": "<u2", "compressor": None, "fill_value": 0, "order": "F", "filters": None}))
    (root / "0.0").write_bytes(array.tobytes("F"))
    assert (array_of(zarr.read_zarr_long(spark, f'  "{root}" ')) == array).all()
    monkeypatch.setenv("HOME", str(tmp_path))
    assert zarr.normalise_path("~/x.zarr/") == f"{tmp_path}/x.zarr"
    for bad in ("", " '' ", "a\0b"):
        with pytest.raises(ValueError):
            zarr.normalise_path(bad)
    with pytest.raises(NotADirectoryError):
        zarr.read_zarr(spark, str(root / "0.0"))
    assert zarr.voxel_sizes("", 2) == [1.0, 1.0] and zarr.voxel_sizes("2, 0.5", 2) == [2.0, 0.5]
    for text in ("1", "1,0", "1,inf"):
        with pytest.raises(ValueError):
            zarr.voxel_sizes(text, 2)


def test_cell_table_keeps_what_it_may_not_replace(spark, tmp_path, image):
    source, out = str(tmp_path / "in.zarr"), tmp_path / "out"
    store_of(spark, source, image, (5, 6))
    (out / "cells").mkdir(parents=True)
    (out / "cells" / "mine").write_text("x")
    g = saved_graph(source, str(out))
    g["p"]["inputs"]["overwrite"] = False
    with pytest.raises(FileExistsError):
        graph.build(g)
    assert (out / "cells" / "mine").exists()


def test_hooks(spark, tmp_path, monkeypatch):
    seen = []

    class Made:
        meta = None

        def run(self, window):
            seen.append("run")

    class Probe(graph.Node):
        RETURNS, OUTPUT = ("INT",), True

        def preprocess(self, **_):
            seen.append("pre")

        def execute(self, **_):
            return Made()

        def postprocess(self, result, **_):
            seen.append(("post", type(result) is Made))

        def cleanup(self, **_):
            seen.append("clean")

    monkeypatch.setitem(graph.NODES, "Probe", Probe)
    recovery.run_graph({"a": {"type": "Probe"}}, recovery.ExecutionConfig())
    assert seen == ["pre", "run", ("post", True)]
    seen.clear()
    with pytest.raises(RuntimeError, match="lost"):
        recovery.run_graph({"a": {"type": "Probe"}}, recovery.ExecutionConfig(), lambda result, window: (_ for _ in ()).throw(RuntimeError("lost")))
    assert seen == ["pre", "clean"]


def test_recorded_outputs_must_match():
    recorded = [{"nodeId": "z", "nodeType": "ZarrWriter", "path": "/o/m.zarr"}]
    recovery.check_outputs(recorded, [dict(recorded[0])])
    for change in ({"path": "/o/other.zarr"}, {"nodeType": "WriteParquetCellTable"}, {"nodeId": "y"}):
        with pytest.raises(ValueError):
            recovery.check_outputs(recorded, [recorded[0] | change])
    g = saved_graph("/a.zarr", "/o")
    assert [o["nodeId"] for o in recovery.outputs_of(g, ["z", "p"])] == ["z", "p"]
    g["p"]["inputs"]["output_dir"] = "/o/m.zarr/cells"
    with pytest.raises(ValueError, match="overlap"):
        recovery.outputs_of(g, ["z", "p"])


def test_ownership_of_a_reused_process_number(tmp_path):
    import os
    import socket

    lock = tmp_path / recovery.LOCK
    lock.write_text(json.dumps({"pid": os.getpid(), "started": "1", "host": socket.gethostname()}))
    with recovery.Ownership(tmp_path):
        assert json.loads(lock.read_text())["started"] != "1"
        with pytest.raises(RuntimeError):
            recovery.Ownership(tmp_path).__enter__()
    assert not lock.exists()


def test_output_specs(spark, image):
    f = frame_of(spark, image, (5, 17))
    sums = blocks.map_blocks(f, lambda block: block.sum(axis=1), dtype="int32", output=blocks.OutputSpec(drop_axis="X"))
    assert sums.meta.shape == (13,) and (array_of(sums) == image.sum(axis=1)).all()
    tokens = blocks.map_blocks(frame_of(spark, image, (5, 6)), lambda block: np.array([[block.max()]]), output=blocks.OutputSpec(chunks="token"))
    assert tokens.meta.shape == (3, 3) and array_of(tokens)[2, 2] == image[10:, 12:].max()
    pairs = blocks.map_blocks(f, lambda block: np.stack([block, -block]), output=blocks.OutputSpec(new_axis=("C", 0, 2)))
    assert pairs.meta.axes == ("C", "Y", "X") and (array_of(pairs) == np.stack([image, -image])).all()
    with pytest.raises(ValueError):
        blocks.map_blocks(frame_of(spark, image, (5, 6)), lambda block: block, output=blocks.OutputSpec(drop_axis="X"))
    planned = blocks.map_blocks({"a": frame_of(spark, image, (5, 6)), "b": f}, lambda a, b: a + b, input_chunks={"a": "13,-1", "b": "13,-1"})
    assert planned.meta.numblocks == (1, 1) and (array_of(planned) == 2 * image).all()


def test_context_and_worker_cache(spark, image, tmp_path):
    f, folder = frame_of(spark, image, (13, 17)), str(tmp_path)
    (tmp_path / "m.pt").write_text("")

    def seen(block, ctx):
        made = [ctx.cached("n", 1, lambda: object()) for _ in range(3)]
        model = ctx.model(folder, "m", lambda path: path)
        assert made[0] is made[2] and ctx.inputs["block"]["dtype"] == "int32" and ctx.inputs["block"]["extent"] == (13, 17)
        assert ctx.device in ("cpu", "gpu") and model.endswith("m.pt")
        return block

    assert (array_of(blocks.map_blocks(f, seen)) == image).all()
    gone = []
    blocks.BlockContext.cached("n", 2, lambda: "x", dispose=gone.append)
    blocks.clear_cache("n")
    assert gone == ["x"] and not [k for k in blocks._CACHE if k[0] == "n"]


def test_slots_and_memory(spark):
    assert resources.slot_totals([{"slots": {"cpu": 4, "gpu": 1}}, {"threads": 3}, {"slots": {"gpu": 2}}]) == {"cpu": 7, "gpu": 3}
    assert resources.session_slots(spark) == {"cpu": spark.sparkContext.defaultParallelism}
    found = resources.executors(spark)
    assert found and all(w["total"] >= w["used"] >= 0 for w in found)
    states = iter([[{"worker": "a", "used": 5}, {"worker": "b", "used": 1}], [{"worker": "a", "used": 9}, {"worker": "c", "used": 2}]])
    log = resources.MemoryLog(lambda: next(states))
    log.snapshot("before"), log.snapshot("after")
    assert log.delta("before", "after") == {"a": 4, "b": -1, "c": 2}
    with pytest.raises(KeyError):
        log.delta("before", "never")


def test_axes_precedence():
    assert nodes.axes_of(3) == tuple("ZYX")
    assert nodes.axes_of(3, declared="TYX") == tuple("TYX")
    assert nodes.axes_of(3, declared="TYX", given={"axes": "c,y,x"}) == tuple("CYX")
    assert nodes.axes_of(3, declared="TYX", given={"axes": "c,y,x", "mask_axes": "q,y,x"}, name="mask") == tuple("QYX")
    assert nodes.axes_of(3, given={"axes": "c,y,x"}, inputs=2) == tuple("ZYX")
    with pytest.raises(ValueError):
        nodes.axes_of(3, given={"axes": "y,x"})
