"""Driver queries of plans, records, events and documents, each through its operator."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from gridloom.operators import rechunk
from gridloom.arrayframe import ArrayMeta, long_to_block
from gridloom.plans import graph, nodes, recovery, resources, saved, windows
from gridloom.queries import I2, SIZE, _e2, _i2, _scratch, _table, query
from gridloom.sources import documents, zarr
from gridloom.streaming import events
from gridloom.types import can_connect

__all__ = ["nodes"]


def _rows(spark, sf_dir, name):
    """A small table's rows, for operators that run on the driver."""
    df = _table(spark, sf_dir, name)
    return df.orderBy(df.columns[0]).collect()


def _folder(spark) -> Path:
    path = Path(_scratch(spark))
    path.mkdir(parents=True)
    return path


# -- arrays through stores and records


def _store(spark, frame, path, kind="array", **options):
    prefix = zarr.prepare_store(path, frame.meta, kind, **options)
    zarr.write_blocks(long_to_block(frame), frame.meta, path, prefix).count()
    return prefix


_BY_X = f"WITH {I2} SELECT x, CAST(sum(value) AS BIGINT) AS total, count(*) AS n FROM i2 GROUP BY x"


def _by_x(frame):
    return frame.df.groupBy("x").agg(F.sum("value").cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


@query(_BY_X)
def zarr_compressors(spark, sf_dir):
    """I2 through a store of each compressor in turn."""
    frame, base = rechunk.rechunk(_i2(spark, sf_dir), "explicit", "200,32"), _scratch(spark)
    for name in ("zlib", "lz4", "blosc"):
        path = f"{base}/{name}.zarr"
        _store(spark, frame, path, compressor_name=name)
        frame = zarr.read_zarr_long(spark, path, chunk_mode="native")
    return _by_x(frame)


@query(f"WITH {I2} SELECT y, x, value FROM (SELECT y, x, CAST(value AS BIGINT) AS value FROM i2) WHERE y >= 130 AND y < 140")
def zarr_pruned_crop(spark, sf_dir):
    """A crop of a stored array; the chunks it does not meet are made unreadable."""
    from gridloom.operators import crop

    path = f"{_scratch(spark)}/a.zarr"
    _store(spark, rechunk.rechunk(_i2(spark, sf_dir), "explicit", "64,64"), path)
    store, array = zarr.Store(path), zarr.ZarrArray(zarr.Store(path))
    for k in range(-(-array.shape[0] // 64)):
        if k != 2:
            store.write(f"{k}.0", b"not a chunk")
    if array.shape[0] <= 130:
        return _i2(spark, sf_dir).df.limit(0).select("y", "x", "value")
    cut = crop.crop(zarr.read_zarr_long(spark, path, chunk_mode="native"), y=(130, min(140, array.shape[0])))
    return cut.df.select((F.col("y") + 130).alias("y"), "x", "value")


@query(_BY_X)
def zarr_levels(spark, sf_dir):
    """A group of two arrays; the second one is read by its level and path."""
    path = f"{_scratch(spark)}/group.zarr"
    i2 = _i2(spark, sf_dir)
    _store(spark, i2.with_df(i2.df.withColumn("value", F.lit(0).cast("long"))), path, "ome_zarr")
    store = zarr.Store(path)
    header, scales = store.json("0/.zarray"), store.json(".zattrs")
    meta = rechunk.rechunk(i2, "axis_name", axis_sizes="Y:50").meta
    store.write("half/1/.zarray", json.dumps(header | {"chunks": [c[0] for c in meta.chunks]}).encode())
    scales["multiscales"][0]["datasets"].append({"path": "half/1"})
    store.write(".zattrs", json.dumps(scales).encode())
    zarr.write_blocks(long_to_block(i2), meta, path, "half/1/").count()
    return _by_x(zarr.read_zarr_long(spark, path, level=1, chunk_mode="native", axes="y,x"))


@query(_BY_X)
def zarr_resumed_regions(spark, sf_dir):
    """Two regions whose border cuts storage chunks, the second after a resume check."""
    path = f"{_scratch(spark)}/a.zarr"
    i2 = _i2(spark, sf_dir)
    rows, at = i2.meta.shape[0], 77
    halves = i2.with_df(i2.df, chunks=((at, rows - at), (WIDE,))) if rows > at else i2
    prefix = zarr.prepare_store(path, i2.meta)
    blocks = long_to_block(halves)
    for k in range(halves.meta.numblocks[0]):
        zarr.prepare_store(path, i2.meta, resume=True)
        zarr.write_blocks(blocks.where(F.col("block")[0] == k), i2.meta, path, prefix).count()
    return _by_x(zarr.read_zarr_long(spark, path))


WIDE = 64


@query(f"WITH {I2}, {SIZE} SELECT x, CAST(sum(greatest(-300, least(300, value))) AS BIGINT) AS total, count(*) AS n, CAST(any_value((n.n + 255) // 256) AS BIGINT) AS windows, 100.0::DOUBLE AS progress FROM i2, n GROUP BY x")
def window_run(spark, sf_dir):
    """A graph run by windows of two block rows: it fails at the second one, goes on after
    a resume, and its store is read back."""
    base = _folder(spark)
    i2 = _i2(spark, sf_dir)
    clipped = i2.with_df(i2.df.withColumn("value", F.greatest(F.lit(-300), F.least(F.lit(300), F.col("value")))))
    _store(spark, clipped, f"{base}/in.zarr")
    drawn = {
        "r": {"type": "OMEZarrReader", "inputs": {"file_path": f"{base}/in.zarr", "chunk_mode": "native"}},
        "c": {"type": "DaskTypeCast", "inputs": {"dask_arr": ["r", 0], "target_dtype": "int16"}},
        "w": {"type": "ZarrWriter", "inputs": {"array": ["c", 0], "output_path": f"{base}/out.zarr", "compressor_name": "blosc"}},
    }
    config = recovery.ExecutionConfig.parse({"mode": "window", "windowShape": [2, 4], "recoveryLocation": {"mode": "output_sidecar", "anchorNodeId": "w"}})

    def lost(result, window):
        if window.index == 1:
            raise RuntimeError("lost")
        result.run(window)

    where = recovery.record_directory(drawn, config.recovery_location)
    try:
        recovery.run_graph(drawn, config, lost)
    except RuntimeError:
        config.resume_action = "resume"
        recovery.run_graph(None, recovery.ExecutionConfig("window", [2, 4], "resume", {"mode": "custom", "directory": str(where)}))
    state = recovery.inspect(where)
    made = _by_x(zarr.read_zarr_long(spark, f"{base}/out.zarr"))
    return made.withColumns({"windows": F.lit(state["completed"]).cast("long"), "progress": F.lit(float(state["progress"]))})


# -- graphs

_DRAWN = {
    "r": {"type": "OMEZarrReader", "inputs": {"file_path": "/in.zarr"}},
    "a": {"type": "DaskROI", "inputs": {"dask_arr": ["r", 0], "end_y": 9}},
    "b": {"type": "DaskTypeCast", "inputs": {"dask_arr": ["a", 0], "target_dtype": "float32"}},
    "m": {"type": "Cellpose", "inputs": {"image": ["b", 0]}},
    "w": {"type": "ZarrWriter", "inputs": {"array": ["m", 0], "output_path": "/o/m.zarr"}},
    "t": {"type": "WriteParquetCellTable", "inputs": {"mask": ["m", 0], "output_dir": "/o/cells"}},
    "v": {"type": "ZarrWriter", "inputs": {"array": ["r", 0], "output_path": "/o/v.zarr"}},
    "u": {"type": "DaskROI", "inputs": {"dask_arr": ["r", 0]}},
}
_DRAWN_SQL = f"""nodes(id, kind) AS (VALUES {', '.join(f"('{k}', '{n['type']}')" for k, n in _DRAWN.items())}),
links(source, target) AS (VALUES {', '.join(f"('{s}', '{t}')" for s, _, t, _ in graph.edges(_DRAWN))})"""


@query(f"""WITH RECURSIVE {_DRAWN_SQL}, deep(id, layer) AS (SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT target FROM links)
UNION ALL SELECT target, layer + 1 FROM deep JOIN links ON source = id),
up AS (SELECT id FROM nodes WHERE kind IN ('ZarrWriter', 'WriteParquetCellTable') UNION SELECT source FROM links JOIN up ON target = up.id)
SELECT nodes.id, CAST(max(layer) AS BIGINT) AS layer, bool_or(up.id IS NOT NULL) AS reachable FROM nodes JOIN deep USING (id) LEFT JOIN up ON up.id = nodes.id GROUP BY nodes.id""")
def graph_layers(spark, sf_dir):
    layers, used = graph.layers(_DRAWN), graph.reachable(_DRAWN, graph.roots(_DRAWN))
    return spark.createDataFrame([(k, layers[k], k in used) for k in _DRAWN], "id string, layer long, reachable boolean")


@query("""SELECT n_nationkey, sha256('{"order":"C","shape":[' || (n_nationkey + 1) || ',64],"window":[2,3]}') AS plan, sha256('{"a":"' || n_name || '","b":[' || n_regionkey || ',null]}') AS payload FROM nation""")
def plan_fingerprints(spark, sf_dir):
    made = [(r["n_nationkey"], graph.plan_fingerprint((r["n_nationkey"] + 1, 64), (2, 3)), graph.digest({"b": [r["n_regionkey"], None], "a": r["n_name"]})) for r in _rows(spark, sf_dir, "nation")]
    return spark.createDataFrame(made, "n_nationkey int, plan string, payload string")


_PORTS = ["*", "INT", "STRING", "DASK_ARRAY", *[f"DASK_ARRAY[{d}]" for d in ("any", "same", "uint8", "float32")]]


@query(f"""WITH p(t) AS (VALUES {', '.join(f"('{p}')" for p in _PORTS)}), q AS (SELECT t, split_part(t, '[', 1) AS box, CASE WHEN t LIKE '%[%' THEN replace(split_part(t, '[', 2), ']', '') END AS d FROM p)
SELECT a.t AS source, b.t AS target, a.box = b.box AND (a.box <> 'DASK_ARRAY' OR coalesce(b.d, 'any') = 'any' OR (coalesce(a.d, 'any') <> 'any' AND (b.d = 'same' OR a.d = b.d))) AS ok FROM q a, q b""")
def port_matrix(spark, sf_dir):
    return spark.createDataFrame([(a, b, can_connect(a, b)[0]) for a in _PORTS for b in _PORTS], "source string, target string, ok boolean")


@query("""WITH m(mode) AS (VALUES ('explicit'), ('axis_index'), ('axis_name'), ('match_reference')),
i(input, modes) AS (VALUES ('dask_arr', NULL), ('mode', NULL), ('chunks', ['explicit']), ('axis_chunks', ['axis_index', 'axis_name']), ('reference_arr', ['match_reference']), ('axes', ['axis_name']))
SELECT mode, input FROM m, i WHERE modes IS NULL OR list_contains(modes, mode)""")
def visible_inputs(spark, sf_dir):
    made = [(mode, name) for mode in ("explicit", "axis_index", "axis_name", "match_reference") for name in saved.visible_inputs("DaskRechunk", {"mode": mode})]
    return spark.createDataFrame(made, "mode string, input string")


# -- resources and windows


@query("""SELECT s_suppkey, floor(10 * (64 + s_suppkey % 512) * 0.70::DOUBLE * 1 / (s_suppkey % 7 + 1 + 3 * (s_suppkey % 3))) / 10 AS cpu, floor(10 * (64 + s_suppkey % 512) * 0.70::DOUBLE * 3 / (s_suppkey % 7 + 1 + 3 * (s_suppkey % 3))) / 10 AS gpu,
greatest(1, CASE WHEN s_suppkey % 5 > 0 THEN least(s_suppkey % 5, 3) WHEN s_suppkey % 3 > 0 THEN least(2 * (s_suppkey % 3), 3) ELSE 1 END)::BIGINT AS at_once, greatest(1, (s_suppkey * 997 + 999) // 1000)::BIGINT AS stride FROM supplier""")
def run_shares(spark, sf_dir):
    """Memory of a worker, windows at once and the stride of progress events."""
    made = []
    for r in _rows(spark, sf_dir, "supplier"):
        k = r["s_suppkey"]
        cpu, gpu = resources.memory_share(float(64 + k % 512), k % 7 + 1, k % 3)
        made.append((k, cpu, gpu, windows.in_flight(k % 5 or None, k % 3, 3), windows.stride(k * 997)))
    return spark.createDataFrame(made, "s_suppkey long, cpu double, gpu double, at_once long, stride long")


@query("""SELECT s_suppkey, CAST(s_suppkey % 9 * 86400 + s_suppkey % 24 * 3600 + s_suppkey % 60 * 60 + s_suppkey % 53 AS BIGINT) AS full_form, CAST(s_suppkey % 90 * 60 + s_suppkey % 60 AS BIGINT) AS minutes FROM supplier""")
def time_limits(spark, sf_dir):
    made = [(k, resources.time_limit_seconds(f"{k % 9}-{k % 24}:{k % 60}:{k % 53}"), resources.time_limit_seconds(f"{k % 90}:{k % 60}")) for k in (r["s_suppkey"] for r in _rows(spark, sf_dir, "supplier"))]
    return spark.createDataFrame(made, "s_suppkey long, full_form long, minutes long")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 40 AS total, s_suppkey % 60 AS done, s_suppkey % 50 AS now FROM supplier)
SELECT k AS s_suppkey, total::BIGINT AS total, least(total, done)::BIGINT AS done, least(total, now)::BIGINT AS now, CASE WHEN total = 0 THEN 100.0 ELSE 100.0 * least(total, done)::DOUBLE / total END AS progress, CASE WHEN total > 0 AND done >= total THEN 'finalizing' ELSE 'running' END AS status FROM s""")
def progress_normalised(spark, sf_dir):
    made = []
    for k in (r["s_suppkey"] for r in _rows(spark, sf_dir, "supplier")):
        p = events.normalise_progress({"totalWindows": k % 40, "completedWindows": k % 60, "currentWindow": k % 50})
        made.append((k, p["totalWindows"], p["completedWindows"], p["currentWindow"], float(p["progress"]), p["windowStatus"]))
    return spark.createDataFrame(made, "s_suppkey long, total long, done long, now long, progress double, status string")


# -- events and documents


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS sequence, CASE WHEN s_suppkey % 4 = 0 THEN 'progress' ELSE 'log' END AS type, s_suppkey, s_name FROM supplier")
def events_relayed(spark, sf_dir):
    """Supplier rows as events: written as lines, read in two goes from the saved cursor."""
    folder, rows, seen = _folder(spark), _rows(spark, sf_dir, "supplier"), []
    writer = events.EventWriter(folder / "events.jsonl", "job")

    def write(some):
        for r in some:
            writer.write("progress" if r["s_suppkey"] % 4 == 0 else "log", {"key": r["s_suppkey"], "name": r["s_name"]})

    def read():  # a relay of its own: what it knows is in the cursor file
        events.EventRelay(folder / "events.jsonl", folder / "cursor", "job").poll(seen.append)

    write(rows[: len(rows) // 2])
    read()
    with (folder / "events.jsonl").open("a") as f:
        f.write('{"sequence": ')  # a line that is not complete yet
    read()
    (folder / "events.jsonl").write_text((folder / "events.jsonl").read_text().removesuffix('{"sequence": '))
    write(rows[len(rows) // 2 :])
    read()
    made = [(e["sequence"], e["type"], *(json.loads(e["payload"])[k] for k in ("key", "name"))) for e in seen]
    return spark.createDataFrame(made, "sequence long, type string, s_suppkey long, s_name string")


@query("SELECT event_type AS type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def event_stream_windows(spark, sf_dir):
    """The events as a stream of JSON files, counted by type and hour."""
    folder, name = _scratch(spark), f"counts_{uuid.uuid4().hex}"
    table = _table(spark, sf_dir, "events")
    lines = table.select(F.col("event_id").alias("sequence"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.lit("job").alias("job_id"), F.col("event_type").alias("type"), F.lit("{}").alias("payload"))
    lines.repartition(4).write.json(f"{folder}/lines")
    counted = events.windowed_counts(events.stream_events(spark, f"{folder}/lines", 2), "1 hour")

    def keep(batch, _):
        batch.select("type", F.unix_seconds("window.start").alias("start"), "n").write.mode("overwrite").parquet(f"{folder}/{name}")

    run = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")


@query("""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS status, CAST(o_orderkey % 7919 AS DOUBLE) AS finished_at FROM orders)
SELECT * FROM s WHERE 8000 - finished_at <= 3600 ORDER BY CAST(status = 'failed' AS INT), finished_at DESC, id LIMIT 10""")
def sessions_retained(spark, sf_dir):
    """A top-k of finished sessions, here orders."""
    failed = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded")
    sessions = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), failed.alias("status"), (F.col("o_orderkey") % 7919).cast("double").alias("finished_at"))
    return events.retained(sessions, 8000.0)


@query("""WITH e AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names, max(n_nationkey) AS last, count(*) AS n FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, least(n, 3)::BIGINT AS count, last % 2 = 0 AS has_errors, list_reduce(names[-3:], lambda a, b: a || ',' || b) AS messages FROM e""")
def log_summaries(spark, sf_dir):
    """A session for each region: its nations are log lines, the last three are kept."""
    made, sessions = [], {}
    for r in _rows(spark, sf_dir, "nation"):
        sessions.setdefault(r["n_regionkey"], []).append(r)
    for region, rows in sessions.items():
        session = events.Session(keep=3)
        for r in rows:
            level = "error" if r is rows[-1] and r["n_nationkey"] % 2 == 0 else "info"
            session.apply({"type": "log", "payload": json.dumps({"level": level, "text": r["n_name"]})})
        found = session.summary()
        made.append((region, found["count"], found["has_errors"], ",".join(x["text"] for x in session.logs)))
    return spark.createDataFrame(made, "n_regionkey int, count long, has_errors boolean, messages string")


@query("SELECT n_nationkey, n_name, n_regionkey, n_regionkey > 0 AS is_record, CAST(row_number() OVER (ORDER BY lower(n_name || '-' || n_nationkey)) AS BIGINT) AS place FROM nation")
def json_documents(spark, sf_dir):
    """Nations as JSON documents in folders of their own: written whole, listed, read."""
    base, rows = _folder(spark), _rows(spark, sf_dir, "nation")
    for r in rows:
        folder = base / f"{r['n_name']}-{r['n_nationkey']}"
        folder.mkdir()
        name = "manifest.json" if r["n_regionkey"] > 0 else "other.json"
        documents.write_json(folder / name, r.asDict(), overwrite=False)
    made = []
    for place, entry in enumerate(documents.list_directories(base)["directories"], 1):
        folder = base / entry["name"]
        found = documents.read_object(next(folder.iterdir()))
        made.append((found["n_nationkey"], found["n_name"], found["n_regionkey"], entry["is_record"], place))
    return spark.createDataFrame(made, "n_nationkey int, n_name string, n_regionkey int, is_record boolean, place long")


@query("SELECT n_nationkey, n_name AS name, n_name || CASE n_regionkey WHEN 0 THEN '.pt' WHEN 1 THEN '.onnx' WHEN 2 THEN '' WHEN 3 THEN '.bin' ELSE '.safetensors' END AS file FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT n_nationkey, n_name || '.bin', n_name || '.bin' FROM nation WHERE n_regionkey = 3")
def model_listing(spark, sf_dir):
    """A model file for each nation, listed by name and resolved to its path."""
    base, keys = _folder(spark), {}
    (base / ".hidden").write_text("")
    for r in _rows(spark, sf_dir, "nation"):
        suffix = (".pt", ".onnx", "", ".bin", ".safetensors")[r["n_regionkey"]]
        (base / f"{r['n_name']}{suffix}").write_text("")
        keys[r["n_name"]] = keys[f"{r['n_name']}.bin"] = r["n_nationkey"]
    made = [(keys[name], name, documents.resolve_model(base, name).name) for name in documents.list_models(base)]
    return spark.createDataFrame(made, "n_nationkey int, name string, file string")


@query("SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def session_states(spark, sf_dir):
    """Each event ends a session of its own, through the state machine, in the executors."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k in pdf["event_id"].tolist():
                session = events.Session()
                session.apply({"type": "execution_finished", "payload": {"status": "failed" if k % 3 == 0 else "succeeded"}})
                out.append(session.replay()[0]["status"])
            yield pd.DataFrame({"user_id": pdf["user_id"], "status": out})

    ended = _table(spark, sf_dir, "events").select("event_id", "user_id").mapInPandas(run, "user_id long, status string")
    return ended.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SIZE} SELECT CAST(axis AS BIGINT) AS axis, CAST(unnest(CASE axis WHEN 0 THEN [least(n, 128)] ELSE [16] END) AS BIGINT) AS first_chunk, CASE axis WHEN 0 THEN n ELSE 64 END::BIGINT AS size FROM n, range(2) r(axis)")
def storage_chunks(spark, sf_dir):
    """Storage chunks of a new store are the first chunks of the array's axes."""
    e2 = _e2(spark, sf_dir)
    path = f"{_scratch(spark)}/a.zarr"
    array = zarr.ZarrArray(zarr.Store(path), zarr.prepare_store(path, e2.meta))
    return spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(zip(array.chunks, array.shape))], "axis long, first_chunk long, size long")


@query("""WITH c(kind, shape, native, axes, keep) AS (VALUES ('a', [5, 3, 40, 200], [1, 1, 8, 100], 'TCYX', false), ('b', [5, 3, 40, 200], [1, 1, 8, 100], 'TCYX', true), ('c', [90, 200, 30], [7, 50, 30], 'ZYX', false), ('d', [4, 9, 50], [2, 0, 5], 'QYX', false)),
p AS (SELECT kind, keep, unnest(range(len(shape))) AS i, unnest(shape) AS n, unnest(native) AS c, unnest(string_split_regex(axes, '')) AS a FROM c)
SELECT kind, i AS axis, CAST(CASE WHEN a IN ('X', 'Y', 'Z') THEN least(64, n) WHEN a = 'C' OR (keep AND i = 0) THEN n WHEN a = 'T' THEN 1 WHEN c > 0 THEN c ELSE 64 END AS BIGINT) AS chunk FROM p""")
def scan_chunks(spark, sf_dir):
    """Block sizes of a scan by axes: spatial ones bounded, channels whole, time by one."""
    cases = [("a", (5, 3, 40, 200), (1, 1, 8, 100), "TCYX", False), ("b", (5, 3, 40, 200), (1, 1, 8, 100), "TCYX", True), ("c", (90, 200, 30), (7, 50, 30), "ZYX", False), ("d", (4, 9, 50), (2, 0, 5), "QYX", False)]
    made = [(k, i, c) for k, shape, native, axes, keep in cases for i, c in enumerate(zarr.target_chunks(shape, native, tuple(axes), keep_first=keep))]
    return spark.createDataFrame(made, "kind string, axis long, chunk long")


def _preflight_meta(rows: int) -> ArrayMeta:
    return ArrayMeta.regular((rows, WIDE), (128, 16), "YX", "float32")


@query(f"WITH {SIZE} SELECT CAST((n + 127) // 128 AS BIGINT) AS blocks_y, CAST(4 AS BIGINT) AS blocks_x, CAST((((n + 127) // 128) + 2) // 3 * 2 AS BIGINT) AS windows, true AS windowable FROM n")
def preflight_counts(spark, sf_dir):
    """Shapes and windows of a graph from metadata alone; nothing is written."""
    path = f"{_scratch(spark)}/in.zarr"
    meta = _preflight_meta(_e2(spark, sf_dir).meta.shape[0])
    zarr.prepare_store(path, meta)
    out = str(Path(path).with_name("out.zarr"))
    plan = recovery.preflight({"r": {"type": "OMEZarrReader", "inputs": {"file_path": path, "chunk_mode": "native"}}, "w": {"type": "ZarrWriter", "inputs": {"array": ["r", 0], "output_path": out}}}, [3, 2])
    if zarr.Store(out).exists():
        raise RuntimeError("a preflight wrote its output")
    return spark.createDataFrame([(*plan["outputShapes"]["w"], plan["totalWindows"], plan["windowable"])], "blocks_y long, blocks_x long, windows long, windowable boolean")
