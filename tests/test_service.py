"""The control service, saved graphs and settings."""

import base64
import http.client
import json
import os
import queue
import socket
import struct
import threading

import numpy as np
import pytest
from test_arrays import frame_of, saved_graph

from gridloom import service as services
from gridloom.arrayframe import long_to_block
from gridloom.plans import recovery, saved as documents
from gridloom.sources import zarr


@pytest.fixture
def store(spark, tmp_path):
    image = (np.arange(340).reshape(17, 20) % 41).astype("uint8")
    f = frame_of(spark, image, (5, 6))
    path = str(tmp_path / "in.zarr")
    zarr.write_blocks(long_to_block(f), f.meta, path, zarr.prepare_store(path, f.meta)).collect()
    return path


@pytest.fixture
def service(spark):
    return services.Service(spark)


@pytest.fixture
def server(service):
    made = services.make_server(service)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()
    made.server_close()


def until(inbox, kind):
    while True:
        message = inbox.get(timeout=120)
        assert message["type"] != "error", message
        if message["type"] == kind:
            return message


def test_http(server, store, tmp_path):
    def ask(method, path, body=None, kind="application/json"):
        link = http.client.HTTPConnection(*server.server_address, timeout=60)
        link.request(method, path, None if body is None else json.dumps(body), {"Content-Type": kind})
        got = link.getresponse()
        return got.status, json.loads(got.read())

    status, info = ask("GET", "/object_info")
    assert status == 200 and len(info) >= 7
    assert ask("GET", "/plugin_status")[0] == 200 and "dashboard_url" in ask("GET", "/dashboard_url")[1]
    status, plan = ask("POST", "/execution/preflight", {"graph": saved_graph(store, str(tmp_path / "out")), "windowShape": [2, 2]})
    assert status == 200 and plan["windowable"] and plan["totalWindows"] == 4
    assert not (tmp_path / "out").exists()
    assert ask("POST", "/execution/preflight", {})[0] == 400
    assert ask("POST", "/execution/preflight", {}, "text/plain")[0] == 400
    assert ask("POST", "/execution/recovery/inspect", {"recoveryDirectory": "x"})[0] == 400
    assert ask("POST", "/execution/recovery/inspect", {"recoveryDirectory": str(tmp_path / "none")})[0] == 404
    status, listing = ask("GET", f"/filesystem/directories?path={tmp_path}")
    assert status == 200 and [d["name"] for d in listing["directories"]] == ["in.zarr"]
    assert ask("POST", "/reload_nodes", {})[1]["code"] == "HOT_RELOAD_DISABLED"
    assert ask("GET", "/nothing")[0] == 404


def test_execute_open_delete(service, store, tmp_path):
    inbox, own = queue.Queue(), {}
    where = str(tmp_path / "run")
    config = {"mode": "window", "windowShape": [2, 2], "recoveryLocation": {"mode": "custom", "directory": where}}
    g = saved_graph(store, str(tmp_path / "out"))
    service.command({"command": "execute_graph", "executionId": "e", "graph": g, "executionConfig": config}, inbox.put, own)
    assert until(inbox, "execution_started")["executionId"] == "e" == own["id"]
    end = until(inbox, "execution_finished")
    assert end["status"] == "succeeded", end
    late, late_own = queue.Queue(), {}
    service.command({"command": "subscribe", "executionId": "e"}, late.put, late_own)
    assert late.get()["status"] == "succeeded" and until(late, "subscribed")
    status, found = service.reply("POST", "/execution/recovery/open", {}, {"recoveryDirectory": where})
    assert status == 200 and found["graph"] == g and found["inspection"]["completed"] == 4
    ask = {"recoveryDirectory": where, "expectedExecutionId": "other"}
    assert service.reply("POST", "/execution/recovery/delete", {}, ask)[0] == 409
    ask["expectedExecutionId"] = found["inspection"]["executionId"]
    assert service.reply("POST", "/execution/recovery/delete", {}, ask)[0] == 200
    assert not (tmp_path / "run").exists() and (tmp_path / "out").exists()


def test_stop_and_reject(service, monkeypatch):
    begun, go = threading.Event(), threading.Event()

    class Result:
        def run(self, window):
            begun.set()
            go.wait(60)

    monkeypatch.setattr(recovery, "run_graph", lambda graph, config, compute: compute(Result(), None))
    inbox, own, other = queue.Queue(), {}, queue.Queue()
    service.command({"command": "stop_execution"}, other.put, {})
    assert other.get()["type"] == "error"
    service.command({"command": "execute_graph", "executionId": "a", "graph": {"x": {}}}, inbox.put, own)
    assert begun.wait(60)
    service.command({"command": "execute_graph", "graph": {"x": {}}}, other.put, {})
    assert other.get()["code"] == "TASK_ALREADY_RUNNING"
    service.command({"command": "stop_execution"}, inbox.put, own)
    go.set()
    assert until(inbox, "execution_control_ack")["action"] == "stopped"
    assert until(inbox, "execution_finished")["status"] == "cancelled"
    service.command({"command": "execute_graph"}, other.put, {})
    assert other.get()["type"] == "error"


def test_websocket(server):
    def connect(origin):
        link = socket.create_connection(server.server_address, timeout=60)
        host = "%s:%s" % server.server_address
        key = base64.b64encode(os.urandom(16)).decode()
        link.sendall(f"GET /ws/run HTTP/1.1\r\nHost: {host}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nOrigin: {origin or 'http://' + host}\r\n\r\n".encode())
        stream = link.makefile("rb")
        status = stream.readline().split()[1]
        while stream.readline().strip():
            pass
        return link, stream, status

    assert connect("http://elsewhere.example")[2] == b"403"
    link, stream, status = connect(None)
    assert status == b"101"

    def send(text):
        data = text.encode()
        head = bytes([0x81, 0x80 | len(data)]) if len(data) < 126 else struct.pack(">BBH", 0x81, 0x80 | 126, len(data))
        link.sendall(head + b"abcd" + bytes(b ^ b"abcd"[i & 3] for i, b in enumerate(data)))

    def receive():
        _, size = stream.read(2)
        size = struct.unpack(">H", stream.read(2))[0] if size == 126 else size
        return json.loads(stream.read(size))

    send('{"command": "ping"}')
    assert receive() == {"type": "pong"}
    send("no json")
    assert receive()["type"] == "error"
    send(json.dumps({"command": "subscribe", "executionId": "x" * 200}))
    assert receive()["type"] == "error"
    link.close()


def test_frames_of_all_sizes():
    for n in (0, 125, 126, 65535, 65536):
        raw = services.write_frame(2, b"x" * n)
        assert len(raw) == n + (2 if n < 126 else 4 if n < 65536 else 10)


def test_visible_inputs():
    seen = lambda mode: documents.visible_inputs("DaskRechunk", {"mode": mode})
    assert "chunks" in seen("explicit") and "axis_chunks" not in seen("explicit")
    assert "axis_chunks" in seen("axis_name") and "chunks" not in seen("axis_name")
    assert "reference_arr" in seen("match_reference")
    assert documents.visible_inputs("DaskRechunk", {}) == seen("explicit")


def test_saved_documents():
    drawn = {
        "nodes": [{"id": "r", "data": {"opType": "OMEZarrReader", "values": {"file_path": "/a.zarr"}, "runState": "done"}}, {"id": "c", "data": {"opType": "DaskROI", "values": {"start_x": 2}}}],
        "edges": [{"id": "e", "source": "r", "target": "c", "sourceHandle": "0", "targetHandle": "dask_arr"}],
    }
    flat = documents.parse_saved(drawn | {"name": "old"})
    assert flat.migrated and flat.document_id and flat.name == "old"
    assert flat.graph() == {"r": {"type": "OMEZarrReader", "inputs": {"file_path": "/a.zarr"}}, "c": {"type": "DaskROI", "inputs": {"start_x": 2, "dask_arr": ["r", 0]}}}
    again = documents.parse_saved(json.loads(json.dumps(flat.document())))
    assert not again.migrated and again.graph() == flat.graph() and "runState" not in json.dumps(again.document())
    assert documents.parse_saved({"graph": drawn}).graph() == flat.graph()
    assert documents.parse_saved({"nodes": 1}) is None and documents.parse_saved([]) is None


def test_settings():
    plan = {"windowable": True, "reason": None, "roots": ["z"], "outputShapes": {"z": [4, 4]}}
    good = {"mode": "window", "windowShape": [2, 2], "resumeAction": "resume", "newRunRecoveryLocation": {"mode": "output_sidecar", "anchorNodeId": "z"}}
    made = documents.decide_run({"executionSettings": good}, plan, {"mode": "full_graph"})
    assert made["kind"] == "execute" and made["config"].resume_action == "new" and made["config"].window_shape == [2, 2]
    assert documents.decide_run({}, plan, {"mode": "full_graph"})["config"].mode == "full_graph"
    assert documents.decide_run({}, plan)["kind"] == "open_settings"
    for change, where in (({"windowShape": [2]}, "windowShape"), ({"windowShape": [True, 2]}, "windowShape"), ({"maxInFlightWindows": 1.5}, "maxInFlightWindows"), ({"version": 2}, "version"), ({"mode": "x"}, "mode"), ({"newRunRecoveryLocation": None}, "newRunRecoveryLocation"), ({"newRunRecoveryLocation": {"mode": "custom", "directory": "a"}}, "directory"), ({"newRunRecoveryLocation": {"mode": "output_sidecar", "anchorNodeId": "q"}}, "anchorNodeId")):
        assert set(documents.decide_run({"executionSettings": good | change}, plan)["errors"]) == {where}
    assert documents.settings_errors(good, plan | {"windowable": False, "reason": "no"})["mode"] == "no"
