"""A thin control service over the planner: HTTP requests and WebSocket commands.

Only the driver is involved; the work itself is Spark jobs.  One execution is active
at a time, each in its own thread and job group, so that stopping it cancels its jobs.
The service has no login: bind it to a trusted interface.  Browsers of other origins
are refused (JSON content type for HTTP, the Origin header for WebSockets).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from gridloom.plans import graph as graphs
from gridloom.plans import recovery
from gridloom.sources.documents import list_directories, read_object
from gridloom.streaming.events import Session

MAX_BODY = 16 << 20
#: Fixed value: the handshake constant of the WebSocket protocol.
WS_GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


class Cancelled(KeyboardInterrupt):
    """Raised inside a run that was stopped; the run record says cancelled."""


class Executions:
    """Runs, their sessions and who listens to them."""

    def __init__(self, spark: SparkSession, keep: int = 10):
        self.spark, self.keep, self.lock = spark, keep, threading.Lock()
        self.sessions: dict[str, Session] = {}
        self.listeners: dict[str, list[Callable[[dict], None]]] = {}
        self.threads: dict[str, threading.Thread] = {}

    def active(self) -> str | None:
        return next((k for k, s in self.sessions.items() if s.status in ("running", "cancelling")), None)

    def tell(self, key: str, message: dict) -> None:
        for send in list(self.listeners.get(key, [])):
            try:
                send(message)
            except OSError:  # a reader went away; the run goes on
                self.listeners[key].remove(send)

    def subscribe(self, key: str, send: Callable[[dict], None]) -> None:
        """History first, then what is new."""
        if key not in self.sessions:
            raise KeyError(f"no execution {key!r}")
        for message in self.sessions[key].replay():
            send({"type": "history", "executionId": key} | message)
        self.listeners.setdefault(key, []).append(send)

    def start(self, graph: dict | None, config: recovery.ExecutionConfig, key: str, send: Callable[[dict], None]) -> None:
        with self.lock:
            busy = self.active()
            if busy is not None:
                raise RuntimeError(f"execution {busy} is running")
            for old in list(self.sessions)[: max(0, len(self.sessions) + 1 - self.keep)]:
                del self.sessions[old], self.threads[old]
                self.listeners.pop(old, None)
            self.sessions[key] = Session()
            self.listeners[key] = [send]
            self.threads[key] = threading.Thread(target=self._run, args=(key, graph, config), daemon=True)
        send({"type": "execution_started", "executionId": key})
        self.threads[key].start()

    def stop(self, key: str) -> None:
        with self.lock:
            self.sessions[key].move("cancelling")
        self.spark.sparkContext.cancelJobGroup(key)

    def _run(self, key: str, graph: dict | None, config: recovery.ExecutionConfig) -> None:
        session, context = self.sessions[key], self.spark.sparkContext

        def compute(result, window):
            context.setJobGroup(key, "graph execution")  # windows have threads of their own
            try:
                if session.status != "cancelling":
                    result.run(window)
            except Exception:  # of a cancelled job, else of the run itself
                if session.status != "cancelling":
                    raise
            if session.status == "cancelling":
                raise Cancelled
            if window is not None:
                self.tell(key, {"type": "window_done", "executionId": key, "window": list(window.starts)})

        try:
            context.setJobGroup(key, "graph execution")
            recovery.run_graph(graph, config, compute)
            end, text = "succeeded", ""
        except BaseException as problem:  # the thread's end is reported, not raised
            end, text = "failed", str(problem)
        with self.lock:
            if session.status == "cancelling":
                end = "cancelled"
            session.move(end)
        if text and end == "failed":
            session.logs.append({"level": "error", "message": text})
        self.tell(key, {"type": "execution_finished", "executionId": key, "status": end, "message": text})


class Service:
    """Requests and commands, free of any transport."""

    def __init__(self, spark: SparkSession, plugins: str | None = None, hot_reload: bool = False):
        self.spark, self.plugins, self.hot_reload = spark, plugins, hot_reload
        self.runs = Executions(spark)
        self.reloading = threading.Lock()

    def reply(self, method: str, path: str, query: dict, body) -> tuple[int, object]:
        """(status, JSON)"""
        routes = {
            ("GET", "/object_info"): lambda: graphs.describe_nodes(),
            ("GET", "/plugin_status"): lambda: graphs.REPORT,
            ("GET", "/dashboard_url"): lambda: {"dashboard_url": self.spark.sparkContext.uiWebUrl},
            ("GET", "/filesystem/directories"): lambda: list_directories(query.get("path") or str(Path.home())),
            ("POST", "/execution/preflight"): lambda: self._preflight(body),
            ("POST", "/execution/recovery/inspect"): lambda: recovery.inspect(self._directory(body)),
            ("POST", "/execution/recovery/open"): lambda: self._open(body),
            ("POST", "/execution/recovery/delete"): lambda: self._delete(body),
            ("POST", "/reload_nodes"): lambda: self._reload(),
        }
        route = routes.get((method, path))
        if route is None:
            return 404, {"code": "NO_ROUTE", "message": f"{method} {path}"}
        try:
            made = route()
            return made if isinstance(made, tuple) else (200, made)
        except PermissionError:
            return 403, {"code": "DIRECTORY_ACCESS_FAILED", "message": "the directory cannot be accessed"}
        except (FileNotFoundError, NotADirectoryError) as problem:
            return 404, {"code": "RECOVERY_NOT_FOUND", "message": str(problem)}
        except RuntimeError as problem:
            return 409, {"code": "RECOVERY_ACTIVE", "message": str(problem)}
        except (ValueError, KeyError, TypeError) as problem:
            return 400, {"code": "BAD_REQUEST", "message": str(problem), "windowable": False}

    def _preflight(self, body):
        graph = body.get("graph")
        if not isinstance(graph, dict):
            raise ValueError("a preflight needs a graph")
        config = body.get("executionConfig") or {}
        return recovery.preflight(graph, config.get("windowShape") or body.get("windowShape"))

    @staticmethod
    def _directory(body) -> str:
        where = body.get("recoveryDirectory")
        if not isinstance(where, str) or not Path(where).is_absolute():
            raise ValueError("recoveryDirectory must be an absolute path")
        return where

    def _open(self, body):
        where = Path(self._directory(body))
        found = recovery.inspect(where)
        return {"inspection": found, "graph": read_object(where / recovery.GRAPH), "executionConfig": read_object(where / recovery.CONFIG)}

    def _delete(self, body):
        where, expected = self._directory(body), body.get("expectedExecutionId")
        if expected is not None and recovery.manifest_of(Path(where))["executionId"] != expected:
            return 409, {"code": "RECOVERY_CHANGED", "message": "the record belongs to another execution"}
        recovery.delete_record(where)
        return {"deleted": True, "recoveryDirectory": where}

    def _reload(self):
        if not self.hot_reload or self.plugins is None:
            return 403, {"ok": False, "code": "HOT_RELOAD_DISABLED"}
        if self.runs.active():
            return 409, {"ok": False, "code": "EXECUTION_ACTIVE"}
        if not self.reloading.acquire(blocking=False):
            return 409, {"ok": False, "code": "RELOAD_IN_PROGRESS"}
        try:
            graphs.REPORT["failed_imports"].clear()
            report = graphs.reload_plugins(self.plugins)
            failed = report["failed_imports"]
            return (500 if failed else 200), {"ok": not failed, "plugin_status": report, "object_info": graphs.describe_nodes()}
        finally:
            self.reloading.release()

    def command(self, message: dict, send: Callable[[dict], None], own: dict) -> None:
        """One command of a connection; ``own["id"]`` is the execution it follows."""
        kind = message.get("command")
        if kind == "ping":
            send({"type": "pong"})
        elif kind == "execute_graph":
            self._execute(message, send, own)
        elif kind == "subscribe":
            try:
                self.runs.subscribe(str(message.get("executionId")), send)
                own["id"] = str(message["executionId"])
                send({"type": "subscribed", "executionId": own["id"]})
            except KeyError as problem:
                send({"type": "error", "message": str(problem)})
        elif kind == "stop_execution":
            try:
                self.runs.stop(own["id"])
                self.runs.tell(own["id"], {"type": "execution_control_ack", "executionId": own["id"], "action": "stopped"})
            except (KeyError, ValueError):
                send({"type": "error", "message": "no active execution to stop"})
        elif kind != "pong":
            send({"type": "error", "message": f"unknown command {kind!r}"})

    def _execute(self, message: dict, send, own: dict) -> None:
        try:
            config = recovery.ExecutionConfig.parse(message.get("executionConfig") or {})
            graph = message.get("graph")
            saved = config.mode == "window" and config.resume_action != "new" and config.recovery_location.get("mode") == "custom"
            if not (isinstance(graph, dict) and graph) and not saved:
                raise ValueError("an execution needs a graph")
        except (ValueError, TypeError, AttributeError) as problem:
            send({"type": "error", "message": str(problem)})
            return
        key = str(message.get("executionId") or uuid.uuid4().hex)
        own["id"] = key
        if key in self.runs.sessions and self.runs.active() == key:
            self.runs.subscribe(key, send)  # asked again for a run that goes on
            send({"type": "subscribed", "executionId": key})
            return
        try:
            self.runs.start(graph or None, config, key, send)
        except RuntimeError as problem:
            send({"type": "execution_rejected", "status": "rejected", "code": "TASK_ALREADY_RUNNING", "message": str(problem)})


def read_frame(stream) -> tuple[int, bytes] | None:
    """(opcode, payload) of one unfragmented client frame; None at the end."""
    head = stream.read(2)
    if len(head) < 2:
        return None
    if not head[0] & 0x80 or not head[1] & 0x80:
        raise ValueError("fragmented and unmasked frames are refused")
    size = head[1] & 0x7F
    if size > 125:
        size = struct.unpack(">H" if size == 126 else ">Q", stream.read(2 if size == 126 else 8))[0]
    if size > MAX_BODY:
        raise ValueError("frame too large")
    mask = stream.read(4)
    data = stream.read(size)
    return head[0] & 0x0F, bytes(b ^ mask[i & 3] for i, b in enumerate(data))


def write_frame(opcode: int, payload: bytes) -> bytes:
    size = len(payload)
    head = bytes([0x80 | opcode])
    if size < 126:
        return head + bytes([size]) + payload
    return head + (struct.pack(">BH", 126, size) if size < 1 << 16 else struct.pack(">BQ", 127, size)) + payload


def make_server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server to ``serve_forever``; /ws/run speaks WebSocket."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_): ...

        def _send(self, status: int, payload) -> None:
            data = json.dumps(payload, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            url = urlparse(self.path)
            if url.path == "/ws/run" and "websocket" in self.headers.get("Upgrade", "").lower():
                return self._socket()
            self._send(*service.reply("GET", url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, None))

        def do_POST(self):
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY or not self.headers.get("Content-Type", "").startswith("application/json"):
                self.close_connection = True
                return self._send(400, {"code": "BAD_REQUEST", "message": "a JSON body is needed"})
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("the body must be an object")
            except ValueError as problem:
                return self._send(400, {"code": "BAD_REQUEST", "message": str(problem)})
            self._send(*service.reply("POST", urlparse(self.path).path, {}, body))

        def _socket(self):
            self.close_connection = True
            origin, key = self.headers.get("Origin"), self.headers.get("Sec-WebSocket-Key", "")
            if origin and urlparse(origin).netloc != self.headers.get("Host"):
                return self._send(403, {"code": "ORIGIN", "message": "origin is not allowed"})
            accept = base64.b64encode(hashlib.sha1((key + WS_GUID).encode()).digest()).decode()
            self.send_response(101)
            for name, value in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", accept)):
                self.send_header(name, value)
            self.end_headers()
            writing, own = threading.Lock(), {}

            def put(opcode: int, payload: bytes) -> None:
                with writing:
                    self.wfile.write(write_frame(opcode, payload))
                    self.wfile.flush()

            def send(message: dict) -> None:
                put(1, json.dumps(message, default=str).encode())

            while (frame := read_frame(self.rfile)) is not None:
                opcode, data = frame
                if opcode == 8:
                    return put(8, data[:2])
                if opcode == 9:
                    put(10, data)
                elif opcode == 1:
                    try:
                        message = json.loads(data)
                        if not isinstance(message, dict):
                            raise ValueError("a command is an object")
                    except ValueError as problem:
                        send({"type": "error", "message": str(problem)})
                        continue
                    service.command(message, send, own)

    return ThreadingHTTPServer((host, port), Handler)
