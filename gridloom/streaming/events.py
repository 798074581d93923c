"""Execution events: JSON lines, the state machine, tails and streaming relays."""

from __future__ import annotations

import json
import os
import threading
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "sequence long, timestamp double, job_id string, type string, payload string"
TERMINAL = ("execution_finished", "execution_failed", "execution_cancelled")

# The states and what may follow each.
TRANSITIONS = {
    "running": {"cancelling", "interrupted", "failed", "succeeded"},
    "cancelling": {"cancelled", "failed"},
    "interrupted": set(),
    "failed": set(),
    "succeeded": set(),
    "cancelled": set(),
}


class EventWriter:
    """Appends events with a sequence from 1; terminal ones are synced to disk."""

    def __init__(self, path: str | Path, job_id: str):
        self.path, self.job_id, self.sequence, self.lock = Path(path), job_id, 0, threading.Lock()

    def write(self, kind: str, payload: dict) -> int:
        with self.lock, self.path.open("a") as f:
            self.sequence += 1
            event = {"sequence": self.sequence, "timestamp": time.time(), "job_id": self.job_id, "type": kind, "payload": json.dumps(payload, allow_nan=False)}
            f.write(json.dumps(event) + "\n")
            if kind in TERMINAL:
                f.flush()
                os.fsync(f.fileno())
            return self.sequence


class EventRelay:
    """Reads complete lines after a byte cursor; the cursor moves only after
    ``publish`` returned.  A corrupt line raises and is met again."""

    def __init__(self, path: str | Path, cursor_path: str | Path, job_id: str | None = None):
        self.path, self.cursor_path, self.job_id = Path(path), Path(cursor_path), job_id

    def cursor(self) -> tuple[int, int]:
        if not self.cursor_path.exists():
            return 0, 0
        saved = json.loads(self.cursor_path.read_text())
        return saved["offset"], saved["sequence"]

    def poll(self, publish) -> int:
        offset, last = self.cursor()
        n = 0
        with self.path.open("rb") as f:
            f.seek(offset)
            for line in f:
                if not line.endswith(b"\n"):
                    break
                event = json.loads(line)
                if not isinstance(event, dict):
                    raise ValueError("an event is no JSON object")
                if event["sequence"] <= last:
                    raise ValueError(f"sequence {event['sequence']} after {last}")
                if self.job_id is not None and event["job_id"] != self.job_id:
                    raise ValueError(f"event of another job {event['job_id']!r}")
                publish(event)
                offset, last, n = offset + len(line), event["sequence"], n + 1
                beside = self.cursor_path.with_name(self.cursor_path.name + ".tmp")
                beside.write_text(json.dumps({"offset": offset, "sequence": last}))
                os.replace(beside, self.cursor_path)
        return n


def stream_events(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Structured Streaming source over a folder of event files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)


def windowed_counts(events: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events by type and tumbling window, late ones dropped after a watermark."""
    timed = events.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "type").agg(F.count(F.lit(1)).alias("n"))


class Session:
    """One execution: status by the transition table, node states, a log ring."""

    def __init__(self, keep: int = 100):
        from collections import deque

        self.status, self.nodes, self.logs, self.progress = "running", {}, deque(maxlen=keep), None

    def move(self, status: str) -> None:
        if status not in TRANSITIONS[self.status]:
            raise ValueError(f"{self.status} cannot become {status}")
        self.status = status

    def apply(self, event: dict) -> None:
        kind, payload = event["type"], event.get("payload") or {}
        payload = json.loads(payload) if isinstance(payload, str) else payload
        if kind == "log":
            self.logs.append(payload)
        elif kind == "progress":
            self.nodes[payload["node"]] = payload["state"]
        elif kind == "window_progress":
            self.progress = normalise_progress(payload)
        elif kind == "execution_finished":
            self.move(payload["status"])

    def replay(self) -> list:
        """What a reconnecting reader gets: snapshot, logs, windows, nodes."""
        return [{"status": self.status}, *self.logs, *([self.progress] if self.progress else []), *({"node": k, "state": v} for k, v in self.nodes.items())]

    def summary(self) -> dict:
        return {"count": len(self.logs), "has_errors": any(x.get("level") in ("error", "warning") for x in self.logs)}


def normalise_progress(raw: dict) -> dict:
    """Bounded window progress; all windows done but not succeeded is finalizing."""
    total = max(0, int(raw.get("totalWindows") or 0))
    done = min(total, max(0, int(raw.get("completedWindows") or 0)))
    current = min(total, max(0, int(raw.get("currentWindow") or 0)))
    share = 100.0 if not total else 100.0 * done / total
    status = raw.get("windowStatus") or "running"
    return {"totalWindows": total, "completedWindows": done, "currentWindow": current, "progress": share, "windowStatus": "finalizing" if status == "running" and total and done == total else status}


def retained(sessions: DataFrame, now: float, ttl: float = 3600.0, keep: int = 10) -> DataFrame:
    """sessions(id, status, finished_at): unexpired ones, then ``keep`` of them,
    not failed before failed and newest first."""
    fresh = sessions.where(F.lit(now) - F.col("finished_at") <= ttl)
    return fresh.orderBy((F.col("status") == "failed").cast("int"), F.desc("finished_at"), "id").limit(keep)


def last_state(events: DataFrame, key: str, order: list[str], kind: str, error: str) -> DataFrame:
    """Per key: number of events, last type and whether an error type occurred."""
    last = F.max_by(F.col(kind), F.struct(*order))
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), last.alias("last_type"), F.bool_or(F.col(kind) == error).alias("has_error"))


def tail(events: DataFrame, key: str, order: list[str], n: int = 100) -> DataFrame:
    """The last ``n`` events of each key, numbered from the newest."""
    rank = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("back", F.row_number().over(rank)).where(F.col("back") <= n)


def sequence_breaks(events: DataFrame, key: str, order: list[str], sequence: str) -> DataFrame:
    """Per key: events and places where the sequence doesn't strictly increase."""
    before = F.lag(sequence).over(Window.partitionBy(key).orderBy(*order))
    marked = events.withColumn("__bad", (F.col(sequence) <= before).cast("int"))
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), F.coalesce(F.sum("__bad"), F.lit(0)).cast("long").alias("breaks"))
