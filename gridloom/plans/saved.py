"""Saved graph documents, run settings and input visibility (driver side).

A document holds a drawn graph: nodes with a type and values, edges between numbered
outputs and named inputs, metadata that may carry run settings, and an id: the text
under its one top-level key that ends in ``Id``.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from gridloom.plans.graph import NODES
from gridloom.plans.recovery import ExecutionConfig

SETTINGS_VERSION = 1
ID_KEY = "documentId"


def visible_inputs(node_type: str, values: dict) -> set[str]:
    """Inputs whose ``visible_when`` holds on the values with defaults applied:
    each named input equals the wanted value, or one of a list of them."""
    declared = NODES[node_type].INPUTS
    now = {n: m["default"] if "default" in m else t[0] for n, (t, m) in declared.items() if "default" in m or isinstance(t, list)} | values

    def holds(rule: dict) -> bool:
        return all(now.get(n) in want if isinstance(want, list) else now.get(n) == want for n, want in rule.items())

    return {n for n, (_, m) in declared.items() if holds(m.get("visible_when") or {})}


@dataclass
class SavedGraph:
    document_id: str
    nodes: list[dict]
    edges: list[dict]
    metadata: dict = field(default_factory=dict)
    name: str | None = None
    migrated: bool = False  # the document had no id; it got one here
    id_key: str = ID_KEY  # as the document has it

    def document(self) -> dict:
        """What is stored: structure and values, no state of a run."""
        nodes = [{"id": n["id"], "type": n["type"], "position": n["position"], "data": {"opType": n["op"], "values": n["values"]}} for n in self.nodes]
        out = {self.id_key: self.document_id, "metadata": self.metadata, "nodes": nodes, "edges": self.edges}
        return out | ({} if self.name is None else {"name": self.name})

    def graph(self) -> dict:
        """The executable graph; an edge replaces the literal of its input."""
        out = {n["id"]: {"type": n["op"], "inputs": dict(n["values"])} for n in self.nodes}
        for e in self.edges:
            if e["target"] in out and e["targetHandle"]:
                out[e["target"]]["inputs"][e["targetHandle"]] = [e["source"], int(e["sourceHandle"] or 0)]
        return out


def parse_saved(raw) -> SavedGraph | None:
    """Flat documents, and older ones with nodes and edges under ``graph``; None if
    neither.  A missing id is made once and reported as migrated."""
    if not isinstance(raw, dict):
        return None
    inner = raw.get("graph")
    drawn = inner if isinstance(inner, dict) and isinstance(inner.get("nodes"), list) else raw
    if not isinstance(drawn.get("nodes"), list):
        return None
    nodes = []
    for n in drawn["nodes"]:
        if isinstance(n, dict):
            data, at = n.get("data") or {}, n.get("position") or {}
            nodes.append({"id": str(n.get("id", "")), "type": str(n.get("type", "dynamic")), "position": {"x": at.get("x", 0), "y": at.get("y", 0)}, "op": str(data.get("opType", "")), "values": dict(data.get("values") or {})})
    found = drawn.get("edges") if isinstance(drawn.get("edges"), list) else []
    edges = [{"id": str(e.get("id", "")), "source": str(e.get("source", "")), "target": str(e.get("target", "")), "sourceHandle": e.get("sourceHandle"), "targetHandle": e.get("targetHandle"), "type": e.get("type")} for e in found if isinstance(e, dict)]
    key = next((k for k in raw if isinstance(k, str) and k.endswith("Id")), ID_KEY)
    own = raw[key].strip() if isinstance(raw.get(key), str) else ""
    metadata = raw.get("metadata") if isinstance(raw.get("metadata"), dict) else {}
    name = next((raw[k] for k in sorted(raw, reverse=True) if (k == "name" or k.endswith("_name")) and isinstance(raw[k], str)), None)
    return SavedGraph(own or uuid.uuid4().hex, nodes, edges, dict(metadata), name, not own, key)


def settings_errors(settings: dict, plan: dict | None = None) -> dict[str, str]:
    """Field -> what is wrong.  ``plan`` is a preflight: rank, anchors, windowability."""
    bad: dict[str, str] = {}
    if settings.get("version", SETTINGS_VERSION) != SETTINGS_VERSION:
        bad["version"] = "unsupported version"
    mode = settings.get("mode", "full_graph")
    if mode not in ("full_graph", "window"):
        bad["mode"] = f"unknown mode {mode!r}"
    if mode != "window":
        return bad
    if plan is not None and not plan["windowable"]:
        bad["mode"] = plan["reason"]
    shape = settings.get("windowShape")
    if not isinstance(shape, list) or not shape or any(type(w) is not int or w <= 0 for w in shape):
        bad["windowShape"] = "window sizes must be positive integers"
    elif plan is not None and plan["outputShapes"] and len(shape) != len(next(iter(plan["outputShapes"].values()))):
        bad["windowShape"] = "a window needs a size for every axis of the output"
    k = settings.get("maxInFlightWindows")
    if k is not None and (type(k) is not int or k <= 0):
        bad["maxInFlightWindows"] = "must be a positive integer"
    place = settings.get("newRunRecoveryLocation")
    kind = place.get("mode") if isinstance(place, dict) else None
    if kind == "output_sidecar":
        anchor = place.get("anchorNodeId")
        if not anchor or (plan is not None and anchor not in plan["roots"]):
            bad["anchorNodeId"] = "is no output of the graph"
    elif kind == "custom":
        if not os.path.isabs(str(place.get("directory") or "")):
            bad["directory"] = "must be an absolute path"
    else:
        bad["newRunRecoveryLocation"] = "window execution needs a recovery location"
    return bad


def resolve_settings(metadata: dict, local: dict | None = None) -> tuple[dict, str]:
    """(settings, source): the document's own before local ones before the default."""
    for found, source in ((metadata.get("executionSettings"), "metadata"), (local, "local")):
        if isinstance(found, dict):
            return found, source
    return {"version": SETTINGS_VERSION, "mode": "full_graph"}, "default"


def new_run_config(settings: dict, plan: dict | None = None) -> ExecutionConfig:
    """The configuration of a new run; settings can't ask for resume or restart."""
    bad = settings_errors(settings, plan)
    if bad:
        raise ValueError("; ".join(f"{k}: {v}" for k, v in bad.items()))
    if settings.get("mode", "full_graph") == "full_graph":
        return ExecutionConfig()
    return ExecutionConfig.parse({"mode": "window", "windowShape": settings["windowShape"], "maxInFlightWindows": settings.get("maxInFlightWindows"), "recoveryLocation": settings["newRunRecoveryLocation"]})


def decide_run(metadata: dict, plan: dict, local: dict | None = None) -> dict:
    """{"kind": "execute", "config"} or {"kind": "open_settings", "errors"}."""
    settings, source = resolve_settings(metadata, local)
    if source == "default":
        return {"kind": "open_settings", "errors": {"settings": "choose run settings first"}}
    bad = settings_errors(settings, plan)
    return {"kind": "open_settings", "errors": bad} if bad else {"kind": "execute", "config": new_run_config(settings, plan)}
