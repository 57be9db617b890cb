"""The canonical manifest: the graph as JSON with the same bytes for any order of declaration, and no traces of the environment."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from .analysis import Plan
from .model import AutoCdc

VERSION = 1


def manifest(plan: Plan) -> str:
    flows: list[dict[str, Any]] = []
    for f in plan.pipeline.flows:
        entry: dict[str, Any] = {"name": f.name, "target": f.target, "once": f.once, "reads": [{"name": n, "streaming": s} for n, s in sorted(plan.reads[f.name])]}
        if isinstance(f, AutoCdc):
            entry["auto_cdc"] = {"source": f.source, "keys": list(f.keys), "sequence_by": f.sequence_by, "apply_as_deletes": f.apply_as_deletes, "apply_as_truncates": f.apply_as_truncates, "columns": None if f.columns is None else list(f.columns), "except_columns": list(f.except_columns), "ignore_null_updates": f.ignore_null_updates if isinstance(f.ignore_null_updates, bool) else list(f.ignore_null_updates), "scd_type": 1}
        elif f.sql is not None:
            entry["sql"] = f.sql
        flows.append(entry)
    nodes = [{"name": d.name, "kind": d.kind.value, "format": d.format, "schema": json.loads(plan.schemas[d.name].json()) if d.name in plan.schemas else None} for d in plan.pipeline.datasets]
    body = {
        "version": VERSION,
        "nodes": sorted(nodes, key=lambda x: x["name"]),
        "edges": [list(e) for e in plan.edges()],
        "flows": sorted(flows, key=lambda x: (x["target"], x["name"])),
    }
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"


def parse(text: str) -> dict[str, Any]:
    body = json.loads(text)
    if body.get("version") != VERSION:
        raise ValueError(f"manifest version {body.get('version')!r}; this reads {VERSION}")
    return body


def render(body: dict[str, Any]) -> str:
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
