"""Building pipeline documents in Python, step after step."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from millrace.plans import spec
from millrace.plans.parse import parse


class DAG:
    """DAG("name").source("api", path="/x").transform("m.py:f").filter("status", "eq", "done").sink("store", path="out/{date}.parquet")

    Each call adds a step that reads the one before, unless ``from_step`` names another; ``id`` names the step.
    """

    def __init__(self, name: str, version: str = "1.0"):
        self._root: dict[str, Any] = {"name": name, "version": version, "start_at": "", "connections": {}, "steps": []}
        self._last: str | None = None

    def connection(self, name: str, type: str = "http", **fields: Any) -> DAG:
        self._root["connections"][name] = {"type": type, **fields}
        return self

    def error_handling(self, max_attempts: int = 3, backoff: str = "exponential", base_ms: int = 1000) -> DAG:
        self._root["error_handling"] = {"retry": {"max_attempts": max_attempts, "backoff": backoff, "base_ms": base_ms}}
        return self

    def _add(self, kind: str, id: str | None, body: dict[str, Any], from_step: str | None = None, reads: bool = True) -> DAG:
        name = id or f"{kind}_{len(self._root['steps']) + 1}"
        step: dict[str, Any] = {"id": name, "type": kind}
        if reads:
            source = from_step or self._last
            if source is None and "input" not in body:
                raise ValueError(f"{kind} '{name}' has no step to read")
            body.setdefault("input", {"from_step": source})
        self._root["steps"].append(step | body)
        self._root["start_at"] = self._root["start_at"] or name
        self._last = name
        return self

    def source(self, connection: str, path: str = "", id: str | None = None, parameters: list[dict] | None = None, file: str | None = None, headers: dict | None = None, **fields: Any) -> DAG:
        """A generate step that fetches ``path`` of an http connection for each combination of parameters (or entry of ``file``, connection/path)."""
        body: dict[str, Any] = {"connection": connection, "template": {"method": fields.pop("method", "GET"), "path_template": path, "headers": headers or {}}, "parameters": parameters or [], **fields}
        if file is not None:
            where, _, at = file.partition("/")
            body["input"] = {"from_connection": where, "path": at}
        return self._add("generate", id, body, reads=False)

    def read(self, connection: str, path: str, id: str | None = None) -> DAG:
        """A file as the source: a filter without conditions on it."""
        return self._add("filter", id, {"condition": [], "input": {"from_connection": connection, "path": path}})

    def transform(self, entrypoint: str, id: str | None = None, from_step: str | None = None, schema: str = "", field: str | None = None, **fields: Any) -> DAG:
        body: dict[str, Any] = {"function": {"language": "python", "entrypoint": entrypoint, **({"schema": schema} if schema else {})}, **fields}
        if field:
            body["input"] = {"from_step": from_step or self._last, "field": field}
        return self._add("transform", id, body, from_step)

    def filter(self, field: str, op: str, value: Any = "", id: str | None = None, from_step: str | None = None, **fields: Any) -> DAG:
        """A condition; directly after another filter without a name of its own it joins that one's conditions."""
        condition = {"field": field, "op": op, **({} if op in ("is_null", "not_null") else {"value": value})}
        steps = self._root["steps"]
        if id is None and from_step is None and not fields and steps and steps[-1]["type"] == "filter" and steps[-1]["condition"]:
            steps[-1]["condition"].append(condition)
            return self
        return self._add("filter", id, {"condition": [condition], **fields}, from_step)

    def aggregate(self, group_by: list[str], aggs: list[dict[str, Any]], id: str | None = None, from_step: str | None = None, **fields: Any) -> DAG:
        return self._add("aggregate", id, {"group_by": group_by, "aggregates": aggs, **fields}, from_step)

    def unnest(self, field: str, array_column: str = "", drop_null: bool = True, id: str | None = None, from_step: str | None = None, **fields: Any) -> DAG:
        return self._add("unnest", id, {"unnest": {"field": field, "array_column": array_column, "drop_null": drop_null}, **fields}, from_step)

    def join(self, key: str, sources: list[str], join: str = "inner", timeout: str = "30s", on_timeout: str = "dead_letter", id: str | None = None, **fields: Any) -> DAG:
        config = {"key": key, "join": join, "timeout": timeout, "on_timeout": on_timeout}
        return self._add("join", id, {"join_config": config, "input": {"inputs": sources}, **fields})

    def sink(self, connection: str, path: str = "", format: str = "parquet", partition: str = "", id: str | None = None, from_step: str | None = None, **fields: Any) -> DAG:
        return self._add("sink", id, {"connection": connection, "output": {"path_template": path, "format": format, "partition": partition}, **fields}, from_step)

    def stub(self, reason: str, id: str | None = None) -> DAG:
        last = self._last
        self._add("stub", id, {"reason": reason}, reads=False)
        self._last = last
        return self

    def to_dict(self) -> dict[str, Any]:
        return json.loads(json.dumps(self._root))

    def to_json(self, path: str) -> None:
        Path(path).write_text(json.dumps(self._root, indent=2) + "\n", encoding="utf-8")

    def build(self) -> spec.Pipeline:
        return parse(self.to_dict())
