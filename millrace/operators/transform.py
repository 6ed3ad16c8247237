"""User functions over rows: by name from a registry, or by ``path.py:function``.

Three kinds are told apart by their mark: ``record`` (dict to dict, or None to drop the row), ``batch`` (a list of dicts to a list of
dicts, any number) and ``frame`` (DataFrame to DataFrame, which stays on the JVM). Records and batches run in Arrow batches
on the executors and need an output schema: given as DDL, declared at registration, or inferred from all rows, which runs the
function over them once more; a function that then returns other fields raises.
"""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Transform:
    name: str
    function: Callable
    kind: str = "record"
    schema: str = ""


_REGISTRY: dict[str, Transform] = {}


def register(name: str, kind: str = "record", schema: str = "") -> Callable[[Callable], Callable]:
    """Makes a function known under a name; returns it unchanged."""
    if kind not in ("record", "batch", "frame"):
        raise ValueError(f"unknown kind of transform: {kind}")

    def keep(f: Callable) -> Callable:
        _REGISTRY[name] = Transform(name, f, kind, schema)
        return f

    return keep


def has(name: str) -> bool:
    return name in _REGISTRY


def get(name: str) -> Transform:
    """A registered transform, or the function that an entry point ``path.py:function`` names."""
    if name in _REGISTRY:
        return _REGISTRY[name]
    path, colon, function = name.rpartition(":")
    if colon and path.endswith(".py"):
        short = f"{Path(path).stem}:{function}"
        if short in _REGISTRY:
            return _REGISTRY[short]
        if Path(path).is_file():
            spec = importlib.util.spec_from_file_location(f"millrace_user_{Path(path).stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            if name in _REGISTRY or short in _REGISTRY:
                return _REGISTRY.get(name) or _REGISTRY[short]
            if hasattr(module, function):
                return Transform(name, getattr(module, function))
    raise ValueError(f"unknown transform function: {name}")


def _run(t: Transform, rows: list[dict]) -> list[dict]:
    if t.kind == "batch":
        return list(t.function(rows))
    return [out for r in rows if (out := t.function(r)) is not None]


def _objects(body: str | None) -> list[dict]:
    try:
        value = json.loads(body or "null")
    except ValueError:
        return []
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def _schema(df: DataFrame, t: Transform, given: str) -> T.StructType:
    if given or t.schema:
        return T.StructType.fromDDL(given or t.schema)
    if df.isStreaming:
        raise ValueError(f"transform '{t.name}' needs function.schema on a stream")
    return inferred(df, t)


def inferred(df: DataFrame, t: Transform) -> T.StructType:
    """The schema of all rows that the function returns, in a pass of its own; no rows: that of ``df``.

    A task sends one small schema. Fields come in the order in which the partitions first show them, numbers widen, and a field of nulls only is text.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            rows = _run(t, batch.to_pylist())
            names = dict.fromkeys(k for r in rows for k in r)
            if names:
                here = pa.Table.from_pylist([{k: r.get(k) for k in names} for r in rows]).schema
                found = here if found is None else pa.unify_schemas([found, here], promote_options="permissive")
        if found is not None:
            yield pa.RecordBatch.from_pydict({"schema": [found.serialize().to_pybytes()]})

    from pyspark.sql.pandas.types import from_arrow_schema

    each = df.mapInArrow(look, "schema binary").withColumn("at", F.spark_partition_id())
    seen = each.groupBy("schema").agg(F.min("at").alias("at")).orderBy("at", "schema").collect()  # distinct schemas: as many as the data has kinds of rows
    if not seen:
        return df.schema
    try:
        whole = pa.unify_schemas([pa.ipc.read_schema(pa.py_buffer(r.schema)) for r in seen], promote_options="permissive")
    except pa.ArrowTypeError as e:
        raise ValueError(f"transform '{t.name}' returns a field of several types; declare function.schema: {e}") from e
    return from_arrow_schema(pa.schema([f.with_type(pa.string()) if pa.types.is_null(f.type) else f for f in whole]))


def transform(df: DataFrame, name: str, schema: str = "", row_preserving: bool = False, parallel: int = 1, bodies: bool = False) -> DataFrame:
    """Applies a transform. bodies: the records are the JSON objects in the column ``body``, or in arrays there; what is no object is left out. row_preserving: raises if a batch comes out with another number of rows."""
    t = get(name)
    if t.kind == "frame":
        return t.function(df)
    out = _schema(df, t, schema)
    columns = out.names
    known = None if schema or t.schema else set(columns)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            records = batch.to_pylist() if not bodies else [x for r in batch.to_pylist() for x in _objects(r["body"])]
            rows = _run(t, records)
            if row_preserving and len(rows) != len(records):
                raise ValueError(f"transform '{name}' must keep the number of rows: {len(records)} became {len(rows)}")
            if known is not None and (late := {k for r in rows for k in r if k not in known}):
                raise ValueError(f"transform '{name}' returned other fields than before: {sorted(late)}; declare function.schema")
            if rows:
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in columns} for r in rows], schema=arrow)

    if parallel > 1:
        df = df.repartition(parallel)
    return df.mapInArrow(read, out)
