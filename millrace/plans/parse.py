"""Reading pipeline documents: JSON text to ``spec.Pipeline``."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from pathlib import Path

from millrace.plans import spec


class PipelineError(ValueError):
    """A document that can't be read."""


_VARIABLE = re.compile(r"\$\{([^}:]*)(?::-([^}]*))?\}")
_DURATION = re.compile(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|sec|m|min|h|d)?\s*")
_UNITS = {"ms": 0.001, None: 1, "s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "d": 86_400}


def substitute(text: str, env: Mapping[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default}; an empty variable counts as not set, one without default becomes an empty text."""
    env = os.environ if env is None else env
    return _VARIABLE.sub(lambda m: env.get(m[1]) or (m[2] or ""), text)


def seconds(text: str | float) -> float:
    """A duration such as 30s, 500ms or 2m in seconds."""
    m = _DURATION.fullmatch(str(text))
    if m is None:
        raise PipelineError(f"Bad duration: '{text}'")
    return float(m[1]) * _UNITS[m[2]]


class _Reader:
    """The scalars of one JSON object, coerced as the document may write them."""

    def __init__(self, obj: Mapping, env: Mapping[str, str] | None):
        self.obj, self.env = obj, env

    def sub(self, *names: str) -> _Reader | None:
        return next((_Reader(self.obj[n], self.env) for n in names if isinstance(self.obj.get(n), dict)), None)

    def items(self, *names: str) -> list:
        return next((self.obj[n] for n in names if isinstance(self.obj.get(n), list)), [])

    def has(self, name: str) -> bool:
        return self.obj.get(name) is not None

    def scalar(self, v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (dict, list)):
            return json.dumps(v)
        return "" if v is None else substitute(v, self.env) if isinstance(v, str) else repr(v)

    def text(self, name: str, default: str = "") -> str:
        return self.scalar(self.obj[name]) if self.has(name) else default

    def maybe(self, name: str) -> str | None:
        return self.text(name) if self.has(name) else None

    def texts(self, *names: str) -> tuple[str, ...]:
        return tuple(self.scalar(v) for v in self.items(*names))

    def number(self, name: str, default: float, kind: Callable = float):
        if not self.has(name):
            return default
        v = self.obj[name]
        try:
            return kind(float(substitute(v, self.env))) if isinstance(v, str) else kind(v)
        except (TypeError, ValueError):
            return default

    def whole(self, name: str, default: int) -> int:
        return self.number(name, default, int)

    def flag(self, name: str, default: bool) -> bool:
        v = self.obj.get(name)
        if v is None:
            return default
        return substitute(v, self.env) in ("true", "1") if isinstance(v, str) else bool(v)


def _one_of(value: str, known: tuple[str, ...], what: str) -> str:
    if value.lower() not in known:
        raise PipelineError(f"Unknown {what}: '{value}'")
    return value.lower()


def _connection(name: str, r: _Reader) -> spec.Connection:
    rate, back, auth = r.sub("rate_limit"), r.sub("backpressure"), r.sub("auth")
    return spec.Connection(
        name=name,
        type=_one_of(r.text("type", "http"), spec.CONNECTION_TYPES, "connection type"),
        base_url=r.text("base_url"),
        rate_limit=spec.RateLimit(rate.whole("max", 10), rate.number("window_sec", 1.0)) if rate else spec.RateLimit(),
        max_inflight=r.whole("max_inflight", 10),
        backpressure=spec.Backpressure(back.whole("max_buffered_responses", 1000), back.whole("resume_at", 500)) if back else spec.Backpressure(),
        auth=spec.Auth(auth.text("type"), auth.text("token_from"), auth.text("username"), auth.text("password")) if auth else spec.Auth(),
        timeout_ms=r.whole("timeout_ms", 30_000),
        fail_on_status=tuple(int(v) for v in r.items("fail_on_status")),
        **{k: r.text(k) for k in ("endpoint", "bucket", "access_key", "secret_key", "prefix", "root", "reason")},
    )


def _parameter(r: _Reader) -> spec.Parameter:
    return spec.Parameter(
        name=r.text("name"), source=_one_of(r.text("source", "literal"), spec.PARAMETER_SOURCES, "parameter source"), value=r.text("value"), values=r.texts("values"),
        range_start=r.whole("range_start", 0), range_end=r.whole("range_end", 0), range_step=r.whole("range_step", 1), from_step=r.maybe("from_step"), field=r.maybe("field"),
    )


def _flush(r: _Reader | None) -> spec.FlushPolicy:
    if r is None:
        return spec.FlushPolicy()
    trigger, _, amount = r.text("trigger", "batch_complete").partition(":")
    policy = {"buffer_size": r.whole("buffer_size", 1000), "interval_sec": r.whole("interval_sec", 60)}
    trigger = _one_of(trigger, spec.FLUSH_TRIGGERS, "flush trigger")
    if amount and trigger == "buffer_size":
        policy["buffer_size"] = int(amount)
    if amount and trigger == "interval":
        policy["interval_sec"] = int(seconds(amount))
    return spec.FlushPolicy(trigger=trigger, archive_connection=r.text("archive_connection"), archive_format=r.text("archive_format", "json.gz"), retention_days=r.whole("retention_days", 14), keep_failed=r.flag("keep_failed", True), **policy)


def _step(r: _Reader) -> spec.Step:
    inp, template, queue, function = r.sub("input"), r.sub("template", "template_"), r.sub("request_queue"), r.sub("function")
    headers = template.sub("headers") if template else None
    join, unnest, output = r.sub("join_config"), r.sub("unnest"), r.sub("output")
    flat = _Reader({k: r.obj[k] for k in ("key", "join", "timeout", "on_timeout") if k in r.obj}, r.env)
    join = join or (flat if flat.obj else None)
    conditions = [_Reader(c, r.env) for c in r.items("condition", "conditions")]
    aggregates = [_Reader(a, r.env) for a in r.items("aggregates")]
    inputs = inp.texts("inputs") if inp else ()
    return spec.Step(
        id=r.text("id"),
        type=_one_of(r.text("type", "stub"), spec.STEP_TYPES, "step type"),
        description=r.text("description"),
        connection=r.text("connection"),
        input=spec.StepInput(inp.maybe("from_step"), inp.maybe("from_connection"), inp.maybe("path"), inputs, inp.maybe("field")) if inp else spec.StepInput(inputs=r.texts("inputs")),
        parameters=tuple(_parameter(_Reader(p, r.env)) for p in r.items("parameters")),
        parallel=r.whole("parallel", 1),
        template=spec.RequestTemplate(template.text("method", "GET"), template.text("path_template"), headers.text("Accept", "application/json") if headers else "application/json", (headers.text("X-Request-Tag") or headers.text("XRequestTag")) if headers else "") if template else spec.RequestTemplate(),
        request_queue=spec.RequestQueue(queue.flag("durable", True), queue.text("storage"), queue.whole("max_pending", 10_000), _flush(queue.sub("flush_policy"))) if queue else spec.RequestQueue(),
        function=spec.Function(function.text("language", "python"), function.text("entrypoint"), function.text("schema"), function.flag("row_preserving", False)) if function else spec.Function(),
        conditions=tuple(spec.Condition(c.text("field"), c.text("op"), c.text("value")) for c in conditions),
        group_by=r.texts("group_by"),
        aggregates=tuple(spec.Aggregate(a.text("name"), a.text("field"), a.text("func"), a.number("arg", 0.0)) for a in aggregates),
        preserve_key_types=r.flag("preserve_key_types", False),
        join=spec.JoinConfig(join.text("key"), _one_of(join.text("join", "inner"), spec.JOIN_KINDS, "join type"), join.text("timeout", "30s"), _one_of(join.text("on_timeout", "dead_letter"), spec.ON_TIMEOUT, "on_timeout")) if join else spec.JoinConfig(),
        unnest=spec.Unnest(unnest.text("field"), unnest.text("array_column"), unnest.flag("drop_null", True)) if unnest else spec.Unnest(),
        output=spec.Output(output.text("path_template"), output.text("format", "parquet"), output.text("partition")) if output else spec.Output(),
        reason=r.text("reason"),
    )


def parse(text: str | dict, env: Mapping[str, str] | None = None) -> spec.Pipeline:
    """The pipeline that a document describes; PipelineError if it can't be read."""
    try:
        root = json.loads(text) if isinstance(text, str) else text
    except ValueError as e:
        raise PipelineError(f"JSON parse error: {e}") from e
    if not isinstance(root, dict):
        raise PipelineError(f"DAG must be a JSON object, got: {'null' if root is None else 'non-object'}")
    r = _Reader(root, env)
    for name in ("name", "start_at"):
        if not r.text(name):
            raise PipelineError(f"DAG missing required field: '{name}'")
    found = root.get("connections")
    named = found.items() if isinstance(found, dict) else [(c.get("name", ""), c) for c in found or [] if isinstance(c, dict)]
    connections = tuple(_connection(n, _Reader(c, env)) for n, c in named)
    steps = tuple(_step(_Reader(s, env)) for s in r.items("steps") if isinstance(s, dict))
    if not steps:
        raise PipelineError("DAG missing required field: 'steps' must be a non-empty array")
    eh = r.sub("error_handling")
    eh = (eh.sub("retry") or eh) if eh else None
    handling = spec.ErrorHandling(eh.whole("max_attempts", 3), eh.text("backoff", "exponential"), eh.whole("base_ms", 1000)) if eh else spec.ErrorHandling()
    return spec.Pipeline(r.text("name"), r.text("start_at"), steps, r.text("version"), handling, connections)


def parse_file(path: str, env: Mapping[str, str] | None = None) -> spec.Pipeline:
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise PipelineError(f"Cannot open file: {path}") from e
    return parse(text, env)
