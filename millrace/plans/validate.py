"""Checks of a pipeline before anything runs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from millrace.operators.aggregate import FUNCS
from millrace.operators.filter import ALIASES, OPS
from millrace.operators.sink import FORMATS
from millrace.plans import spec
from millrace.plans.parse import PipelineError, seconds


@dataclass(frozen=True)
class Finding:
    field: str
    message: str
    severity: str = "error"


def order(p: spec.Pipeline) -> list[str]:
    """Steps so that each comes after those it needs, else in the order of the document; CycleError if there is none."""
    known = {s.id for s in p.steps}
    graph = TopologicalSorter({s.id: [u for u in s.upstream() if u in known] for s in p.steps})
    return list(graph.static_order())


def validate(p: spec.Pipeline) -> list[Finding]:
    """Errors and warnings; a pipeline without errors can be lowered."""
    out: list[Finding] = []
    ids = [s.id for s in p.steps]
    names = {c.name: c for c in p.connections}
    say = lambda where, what, how="error": out.append(Finding(where, what, how))

    for i in sorted({x for x in ids if ids.count(x) > 1}):
        say(f"steps.{i}", f"duplicate step id '{i}'")
    if p.start_at not in ids:
        say("start_at", f"start_at names no step: '{p.start_at}'")
    if len(names) < len(p.connections):
        say("connections", "duplicate connection name")
    if p.error_handling.max_attempts < 1:
        say("error_handling.max_attempts", "max_attempts must be at least 1")
    if p.error_handling.backoff not in ("exponential", "linear", "fixed"):
        say("error_handling.backoff", f"unknown backoff '{p.error_handling.backoff}'")
    for c in p.connections:
        if c.type == "stub":
            say(f"connections.{c.name}", f"stub connection: {c.reason or 'no reason given'}", "warning")
        if c.type == "http" and not c.base_url:
            say(f"connections.{c.name}.base_url", "an http connection without base_url", "warning")
        if c.rate_limit.max < 1 or c.rate_limit.window_sec <= 0:
            say(f"connections.{c.name}.rate_limit", "max and window_sec must be positive")
        if c.backpressure.resume_at > c.backpressure.max_buffered_responses:
            say(f"connections.{c.name}.backpressure", "resume_at exceeds max_buffered_responses")

    for s in p.steps:
        at = f"steps.{s.id or '?'}"
        if not s.id:
            say(at, "a step without id")
        for u in s.upstream():
            if u not in ids:
                say(f"{at}.input", f"step '{s.id}' refers to unknown step '{u}'")
            elif p.step(u).type == "stub":
                say(f"{at}.input", f"step '{s.id}' reads the stub '{u}', which passes nothing on", "warning")
        for name in filter(None, (s.connection, s.input.from_connection, s.request_queue.flush_policy.archive_connection)):
            if name not in names:
                say(f"{at}.connection", f"step '{s.id}' refers to unknown connection '{name}'")
        _check_type(p, s, at, say)

    try:
        order(p)
    except CycleError as e:
        say("steps", f"cycle: {' -> '.join(e.args[1])}")
    else:
        reached, todo = set(), [p.start_at]
        while todo:
            x = todo.pop()
            reached.add(x)
            todo += [s.id for s in p.steps if x in s.upstream() and s.id not in reached]
        for s in p.steps:
            if s.id not in reached and s.type != "stub":
                say(f"steps.{s.id}", f"step '{s.id}' isn't reached from start_at", "warning")
    return out


def _check_type(p: spec.Pipeline, s: spec.Step, at: str, say) -> None:
    has_input = bool(s.input.from_step or s.input.from_connection or s.input.inputs)
    if s.type in ("transform", "filter", "aggregate", "unnest", "sink") and not has_input:
        say(f"{at}.input", f"{s.type} needs an input")
    if s.type == "stub":
        say(at, f"stub: {s.reason or 'no reason given'}", "warning")
    elif s.type == "generate":
        if not s.connection:
            say(f"{at}.connection", "generate needs a connection")
        if not s.template.path_template:
            say(f"{at}.template.path_template", "generate needs a path_template")
        known = {q.name for q in s.parameters}
        free = set(re.findall(r"\{(\w+)\}", s.template.path_template)) - known
        if free and not (s.input.path and len(free) == 1):
            say(f"{at}.template.path_template", f"no parameter for {', '.join(sorted(free))}")
        for q in s.parameters:
            if not q.name:
                say(f"{at}.parameters", "a parameter without name")
            if q.source == "column" and not (q.from_step and q.field):
                say(f"{at}.parameters.{q.name}", "a column parameter needs from_step and field")
            if q.source == "range" and q.range_step == 0:
                say(f"{at}.parameters.{q.name}", "range_step must not be 0")
    elif s.type == "transform" and not s.function.entrypoint:
        say(f"{at}.function.entrypoint", "transform needs an entrypoint")
    elif s.type == "transform" and s.function.language != "python":
        say(f"{at}.function.language", f"unsupported language '{s.function.language}'")
    elif s.type == "filter":
        for c in s.conditions:
            if not c.field:
                say(f"{at}.condition", "a condition without field")
            if ALIASES.get(c.op, c.op) not in OPS:
                say(f"{at}.condition", f"unsupported op '{c.op}'")
    elif s.type == "aggregate":
        if not s.aggregates:
            say(f"{at}.aggregates", "aggregate needs aggregates")
        for a in s.aggregates:
            if a.func not in FUNCS:
                say(f"{at}.aggregates", f"unsupported aggregate func: {a.func}")
            if a.func == "percentile" and not 0 <= a.arg <= 100:
                say(f"{at}.aggregates", f"percentile arg must lie between 0 and 100: {a.arg}")
            if not a.name:
                say(f"{at}.aggregates", "an aggregate without name")
    elif s.type == "join":
        if len(s.input.inputs) < 2:
            say(f"{at}.input.inputs", "join needs at least two inputs")
        if not s.join.key:
            say(f"{at}.join_config.key", "join needs a key")
        try:
            seconds(s.join.timeout)
        except PipelineError as e:
            say(f"{at}.join_config.timeout", str(e))
    elif s.type == "unnest" and not s.unnest.field:
        say(f"{at}.unnest.field", "unnest needs a field")
    elif s.type == "sink":
        if not s.output.path_template:
            say(f"{at}.output.path_template", "sink needs a path_template")
        if s.output.format not in FORMATS:
            say(f"{at}.output.format", f"unsupported sink format: {s.output.format}")
        if not s.connection:
            say(f"{at}.connection", "sink needs a connection")
