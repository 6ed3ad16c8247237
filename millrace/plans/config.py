"""Settings of the engine that hold for all documents, and what a run reports to monitoring.

A file of settings has sections of ``name: value`` lines, or is a JSON object; names that begin with ``spark.`` go to the session. Sections:
engine (log_level), request_queue (db_path: where ledgers live; max_pending), backpressure (default_max_buffered, default_resume_at), retry
(max_attempts, base_ms, backoff). They are defaults: what a document says itself holds. Sections that Spark takes care of (threads,
executors, heartbeats) are read and have no effect.
"""

from __future__ import annotations

import json
from pathlib import Path

from millrace.plans.engine import Report

Config = dict[str, dict[str, str]]


def read_config(path: str) -> Config:
    """{section: {name: value}}; names outside a section are in the section ""."""
    text = Path(path).read_text(encoding="utf-8")
    out: Config = {"": {}}
    if text.lstrip().startswith("{"):
        for k, v in json.loads(text).items():
            if isinstance(v, dict):
                out[k] = {n: str(x) for n, x in v.items()}
            else:
                out[""][k] = str(v)
        return out
    section = ""
    for line in text.splitlines():
        bare = line.split(" #")[0] if not line.lstrip().startswith("#") else ""
        name, _, value = bare.strip().partition(":") if ":" in bare else bare.strip().partition(" ")
        if not name:
            continue
        if not bare[0].isspace():
            section = ""
        if value.strip():
            out.setdefault(section, {})[name.strip()] = value.strip()
        else:
            section = name.strip()
            out.setdefault(section, {})
    return out


def spark_settings(config: Config) -> dict[str, str]:
    return {k: v for section in config.values() for k, v in section.items() if k.startswith("spark.")}


def with_defaults(document: dict, config: Config) -> dict:
    """The document with what it leaves to the settings."""
    of = lambda section, **names: {k: config[section][n] for k, n in names.items() if n in config.get(section, {})}
    out = json.loads(json.dumps(document))
    retry = of("retry", max_attempts="max_attempts", base_ms="base_ms", backoff="backoff")
    if retry:
        out["error_handling"] = retry | (out.get("error_handling") or {})
    back, pending = of("backpressure", max_buffered_responses="default_max_buffered", resume_at="default_resume_at"), of("request_queue", max_pending="max_pending")
    connections = out.get("connections") or []
    for c in connections.values() if isinstance(connections, dict) else connections:
        if back and c.get("type", "http") == "http":
            c["backpressure"] = back | (c.get("backpressure") or {})
    for s in out.get("steps") or []:
        if pending and str(s.get("type", "")).lower() == "generate":
            s["request_queue"] = pending | (s.get("request_queue") or {})
    return out


def metrics(report: Report) -> str:
    """A run's figures in the text format of Prometheus, for a file that a node exporter collects."""
    label = json.dumps(report.dag_run_id)
    lines = ["# TYPE millrace_requests_total counter"]
    for status, n in (("done", report.successes), ("failed", report.failures), ("skipped", report.skipped)):
        lines.append(f'millrace_requests_total{{run={label},status="{status}"}} {n}')
    for name, kind, value in (("retries_total", "counter", report.retries), ("outputs", "gauge", len(report.outputs)), ("run_seconds", "gauge", round(report.elapsed_sec, 3)), ("run_success", "gauge", int(report.success))):
        lines += [f"# TYPE millrace_{name} {kind}", f"millrace_{name}{{run={label}}} {value}"]
    return "\n".join(lines) + "\n"
