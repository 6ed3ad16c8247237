"""Queries over requests and their responses: documents run against a server of this process, and SQL that gives the same rows."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.session import scratch
from millrace.operators import generate
from millrace.plans import samples  # noqa: F401
from millrace.plans.engine import Lowering
from millrace.plans.parse import parse
from millrace.sources.ledger import Ledger
from millrace.sources.tables import table


class Loopback:
    """A server that answers /item/<key> with the key and its square, after ``failures`` answers of 503 for each path."""

    def __init__(self, failures: int = 0, delay: float = 0.0):
        self.seen: Counter = Counter()
        self.times: list[float] = []
        lock, outer = threading.Lock(), self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                with lock:
                    outer.times.append(time.monotonic())
                    outer.seen[self.path] += 1
                    late = outer.seen[self.path] <= failures
                time.sleep(delay)
                key = int(self.path.rpartition("/")[2])
                body = b"later" if late else json.dumps({"key": key, "square": key * key}).encode()
                self.send_response(503 if late else 200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args) -> None:
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.http.daemon_threads = True
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"

    def __enter__(self) -> Loopback:
        return self

    def __exit__(self, *args) -> None:
        self.http.shutdown()
        self.http.server_close()


def _document(url: str, rate: int = 10_000, parallel: int = 1, max_pending: int = 10_000) -> dict:
    return {
        "name": "items", "start_at": "keys", "error_handling": {"max_attempts": 3, "backoff": "fixed", "base_ms": 10},
        "connections": {"store": {"type": "file", "root": "tables"}, "api": {"type": "http", "base_url": url, "rate_limit": {"max": rate, "window_sec": 1}, "max_inflight": 8, "fail_on_status": [503]}},
        "steps": [
            {"id": "keys", "type": "filter", "input": {"from_connection": "store", "path": "nation.parquet"}, "condition": []},
            {"id": "items", "type": "generate", "connection": "api", "parallel": parallel, "request_queue": {"max_pending": max_pending}, "template": {"path_template": "/item/{k}"}, "parameters": [{"name": "k", "source": "column", "from_step": "keys", "field": "n_nationkey"}]},
        ],
    }


def _run(s: SparkSession, d: str, document: dict, run_id: str = "", state: str = "") -> Lowering:
    low = Lowering(s, parse(document), {"store/nation.parquet": table(s, d, "nation")}, dag_run_id=run_id, state_dir=state or scratch(s, "ledgers"))
    low.lower()
    return low


def _key() -> Column:
    return F.get_json_object("body", "$.key").cast("int").alias("key")


def http_fetch(s: SparkSession, d: str) -> DataFrame:
    """The responses to a request per nation, in rounds of ten, by two tasks."""
    with Loopback() as server:
        got = _run(s, d, _document(server.url, parallel=2, max_pending=10)).frames["items"]
    return got.select(_key(), F.get_json_object("body", "$.square").cast("int").alias("square"), "status_code", "attempts")


def retry(s: SparkSession, d: str) -> DataFrame:
    """Every request fails twice and comes through at its third attempt."""
    with Loopback(failures=2) as server:
        got = _run(s, d, _document(server.url)).frames["items"]
    return got.select(_key(), "ok", "attempts")


def retry_dead_letter(s: SparkSession, d: str) -> DataFrame:
    """Every request fails at all its attempts: the dead letters of the step."""
    with Loopback(failures=9) as server:
        low = _run(s, d, _document(server.url))
    return low.dead_letters["items"].select(F.substring_index("url", "/", -1).cast("int").alias("key"), "status_code", "error")


def rate_limit(s: SparkSession, d: str) -> DataFrame:
    """Whether two tasks together kept to the limit of one connection: at most 10 requests at once and 10 a second beyond."""
    with Loopback() as server:
        got = _run(s, d, _document(server.url, rate=10, parallel=2))
        t = sorted(server.times)
        kept = all(k + 1 - i <= 10 + 10 * (t[k] - t[i]) + 1 for i in range(len(t)) for k in range(i, len(t)))
    return got.frames["items"].agg(F.count(F.lit(1)).alias("requests")).select("requests", F.lit(kept).alias("kept"))


def resume_http(s: SparkSession, d: str) -> DataFrame:
    """A run that broke off with six requests done and four under way, and the run that goes on: states, and how often each was asked for by it."""
    state, run = scratch(s, "ledgers"), f"run-{uuid.uuid4().hex[:8]}"
    with Loopback() as server:
        document = parse(_document(server.url))
        step = document.step("items")
        asked = generate.requests(generate.combinations(s, step.parameters, {"keys": table(s, d, "nation")}), step.template, document.connection("api"), run, "items")
        broken = Ledger(s, f"{state}/items", run)
        broken.enqueue(asked.drop("dag_run_id"))
        broken.plan(10)
        taken = broken.begin_round(0)
        answers = taken.orderBy("request_id").limit(6).select("request_id", F.lit(200).alias("status_code"), F.lit("{}").alias("body"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"))
        broken.finish(answers, taken=taken)
        low = _run(s, d, _document(server.url), run, state)
        times = Counter(server.seen.values())
    states = low.ledgers["items"].states().groupBy("status").agg(F.count(F.lit(1)).alias("requests"))
    return states.select("status", "requests", F.lit(sum(times.values())).cast("long").alias("asked_for"), F.lit(max(times, default=0)).alias("most_times"))


QUERIES = {"http_fetch": http_fetch, "retry": retry, "retry_dead_letter": retry_dead_letter, "rate_limit": rate_limit, "resume_http": resume_http}
SQL = {
    "http_fetch": "SELECT n_nationkey::INT AS key, (n_nationkey * n_nationkey)::INT AS square, 200 AS status_code, 1 AS attempts FROM nation",
    "retry": "SELECT n_nationkey::INT AS key, true AS ok, 3 AS attempts FROM nation",
    "retry_dead_letter": "SELECT n_nationkey::INT AS key, 503 AS status_code, 'status 503' AS error FROM nation",
    "rate_limit": "SELECT count(*) AS requests, true AS kept FROM nation",
    "resume_http": "SELECT 'done' AS status, count(*) AS requests, count(*) - 6 AS asked_for, 1 AS most_times FROM nation",
}


def _stream(s: SparkSession, d: str, steps: list[dict]) -> dict[str, str]:
    """Runs a document over the files of the tables as a stream; where its sinks and dead letters are."""
    from millrace.plans.stream import run_stream

    at = scratch(s, "stream")
    document = {"name": "streamed", "start_at": steps[0]["id"], "connections": {"store": {"type": "file", "root": d}, "out": {"type": "file", "root": f"{at}/out"}}, "steps": steps}
    report = run_stream(s, document, state_dir=f"{at}/state")
    if not report.success:
        raise RuntimeError(report.error_message)
    return report.outputs


def _key_steps() -> list[dict]:
    named = lambda table, key, step: {"id": step, "type": "transform", "input": {"from_connection": "store", "path": f"{table}.parquet"}, "function": {"entrypoint": f"samples:{key}"}}
    return [
        named("nation", "nation_key", "nations"), named("region", "region_key", "regions"),
        {"id": "both", "type": "join", "input": {"inputs": ["nations", "regions"]}, "join_config": {"key": "k", "join": "inner", "timeout": "8s", "on_timeout": "dead_letter"}},
        {"id": "out", "type": "sink", "connection": "out", "input": {"from_step": "both"}, "output": {"path_template": "both", "format": "parquet"}},
    ]


def stream_document_join(s: SparkSession, d: str) -> DataFrame:
    """A document run as a stream: keys that both inputs have pass on as soon as they do."""
    return s.read.schema("k long, n_name string, r_name string").parquet(_stream(s, d, _key_steps())["out"])


def stream_document_letters(s: SparkSession, d: str) -> DataFrame:
    """The same: what waited in vain for the join's timeout."""
    rows = s.read.schema("key string, source string, payload string").json(_stream(s, d, _key_steps())["both.dead_letters"])
    return rows.select(F.col("key").cast("int").alias("k"), "source", F.get_json_object("payload", "$.n_name").alias("n_name"))


def stream_document_aggregate(s: SparkSession, d: str) -> DataFrame:
    """A filter and an aggregate of a document run as a stream."""
    steps = [
        {"id": "views", "type": "filter", "input": {"from_connection": "store", "path": "events.parquet"}, "condition": [{"field": "event_type", "op": "neq", "value": "view"}]},
        {"id": "sums", "type": "aggregate", "input": {"from_step": "views"}, "group_by": ["event_type"], "aggregates": [{"name": "n", "func": "count"}, {"name": "total", "field": "value", "func": "sum"}]},
        {"id": "out", "type": "sink", "connection": "out", "input": {"from_step": "sums"}, "output": {"path_template": "sums", "format": "parquet"}},
    ]
    return s.read.schema("event_type string, n long, total double").parquet(_stream(s, d, steps)["out"]).withColumn("total", F.round("total", 4))


QUERIES |= {"stream_document_join": stream_document_join, "stream_document_letters": stream_document_letters, "stream_document_aggregate": stream_document_aggregate}
SQL |= {
    "stream_document_join": "SELECT n_nationkey::BIGINT AS k, n_name, r_name FROM nation JOIN region ON n_nationkey = r_regionkey",
    "stream_document_letters": "SELECT n_nationkey::INT AS k, 'nations' AS source, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)",
    "stream_document_aggregate": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'view' GROUP BY event_type",
}
