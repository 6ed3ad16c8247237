import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.plans.builder import DAG
from millrace.plans.engine import run
from millrace.plans.spec import Auth, Backpressure, Connection, ErrorHandling, RateLimit
from millrace.sources import connectors, http_source
from millrace.sources.ledger import Ledger, counts, current, resumable
from millrace.sources.limiter import BoundedQueue, TokenBucket


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, t):
        self.now += t


def test_bucket():
    clock = Clock()
    b = TokenBucket(10, 10, clock, clock.sleep)
    assert sum(b.try_acquire() for _ in range(50)) == 10 and not b.try_acquire()
    clock.now += 0.5
    assert b.available() == 5 and sum(b.try_acquire() for _ in range(50)) == 5
    clock.now += 100
    assert b.available() == 10
    for _ in range(10):
        b.acquire()
    before = clock.now
    b.acquire()
    assert clock.now - before >= 0.08
    b.set_rate(1000)
    clock.now += 0.005
    assert b.try_acquire()
    clock = Clock()
    b, n = TokenBucket(10, 10, clock, clock.sleep), 0
    while clock.now < 2:
        n += b.try_acquire()
        clock.now += 0.001
    assert 15 <= n <= 40


def test_bucket_under_contention():
    b, got = TokenBucket(50, 0), []
    threads = [threading.Thread(target=lambda: got.extend(b.try_acquire() for _ in range(50))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(got) == 50


def test_bounded_queue():
    said = []
    q = BoundedQueue(5, 2, lambda: said.append("pause"), lambda: said.append("resume"))
    assert [q.offer(i) for i in range(7)] == [True] * 5 + [False] * 2 and q.paused and len(q) == 5
    assert [q.poll(), q.poll()] == [0, 1] and q.paused
    assert q.poll() == 2 and not q.paused and said == ["pause", "resume"]
    q.put(9)
    assert [q.poll() for _ in range(4)] == [3, 4, 9, None]


class Server:
    """Answers with ``reply(path, nth)``; counts what is open."""

    def __init__(self, reply, delay=0.0):
        self.open = self.most = 0
        self.seen, self.lock = [], threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                with outer.lock:
                    outer.open += 1
                    outer.most = max(outer.most, outer.open)
                    outer.seen.append((self.path, dict(self.headers)))
                    nth = sum(p == self.path for p, _ in outer.seen)
                time.sleep(delay)
                status, body = reply(self.path, nth)
                with outer.lock:
                    outer.open -= 1
                try:
                    self.send_response(status)
                    self.send_header("Content-Length", str(len(body)))
                    self.end_headers()
                    self.wfile.write(body.encode())
                except OSError:
                    pass

            do_POST = do_GET

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.http.daemon_threads = True
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.http.shutdown()
        self.http.server_close()


def conn(url, **more):
    return Connection("c", base_url=url, **({"rate_limit": RateLimit(1000, 1.0)} | more))


def ask(url, n):
    return [{"request_id": str(i), "step_id": "s", "url": f"{url}/item/{i}", "tag": "t1"} for i in range(n)]


def test_fetcher():
    with Server(lambda p, n: (200, '{"data":1}'), 0.02) as s:
        f = http_source.Fetcher(conn(s.url, max_inflight=3))
        got = list(f.responses(iter(ask(s.url, 30))))
        assert len(got) == 30 and all(r["ok"] and r["body"] == '{"data":1}' for r in got)
        assert f.most_inflight <= 3 and s.most <= 3 and s.seen[0][1]["X-Request-Tag"] == "t1"


def test_failures_and_retries():
    def reply(path, nth):
        return {"/item/0": (500, "down"), "/item/1": (503 if nth < 3 else 200, "late"), "/item/2": (404, "none"), "/item/3": (403, "no")}[path]

    waits = []
    with Server(reply) as s:
        f = http_source.Fetcher(conn(s.url, fail_on_status=(403, 500, 503)), ErrorHandling(3, "exponential", 100), sleep=waits.append)
        got = {r["request_id"]: r for r in f.responses(iter(ask(s.url, 4)))}
    assert (got["0"]["ok"], got["0"]["status_code"], got["0"]["attempts"], got["0"]["error"]) == (False, 500, 3, "status 500")
    assert (got["1"]["ok"], got["1"]["attempts"]) == (True, 3) and got["2"]["ok"] and got["2"]["status_code"] == 404
    assert not got["3"]["ok"] and got["3"]["attempts"] == 1 and sorted(waits) == [0.1, 0.1, 0.2, 0.2]
    assert [ErrorHandling(3, b, 10).delay_ms(3) for b in ("linear", "exponential")] == [30, 40]


def test_timeout_bad_urls_and_auth():
    with Server(lambda p, n: (200, "x"), 0.5) as s:
        slow = http_source.Fetcher(conn(s.url, timeout_ms=100), ErrorHandling(1)).fetch(ask(s.url, 1)[0])
    assert not slow["ok"] and slow["status_code"] == 0 and "timed out" in slow["error"]
    for url in ("ftp://x/", "nonsense", ""):
        bad = http_source.Fetcher(conn(""), ErrorHandling(5)).fetch({"request_id": "r", "url": url})
        assert not bad["ok"] and bad["attempts"] == 1
    assert http_source.auth_header(Auth("bearer", "env:TOK"), {"TOK": "abc"}) == {"Authorization": "Bearer abc"}
    assert http_source.auth_header(Auth("basic", username="u", password="p"))["Authorization"] == "Basic dTpw"
    assert http_source.auth_header(Auth()) == {}


def test_backpressure():
    with Server(lambda p, n: (200, "x"), 0.01) as s:
        f = http_source.Fetcher(conn(s.url, max_inflight=2, backpressure=Backpressure(5, 2)))
        got = f.responses(iter(ask(s.url, 60)))
        next(got)
        time.sleep(0.5)
        assert len(s.seen) <= 5 + 2 + 2
        assert len(list(got)) == 59


def test_fetch_in_spark_and_data_source(spark):
    with Server(lambda p, n: (200, p)) as s:
        asked = spark.createDataFrame(ask(s.url, 40))
        for tasks in (1, 3):
            got = http_source.fetch(asked, conn(s.url), tasks=tasks)
            assert {(r.request_id, r.body) for r in got.collect()} == {(str(i), f"/item/{i}") for i in range(40)}
        assert http_source.fetch(asked.limit(0), conn(s.url)).count() == 0
        spark.dataSource.register(http_source.HttpDataSource)
        df = spark.read.format("millrace_http").option("urls", f"{s.url}/a {s.url}/b {s.url}/c").option("partitions", 2).option("rate_max", 100).load()
        assert sorted(r.body for r in df.collect()) == ["/a", "/b", "/c"]


def test_ledger(spark, tmp_path):
    led = Ledger(spark, str(tmp_path), "run-1")
    asked = spark.createDataFrame([(f"req-{i}", "s", "GET", f"http://x/{i}", None) for i in range(5)], "request_id string, step_id string, method string, url string, body string").coalesce(1)
    assert led.enqueue(asked) == 5 and led.enqueue(asked) == 0
    assert sorted(r.request_id for r in led.take(2).collect()) == ["req-0", "req-1"]
    assert (led.count("pending"), led.count("inflight"), led.exhausted()) == (3, 2, False)
    done = spark.createDataFrame([("req-0", 200, "body", True, None, 2), ("req-1", 500, "", False, "boom", 3)], "request_id string, status_code int, body string, ok boolean, error string, attempts int")
    led.finish(done)
    now = {r.request_id: r for r in current(led.events()).collect()}
    assert (now["req-0"].status, now["req-0"].response_body, now["req-0"].retry_count) == ("done", "body", 1)
    assert (now["req-1"].status, now["req-1"].response_body) == ("failed", "boom")
    led.take(1)
    # Another session opens the same run: what was under way starts anew, what is done stays.
    again = Ledger(spark, str(tmp_path), "run-1")
    assert again.resume() == 1 and again.count("pending") == 3 and again.count("done") == 1
    other = Ledger(spark, str(tmp_path), "run-2")
    assert other.enqueue(asked) == 5 and led.count("pending") == 3 and other.count("done") == 0
    assert rows(counts(led.events()).select("status", "n")) == [("done", 1), ("failed", 1), ("pending", 3)]
    assert resumable(led.events()).count() == 3
    led.archive(str(tmp_path / "archive"), keep_failed=False)
    kept = spark.read.json(str(tmp_path / "archive"))
    assert [r.request_id for r in kept.collect()] == ["req-0"]
    assert Ledger.expire(spark, str(tmp_path / "archive"), 14, "2020-01-01") == [] and len(Ledger.expire(spark, str(tmp_path / "archive"), 1, "2999-01-01")) == 1
    made = spark.createDataFrame([("", "s", "GET", "http://x/9", None)], asked.schema)
    assert led.enqueue(made) == 1 and led.enqueue(made) == 0


def test_pipeline_over_http_resumes(spark, tmp_path):
    state = {"down": True}

    def reply(path, nth):
        n = int(path.rsplit("/", 1)[1])
        return (500, "down") if n == 3 and state["down"] else (200, json.dumps({"id": str(n), "fields": {"status": {"name": "Resolved"}}}))

    (tmp_path / "ids.json").write_text(json.dumps([str(i) for i in range(6)]))
    with Server(reply) as s:
        d = (
            DAG("x").error_handling(2, base_ms=1).connection("api", base_url=s.url, rate_limit={"max": 1000, "window_sec": 1}, fail_on_status=[500], auth={"type": "bearer", "token_from": "s3cr3t"})
            .connection("store", "file", root=f"file://{tmp_path}")
            .source("api", "/issue/{ticket}", id="fetch", file="store/ids.json", request_queue={"flush_policy": {"archive_connection": "store"}})
            .transform("samples:issue", id="flat").sink("store", "out/{date}", id="write")
        )
        import millrace.plans.samples  # noqa: F401

        got = run(spark, d.to_dict(), dag_run_id="r1", state_dir=str(tmp_path / "state"))
        assert got.success, got.error_message
        assert (got.total_requests, got.successes, got.failures, got.retries) == (6, 5, 1, 1)
        assert sorted(r.id for r in spark.read.parquet(got.outputs["write"]).collect()) == ["0", "1", "2", "4", "5"]
        asked = len(s.seen)
        assert all(h["Authorization"] == "Bearer s3cr3t" for _, h in s.seen)
        again = run(spark, d.to_dict(), dag_run_id="r1", state_dir=str(tmp_path / "state"))
        assert again.success and len(s.seen) == asked, "finished requests aren't made again"
    said = "".join(p.read_text(errors="replace") for p in (tmp_path / "state").rglob("*") if p.is_file())
    assert "s3cr3t" not in said


def test_connectors(spark, tmp_path):
    reg = connectors.Registry()
    reg.add("f", connectors.FileConnector(f"file://{tmp_path}"))
    assert reg.has("f") and not reg.has("g")
    with pytest.raises(KeyError, match="unknown connector: g"):
        reg.get("g")
    f = reg.get("f")
    f.write_text(spark, "a/b.json", '["x", 1]')
    f.write_text(spark, "a/b.json", '["x", 2]')
    assert f.read_text(spark, "a/b.json") == '["x", 2]' and f.exists(spark, "a/b.json") and not f.exists(spark, "nope")
    with pytest.raises(FileNotFoundError):
        f.read_text(spark, "nope")
    for bad in ("../x", "/etc/passwd", "a/../../x", "", "s3a://b/x"):
        with pytest.raises(ValueError):
            f.uri(bad)
    assert [r.value for r in connectors.read(spark, f.uri("a/b.json")).collect()] == ["x", "2"]
    f.write_text(spark, "o.json", '[{"a": 1}, {"a": 2}]')
    assert connectors.read(spark, f.uri("o.json")).agg(F.sum("a")).first()[0] == 3
    f.write_text(spark, "o.csv", "a,b\n1,2\n")
    assert connectors.read(spark, f.uri("o.csv")).columns == ["a", "b"]
    s3 = connectors.S3Connector("bkt", "pre/", "http://h:9", "ak", "sk")
    assert s3.uri("x/y.parquet") == "s3a://bkt/pre/x/y.parquet" and s3.settings()["fs.s3a.bucket.bkt.secret.key"] == "sk"
