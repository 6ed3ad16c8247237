"""Fetching requests over HTTP inside Spark tasks, and the same as a data source.

A task fetches its requests with a bounded number in flight, behind a token bucket; failed ones (no answer, or a status that the connection
lists) are tried again after a growing delay. Responses come out as they finish, and at most ``max_buffered`` wait for
the reader. Several tasks share a connection's limits: each gets its part of the tokens, of the rate and of the requests in flight, and the
parts add up to the limits exactly; so there are no more tasks than the smallest limit has parts. A call can be cancelled.
Tokens are resolved in the task and never become part of a plan, a row or the ledger. A task that is run again fetches again, so
requests other than GET should run with spark.task.maxFailures = 1.
"""

from __future__ import annotations

import base64
import os
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.plans.spec import Auth, Backpressure, Connection, ErrorHandling, RateLimit
from millrace.sources.limiter import BoundedQueue, TokenBucket

_ARROW = pa.schema([("request_id", pa.string()), ("step_id", pa.string()), ("status_code", pa.int32()), ("body", pa.string()), ("ok", pa.bool_()), ("error", pa.string()), ("attempts", pa.int32())])
RESPONSES = "request_id string, step_id string, status_code int, body string, ok boolean, error string, attempts int"


def auth_header(auth: Auth, env: dict[str, str] | None = None) -> dict[str, str]:
    """The Authorization header of a connection; env:NAME is looked up where this runs."""
    env = os.environ if env is None else env
    token = env.get(auth.token_from[4:], "") if auth.token_from.startswith("env:") else auth.token_from
    if auth.type == "bearer" and token:
        return {"Authorization": f"Bearer {token}"}
    if auth.type == "basic":
        pair = f"{auth.username}:{auth.password or token}"
        return {"Authorization": "Basic " + base64.b64encode(pair.encode()).decode()}
    return {}


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


_OPENER = urllib.request.build_opener(_NoRedirect)


def once(request: dict, headers: dict[str, str], timeout: float) -> tuple[int, str, str]:
    """(status, body, error) of one attempt; status 0 and an error if there was no answer."""
    url = request["url"]
    if not url or not url.lower().startswith(("http://", "https://")):
        return 0, "", f"bad url: {url}"
    body = request.get("body")
    try:
        asked = urllib.request.Request(url, data=body.encode() if body else None, method=request.get("method") or "GET", headers={"Accept": request.get("accept") or "application/json", **({"X-Request-Tag": request["tag"]} if request.get("tag") else {}), **headers})
        with _OPENER.open(asked, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace"), ""
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace"), ""
    except TimeoutError:
        return 0, "", "timed out"
    except (urllib.error.URLError, OSError, ValueError) as e:
        reason = getattr(e, "reason", e)
        return 0, "", "timed out" if isinstance(reason, TimeoutError) else str(reason) or type(e).__name__


class Fetcher:
    """Fetches requests for one connection. ``most_inflight`` and ``attempts`` tell how it went."""

    def __init__(self, connection: Connection, errors: ErrorHandling = ErrorHandling(), share: int = 1, env: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep, number: int = 0):
        limit = connection.rate_limit
        self.connection, self.errors, self._sleep = connection, errors, sleep
        # Part ``number`` of ``share``: the parts add up to the whole.
        part = lambda whole: max(1, (whole + share - 1 - number) // share)
        self.inflight, burst = part(connection.max_inflight), part(limit.max)
        self.bucket = TokenBucket(burst, limit.max / limit.window_sec / share)
        self.headers = auth_header(connection.auth, env)
        self.most_inflight = self.attempts = self._now = 0
        self._lock, self._cancelled = threading.Lock(), threading.Event()

    def cancel_all(self) -> None:
        """What isn't sent yet comes out as failed, without an attempt."""
        self._cancelled.set()

    def _attempt(self, request: dict) -> tuple[int, str, str]:
        self.bucket.acquire()
        with self._lock:
            self._now += 1
            self.attempts += 1
            self.most_inflight = max(self.most_inflight, self._now)
        try:
            return once(request, self.headers, self.connection.timeout_ms / 1000)
        finally:
            with self._lock:
                self._now -= 1

    def fetch(self, request: dict) -> dict:
        """The response to one request, after as many attempts as it takes or may have."""
        if self._cancelled.is_set():
            return {"request_id": request.get("request_id"), "step_id": request.get("step_id"), "status_code": 0, "body": "", "ok": False, "error": "cancelled", "attempts": 0}
        for attempt in range(1, max(1, self.errors.max_attempts) + 1):
            status, body, error = self._attempt(request)
            if not error and status in self.connection.fail_on_status:
                error = f"status {status}"
            again = error and not error.startswith("bad url") and (status == 0 or status == 429 or status >= 500)
            if not error or not again or attempt >= self.errors.max_attempts or self._cancelled.is_set():
                break
            self._sleep(self.errors.delay_ms(attempt) / 1000)
        return {"request_id": request.get("request_id"), "step_id": request.get("step_id"), "status_code": status, "body": body, "ok": not error, "error": error or None, "attempts": attempt}

    def responses(self, requests: Iterator[dict]) -> Iterator[dict]:
        """Responses as they finish. The next request starts only while few responses wait to be taken."""
        back = self.connection.backpressure
        out = BoundedQueue(max(1, back.max_buffered_responses), min(back.resume_at, back.max_buffered_responses - 1))
        slots, ended, stop = threading.Semaphore(self.inflight), object(), threading.Event()

        def one(request: dict) -> None:
            try:
                out.put(self.fetch(request))
            except BaseException as e:  # noqa: BLE001
                out.put(e)
            finally:
                slots.release()

        def feed() -> None:
            try:
                with ThreadPoolExecutor(self.inflight) as pool:
                    for r in requests:
                        slots.acquire()
                        while out.paused and not stop.is_set():
                            time.sleep(0.002)
                        if stop.is_set():
                            break
                        pool.submit(one, r)
                out.put(ended)
            except BaseException as e:  # noqa: BLE001
                out.put(e)

        threading.Thread(target=feed, daemon=True).start()
        try:
            while True:
                item = out.poll()
                if item is None:
                    time.sleep(0.001)
                elif item is ended:
                    return
                elif isinstance(item, BaseException):
                    raise item
                else:
                    yield item
        finally:
            stop.set()
            while out.poll() is not None:
                pass


def fetch(requests: DataFrame, connection: Connection, errors: ErrorHandling = ErrorHandling(), tasks: int = 1) -> DataFrame:
    """The response to every request (request_id, step_id, method, url, body, accept, tag): columns as in RESPONSES."""
    wanted = [c for c in ("request_id", "step_id", "method", "url", "body", "accept", "tag") if c in requests.columns]
    names = [n.split()[0] for n in RESPONSES.split(", ")]
    tasks = max(1, min(tasks, connection.max_inflight, connection.rate_limit.max))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = (r for b in batches for r in b.to_pylist())
        rows: list[dict] = []
        for response in Fetcher(connection, errors, tasks, number=TaskContext.get().partitionId() % tasks).responses(asked):
            rows.append({n: response[n] for n in names})
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    placed = requests.select(*wanted)
    placed = placed.coalesce(1) if tasks == 1 else placed.repartition(tasks, F.col("request_id") if "request_id" in placed.columns else F.col("url"))
    return placed.mapInArrow(run, RESPONSES)


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class HttpDataSource(DataSource):
    """spark.read.format("millrace_http").option("urls", "http://a/1 http://a/2"): responses to a few given urls.

    Options: urls (separated by blanks), partitions, max_inflight, rate_max, rate_window_sec, timeout_ms, fail_on_status (comma separated),
    max_attempts, backoff, base_ms, auth_type, token_from.
    """

    @classmethod
    def name(cls) -> str:
        return "millrace_http"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[_Part]:
        urls, n = self.options.get("urls", "").split(), int(self.options.get("partitions", 1))
        return [_Part(urls[i::n]) for i in range(n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        o = self.options.get
        c = Connection(
            "source", max_inflight=int(o("max_inflight", 10)), timeout_ms=int(o("timeout_ms", 30_000)), rate_limit=RateLimit(int(o("rate_max", 10)), float(o("rate_window_sec", 1))),
            fail_on_status=tuple(int(x) for x in o("fail_on_status", "").split(",") if x), auth=Auth(o("auth_type", ""), o("token_from", "")), backpressure=Backpressure(),
        )
        errors = ErrorHandling(int(o("max_attempts", 3)), o("backoff", "exponential"), int(o("base_ms", 1000)))
        asked = ({"request_id": u, "step_id": "", "url": u} for u in partition.urls)
        for r in Fetcher(c, errors, int(o("partitions", 1))).responses(asked):
            yield tuple(r[n.split()[0]] for n in RESPONSES.split(", "))
