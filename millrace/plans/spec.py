"""The pipeline document as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

STEP_TYPES = ("generate", "transform", "filter", "aggregate", "join", "unnest", "sink", "stub")
CONNECTION_TYPES = ("http", "s3", "file", "stub")
FLUSH_TRIGGERS = ("batch_complete", "buffer_size", "interval")
JOIN_KINDS = ("inner", "left")
ON_TIMEOUT = ("dead_letter", "drop", "emit_null")
PARAMETER_SOURCES = ("literal", "list", "range", "column")


@dataclass(frozen=True)
class RateLimit:
    max: int = 10
    window_sec: float = 1.0


@dataclass(frozen=True)
class Backpressure:
    max_buffered_responses: int = 1000
    resume_at: int = 500


@dataclass(frozen=True)
class Auth:
    type: str = ""
    token_from: str = field(default="", repr=False)
    username: str = ""
    password: str = field(default="", repr=False)


@dataclass(frozen=True)
class Connection:
    name: str
    type: str = "http"
    base_url: str = ""
    rate_limit: RateLimit = RateLimit()
    max_inflight: int = 10
    backpressure: Backpressure = Backpressure()
    auth: Auth = Auth()
    timeout_ms: int = 30_000
    fail_on_status: tuple[int, ...] = ()
    endpoint: str = ""
    bucket: str = ""
    access_key: str = field(default="", repr=False)
    secret_key: str = field(default="", repr=False)
    prefix: str = ""
    root: str = ""
    reason: str = ""


@dataclass(frozen=True)
class Parameter:
    name: str = ""
    source: str = "literal"
    value: str = ""
    values: tuple[str, ...] = ()
    range_start: int = 0
    range_end: int = 0
    range_step: int = 1
    from_step: str | None = None
    field: str | None = None


@dataclass(frozen=True)
class StepInput:
    from_step: str | None = None
    from_connection: str | None = None
    path: str | None = None
    inputs: tuple[str, ...] = ()
    field: str | None = None


@dataclass(frozen=True)
class RequestTemplate:
    method: str = "GET"
    path_template: str = ""
    accept: str = "application/json"
    tag: str = ""


@dataclass(frozen=True)
class FlushPolicy:
    trigger: str = "batch_complete"
    buffer_size: int = 1000
    interval_sec: int = 60
    archive_connection: str = ""
    archive_format: str = "json.gz"
    retention_days: int = 14
    keep_failed: bool = True


@dataclass(frozen=True)
class RequestQueue:
    durable: bool = True
    storage: str = ""
    max_pending: int = 10_000
    flush_policy: FlushPolicy = FlushPolicy()


@dataclass(frozen=True)
class Function:
    language: str = "python"
    entrypoint: str = ""
    schema: str = ""
    row_preserving: bool = False


@dataclass(frozen=True)
class Condition:
    field: str = ""
    op: str = ""
    value: str = ""


@dataclass(frozen=True)
class Aggregate:
    name: str = ""
    field: str = ""
    func: str = ""
    arg: float = 0.0


@dataclass(frozen=True)
class JoinConfig:
    key: str = ""
    join: str = "inner"
    timeout: str = "30s"
    on_timeout: str = "dead_letter"


@dataclass(frozen=True)
class Output:
    path_template: str = ""
    format: str = "parquet"
    partition: str = ""


@dataclass(frozen=True)
class Unnest:
    field: str = ""
    array_column: str = ""
    drop_null: bool = True


@dataclass(frozen=True)
class Step:
    id: str
    type: str = "stub"
    description: str = ""
    connection: str = ""
    input: StepInput = StepInput()
    parameters: tuple[Parameter, ...] = ()
    parallel: int = 1
    template: RequestTemplate = RequestTemplate()
    request_queue: RequestQueue = RequestQueue()
    function: Function = Function()
    conditions: tuple[Condition, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    preserve_key_types: bool = False
    join: JoinConfig = JoinConfig()
    unnest: Unnest = Unnest()
    output: Output = Output()
    reason: str = ""

    def upstream(self) -> list[str]:
        """Steps whose output this one needs."""
        named = [self.input.from_step, *self.input.inputs, *(p.from_step for p in self.parameters if p.source == "column")]
        return list(dict.fromkeys(n for n in named if n))


@dataclass(frozen=True)
class ErrorHandling:
    max_attempts: int = 3
    backoff: str = "exponential"
    base_ms: int = 1000

    def delay_ms(self, attempt: int) -> int:
        """The wait after the given failed attempt (from 1)."""
        growth = {"fixed": 1, "linear": attempt}.get(self.backoff, 2 ** (attempt - 1))
        return self.base_ms * growth


@dataclass(frozen=True)
class Pipeline:
    name: str
    start_at: str
    steps: tuple[Step, ...]
    version: str = ""
    error_handling: ErrorHandling = ErrorHandling()
    connections: tuple[Connection, ...] = ()

    def step(self, name: str) -> Step:
        return next(s for s in self.steps if s.id == name)

    def connection(self, name: str) -> Connection:
        return next(c for c in self.connections if c.name == name)
