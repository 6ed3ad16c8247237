"""Running pipelines: steps become lazy DataFrames in topological order, and each sink is one action."""

from __future__ import annotations

import logging
import re
import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.session import durable_dir
from millrace.operators import filter as filters
from millrace.operators import generate, sink, transform, unnest
from millrace.operators.aggregate import aggregate
from millrace.operators.join import join
from millrace.plans import spec
from millrace.plans.parse import PipelineError, parse, parse_file
from millrace.plans.validate import order, validate
from millrace.sources import connectors, http_source
from millrace.sources.ledger import Ledger

log = logging.getLogger("millrace")


@dataclass
class Report:
    """How a run went."""

    success: bool = False
    total_requests: int = 0
    successes: int = 0
    failures: int = 0
    retries: int = 0
    skipped: int = 0
    elapsed_sec: float = 0.0
    error_message: str = ""
    dag_run_id: str = ""
    outputs: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


class Lowering:
    """Turns the steps of a pipeline into DataFrames. ``frames`` has the output of each step, ``dead_letters`` what joins and fetches set aside."""

    def __init__(self, spark: SparkSession, pipeline: spec.Pipeline, tables: dict[str, DataFrame] | None = None, dag_run_id: str = "", state_dir: str = "", now: datetime | None = None):
        self.spark, self.pipeline = spark, pipeline
        self.tables = tables or {}
        self.run_id = dag_run_id or f"run-{uuid.uuid4().hex[:12]}"
        self.now = now or datetime.now(UTC)
        self.registry = connectors.registry_of(pipeline, spark)
        self._state_dir = state_dir
        self.frames: dict[str, DataFrame] = {}
        self.dead_letters: dict[str, DataFrame] = {}
        self.ledgers: dict[str, Ledger] = {}
        self.sinks: list[tuple[spec.Step, DataFrame]] = []

    @property
    def state_dir(self) -> str:
        return self._state_dir or f"{durable_dir(self.spark)}/ledgers"

    def lower(self) -> dict[str, DataFrame]:
        """Lowers all steps; raises PipelineError with the first finding if the pipeline isn't valid."""
        wrong = [f for f in validate(self.pipeline) if f.severity == "error"]
        if wrong:
            raise PipelineError("; ".join(f.message for f in wrong))
        for name in order(self.pipeline):
            step = self.pipeline.step(name)
            getattr(self, f"_{step.type}")(step)
        return self.frames

    def _named(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise PipelineError(f"step '{name}' passes nothing on")
        return self.frames[name]

    def _file(self, step: spec.Step) -> DataFrame:
        name, path = step.input.from_connection or "", step.input.path or ""
        for known in (f"{name}/{path}", path, name):
            if known in self.tables:
                return self.tables[known]
        return connectors.read(self.spark, self.registry.get(name).uri(path))

    def _input(self, step: spec.Step, projects: bool = True) -> DataFrame:
        i = step.input
        df = self._named(i.from_step) if i.from_step else self._file(step) if i.from_connection else self._named(i.inputs[0])
        return unnest.project(df, i.field) if i.field and projects else df

    def _generate(self, step: spec.Step) -> None:
        frames = {p.from_step: self._named(p.from_step) for p in step.parameters if p.source == "column"}
        combined = generate.combinations(self.spark, step.parameters, frames) if step.parameters else None
        if step.input.path:
            ids = self._input(step)
            free = {n for n in re.findall(r"\{(\w+)\}", step.template.path_template)} - {p.name for p in step.parameters}
            if len(free) == 1:
                ids = ids.select(F.col(f"`{ids.columns[0]}`").cast("string").alias(free.pop()))
            combined = ids if combined is None else ids.join(combined)
        if combined is None:
            combined = self.spark.range(1).select()
        connection = self.pipeline.connection(step.connection)
        asked = generate.requests(combined, step.template, connection, self.run_id, step.id)
        if f"{step.id}.responses" in self.tables:
            # Responses given from outside: for tests and replays.
            self.frames[step.id] = self.tables[f"{step.id}.responses"]
            return
        if connection.type == "stub":
            log.warning("step '%s' fetches from the stub '%s' and passes nothing on", step.id, connection.name)
            self.frames[step.id] = self.spark.createDataFrame([], http_source.RESPONSES)
            return
        self.frames[step.id] = self._fetched(step, connection, asked)

    def _fetched(self, step: spec.Step, connection: spec.Connection, asked: DataFrame) -> DataFrame:
        """Fetches in rounds of max_pending requests, each noted before and after; a restarted run asks only for what isn't finished."""
        ledger = Ledger(self.spark, f"{self.state_dir}/{step.id}", self.run_id)
        self.ledgers[step.id] = ledger
        self._enqueue(ledger, asked)
        self._rounds(step, connection, ledger)
        said, failed = ledger.rows_in("done"), ledger.rows_in("failed")
        self.dead_letters[step.id] = failed.select("request_id", "step_id", "url", F.col("response_status").alias("status_code"), F.col("response_body").alias("error"))
        return self._responses(said)

    @staticmethod
    def _enqueue(ledger: Ledger, asked: DataFrame) -> None:
        ledger.enqueue(asked.drop("dag_run_id"))
        ledger.resume()

    @staticmethod
    def _responses(done: DataFrame) -> DataFrame:
        return done.select("request_id", "step_id", F.col("response_status").alias("status_code"), F.col("response_body").alias("body"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), (F.col("retry_count") + 1).alias("attempts"))

    def _rounds(self, step: spec.Step, connection: spec.Connection, ledger: Ledger) -> None:
        policy = step.request_queue.flush_policy
        size = policy.buffer_size if policy.trigger == "buffer_size" else max(1, step.request_queue.max_pending)
        archive = self.registry.get(policy.archive_connection).uri(f"{step.id}/{self.run_id}") if policy.archive_connection and self.registry.has(policy.archive_connection) else ""
        for k in range(ledger.plan(size)):
            taken = ledger.begin_round(k)
            with_headers = taken.withColumns({"accept": F.lit(step.template.accept), "tag": F.lit(step.template.tag)})
            ledger.finish(http_source.fetch(with_headers, connection, self.pipeline.error_handling, max(1, step.parallel)), taken=taken)
            due = policy.trigger == "buffer_size" or (policy.trigger == "interval" and time.monotonic() - ledger.flushed_at >= policy.interval_sec)
            if archive and due:
                ledger.flush(archive, policy.keep_failed, policy.archive_format)
        if archive:
            ledger.flush(archive, policy.keep_failed, policy.archive_format)
            Ledger.expire(self.spark, archive, policy.retention_days, self.now.date().isoformat())

    def _transform(self, step: spec.Step) -> None:
        f = step.function
        df = self._input(step)
        if df.columns == ["body"] or {"body", "status_code", "request_id"} <= set(df.columns):
            df, rest = _records(df)
            if rest is not None:
                self.dead_letters[step.id] = rest
        self.frames[step.id] = transform.transform(df, f.entrypoint, f.schema, f.row_preserving, step.parallel)

    def _filter(self, step: spec.Step) -> None:
        self.frames[step.id] = filters.filter_rows(self._input(step), step.conditions)

    def _aggregate(self, step: spec.Step) -> None:
        self.frames[step.id] = aggregate(self._input(step), step.group_by, step.aggregates, step.preserve_key_types)

    def _join(self, step: spec.Step) -> None:
        joined = join({n: self._named(n) for n in step.input.inputs}, step.join)
        self.frames[step.id] = joined.rows
        if joined.dead_letter is not None:
            self.dead_letters[step.id] = joined.dead_letter

    def _unnest(self, step: spec.Step) -> None:
        # A projection to just the column that is exploded would only lose its siblings.
        same = step.input.field == step.unnest.field
        df = self._input(step, projects=not same)
        if same and step.unnest.field not in df.columns:
            df = unnest.project(df, step.input.field)
        self.frames[step.id] = unnest.unnest(df, step.unnest.field, step.unnest.array_column, step.unnest.drop_null)

    def _sink(self, step: spec.Step) -> None:
        df = self._input(step)
        self.frames[step.id] = df
        self.sinks.append((step, df))

    def _stub(self, step: spec.Step) -> None:
        log.warning("step '%s' is a stub and passes nothing on: %s", step.id, step.reason)

    def path_of(self, step: spec.Step) -> str:
        """Where a sink writes; empty if its connection is a stub."""
        path = sink.materialize(step.output.path_template, step.output.partition, self.now)
        connection = self.pipeline.connection(step.connection)
        if connection.type == "stub":
            log.warning("sink '%s' writes to the stub '%s': nothing is written", step.id, connection.name)
            return ""
        return self.registry.get(step.connection).uri(path)

    def write(self, step: spec.Step, df: DataFrame, single_file: bool = False) -> str:
        path = self.path_of(step)
        return sink.write(df, path, step.output.format, single_file) if path else ""


def _records(responses: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Responses whose bodies are JSON objects, or arrays of them, as rows of those objects' fields, by the merged schema of all; and
    the responses whose body, or element of it, is no object. Without any object the responses stay as they are."""
    text, value = F.btrim("body", F.lit(" \t\r\n")), F.expr("try_parse_json(body)")
    element = lambda x: F.struct(F.coalesce(F.to_json(x), F.lit("null")).alias("text"), F.coalesce(F.schema_of_variant(x).startswith("OBJECT<"), F.lit(False)).alias("object"))
    # A name that is repeated makes no variant, but a map.
    whole = F.array(F.struct(text.alias("text"), (text.startswith("{") & F.from_json(text, "map<string,string>").isNotNull()).alias("object")))
    parts = F.when(F.schema_of_variant(value).startswith("ARRAY<"), F.transform(value.cast("array<variant>"), element)).otherwise(whole)
    each = responses.where("body is not null").withColumn("__part", F.explode(parts))
    bodies = each.where("__part.object").select(F.col("__part.text").alias("body"))
    found = bodies.agg(F.expr("schema_of_variant_agg(try_parse_json(body))").alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<") or found == "OBJECT<>":
        return responses, None
    schema = re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", found))
    rest = each.where("not __part.object").withColumn("body", F.col("__part.text")).drop("__part")
    return bodies.select(F.from_json("body", schema).alias("r")).where("r is not null").select("r.*"), rest


def run(spark: SparkSession, document: str | dict | spec.Pipeline, dry_run: bool = False, single_file: bool = False, **more) -> Report:
    """Runs a pipeline: a path ending in .json, a document, or a parsed pipeline. dry_run stops before anything is fetched or written."""
    began, report = time.monotonic(), Report()
    try:
        p = load(document)
        findings = validate(p)
        report.warnings = [f.message for f in findings if f.severity == "warning"]
        wrong = [f.message for f in findings if f.severity == "error"]
        if wrong:
            raise PipelineError("; ".join(wrong))
        if not dry_run:
            low = Lowering(spark, p, **more)
            report.dag_run_id = low.run_id
            low.lower()
            for step, df in low.sinks:
                report.outputs[step.id] = low.write(step, df, single_file)
            for ledger in low.ledgers.values():
                _count(report, ledger)
        report.success = True
    except Exception as e:  # noqa: BLE001
        report.error_message = str(e)
        log.error("%s", e)
    report.elapsed_sec = time.monotonic() - began
    return report


def _count(report: Report, ledger: Ledger) -> None:
    row = ledger.states().agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "done", 1)).alias("ok"), F.count(F.when(F.col("status") == "failed", 1)).alias("bad"),
        F.count(F.when(F.col("status") == "skipped", 1)).alias("skipped"), F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"),
    ).first()
    report.total_requests += row.n
    report.successes += row.ok
    report.failures += row.bad
    report.skipped += row.skipped
    report.retries += row.retries


def load(document: str | dict | spec.Pipeline) -> spec.Pipeline:
    if isinstance(document, spec.Pipeline):
        return document
    if isinstance(document, str) and not document.lstrip().startswith("{"):
        return parse_file(document)
    return parse(document)
