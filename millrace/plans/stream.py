"""Running a pipeline document as a stream: rows, and responses as they come, flow through the steps in micro-batches.

The steps are those of a batch. Files of a connection are read as a stream; a generate step fetches in the background, round by round, and
its responses flow on as soon as they are noted in the ledger; a join holds the rows of a key until all inputs have delivered, or until
``join_config.timeout`` has passed, when ``on_timeout`` decides; an aggregate keeps state and gives whole results. Each join, sink and set of
dead letters is a query with a checkpoint of its own, so a run of the same id goes on where it broke off; what joins decide is
written down once, and the steps behind them read that.

A stream is bounded here: the run ends when what is there (files, requests) has been worked through and no join waits any more. A join keeps
the latest row of a key and input, since it passes a key on once. Rows without a key are dead letters at once. State needs the RocksDB store.
"""

from __future__ import annotations

import logging
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import join as joins
from millrace.operators import sink, transform
from millrace.plans import spec
from millrace.plans.engine import Lowering, Report, _count, load
from millrace.plans.parse import seconds
from millrace.sources import connectors
from millrace.sources.ledger import SCHEMA, Ledger
from millrace.streaming import pipeline

log = logging.getLogger("millrace")

_STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class StreamLowering(Lowering):
    """Turns the steps into streaming DataFrames. ``whole`` names steps whose every batch is the whole result; ``queries`` has those of joins, which run already, with their waits in milliseconds."""

    def __init__(self, *args, **more):
        super().__init__(*args, **more)
        self.whole: set[str] = set()
        self.queries: list[tuple] = []
        self.fetching: list[threading.Thread] = []
        self.errors: list[BaseException] = []

    def lower(self) -> dict[str, DataFrame]:
        pipeline.use_rocksdb(self.spark)
        return super().lower()

    @property
    def folder(self) -> str:
        return f"{self.state_dir}/streams/{self.run_id}"

    def _inherit(self, step: spec.Step) -> None:
        if self.whole & set(step.upstream()):
            self.whole.add(step.id)

    def _file(self, step: spec.Step) -> DataFrame:
        name, path = step.input.from_connection or "", step.input.path or ""
        for known in (f"{name}/{path}", path, name):
            if known in self.tables:
                return self.tables[known]
        return connectors.read_stream(self.spark, self.registry.get(name).uri(path))

    def _fetched(self, step: spec.Step, connection: spec.Connection, asked: DataFrame) -> DataFrame:
        ledger = Ledger(self.spark, f"{self.state_dir}/{step.id}", self.run_id)
        self.ledgers[step.id] = ledger
        self._enqueue(ledger, asked)

        def work() -> None:
            try:
                self._rounds(step, connection, ledger)
            except BaseException as e:  # noqa: BLE001
                self.errors.append(e)

        self.fetching.append(threading.Thread(target=work, daemon=True))
        events = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(ledger.folder)
        self.dead_letters[step.id] = events.where("status = 'failed'").select("request_id", "step_id", "url", F.col("response_status").alias("status_code"), F.col("response_body").alias("error"))
        return self._responses(events.where("status = 'done'"))

    def _transform(self, step: spec.Step) -> None:
        self._inherit(step)
        df, f = self._input(step), step.function
        if not df.isStreaming:
            super()._transform(step)
        elif df.columns == ["body"] or {"body", "status_code", "request_id"} <= set(df.columns):
            self.frames[step.id] = transform.transform(df.select("body"), f.entrypoint, f.schema, f.row_preserving, step.parallel, bodies=True)
        else:
            self.frames[step.id] = transform.transform(df, f.entrypoint, f.schema, f.row_preserving, step.parallel)

    def _filter(self, step: spec.Step) -> None:
        self._inherit(step)
        super()._filter(step)

    def _unnest(self, step: spec.Step) -> None:
        self._inherit(step)
        super()._unnest(step)

    def _sink(self, step: spec.Step) -> None:
        self._inherit(step)
        super()._sink(step)

    def _aggregate(self, step: spec.Step) -> None:
        self._inherit(step)
        super()._aggregate(step)
        if self.frames[step.id].isStreaming:
            self.whole.add(step.id)

    def _join(self, step: spec.Step) -> None:
        self._inherit(step)
        inputs = {n: self._named(n) for n in step.input.inputs}
        if not any(df.isStreaming for df in inputs.values()):
            super()._join(step)
            return
        key, policy, first = step.join.key, step.join.on_timeout, step.input.inputs[0]
        rows, keyless = None, []
        for name, df in inputs.items():
            payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"} | _STAMPS).alias("payload")
            one = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.lit(name).alias("source"), payload)
            rows = one.where("key is not null") if rows is None else rows.unionByName(one.where("key is not null"))
            if step.join.join != "left" or name == first:
                keyless.append(one.where("key is null"))
        wait = int(seconds(step.join.timeout) * 1000)
        at = f"{self.folder}/{step.id}"
        self.queries.append((_start(pipeline.keyed_readiness(rows, list(inputs), wait), f"{at}/decided", "parquet", f"{at}/checkpoint", False), wait))
        pipeline.wait_for(self.spark, f"{at}/decided/_spark_metadata", self.queries[-1][0])
        decided = self.spark.readStream.schema(pipeline.KeyedReadiness.OUTPUT).parquet(f"{at}/decided")
        decided = decided.withColumn("have", F.from_json("payloads", "map<string,string>"))
        ready, has_first = F.col("outcome") == "ready", F.element_at("have", first).isNotNull()
        passed = has_first if step.join.join == "left" else F.lit(True) if policy == "emit_null" else ready
        names = joins._distinct_names(inputs, key)
        kinds = {n: df.schema for n, df in inputs.items()}
        parts = decided.where(passed).select(*[F.from_json(F.element_at("have", n), kinds[n], _STAMPS).alias(f"__{i}") for i, n in enumerate(inputs)])
        columns = [F.coalesce(*[F.col(f"__{i}.`{key}`") for i in range(len(inputs))]).alias(key)]
        for i, (n, renamed) in enumerate(zip(inputs, names, strict=True)):
            columns += [F.col(f"__{i}.`{was}`").alias(now) for was, now in zip(inputs[n].columns, renamed.columns, strict=True) if was != key]
        self.frames[step.id] = parts.select(*columns)
        if policy == "dead_letter":
            late = decided.where(~ready & (has_first if step.join.join == "left" else F.lit(True)))
            letters = late.select("key", F.array_sort(F.map_keys("have")).alias("sources"), F.explode("have").alias("source", "payload")).select("key", "source", "sources", "payload")
            for one in keyless:
                letters = letters.unionByName(one.select("key", "source", F.array("source").alias("sources"), "payload"))
            self.dead_letters[step.id] = letters


def run_stream(spark: SparkSession, document: str | dict | spec.Pipeline, most_sec: float = 3600, **more) -> Report:
    """Runs a pipeline as a stream until all there is has been worked through; TimeoutError after ``most_sec``."""
    began, report = time.monotonic(), Report()
    store = spark.conf.get(pipeline.STATE_STORE, None)
    try:
        low = StreamLowering(spark, load(document), **more)
        report.dag_run_id = low.run_id
        low.lower()
        queries, state = low.queries, low.folder
        for step, df in low.sinks:
            path = low.path_of(step)
            if path and df.isStreaming:
                queries.append((_start(df, path, step.output.format, f"{state}/{step.id}/checkpoint", step.id in low.whole), 0))
            elif path:
                sink.write(df, path, step.output.format)
            report.outputs[step.id] = path
        for name, df in low.dead_letters.items():
            path = f"{state}/{name}/dead_letters"
            if df.isStreaming:
                queries.append((_start(df, path, "jsonl", f"{state}/{name}/dead_letters_checkpoint", False), 0))
            report.outputs[f"{name}.dead_letters"] = path
        for t in low.fetching:
            t.start()
        for t in low.fetching:
            t.join(max(0.0, most_sec - (time.monotonic() - began)))
        if low.errors:
            raise low.errors[0]
        for q, wait in queries:
            pipeline.settle(q, wait, max(1.0, most_sec - (time.monotonic() - began)))
        for ledger in low.ledgers.values():
            _count(report, ledger)
        report.success = True
    except Exception as e:  # noqa: BLE001
        report.error_message = str(e)
        log.error("%s", e)
    finally:
        for q in spark.streams.active:
            if q.name and q.name.startswith("millrace-"):
                q.stop()
        spark.conf.unset(pipeline.STATE_STORE) if store is None else spark.conf.set(pipeline.STATE_STORE, store)
    report.elapsed_sec = time.monotonic() - began
    return report


def _start(df: DataFrame, path: str, fmt: str, checkpoint: str, whole: bool):
    name = f"millrace-{abs(hash(checkpoint))}"
    if whole:
        # Every batch is the whole result and replaces the one before.
        return df.writeStream.queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: sink.write(batch, path, fmt) and None).start()
    shaped, kind, options = sink.formatted(df, fmt)
    return shaped.writeStream.queryName(name).outputMode("append").format(kind).options(**options).option("path", path).option("checkpointLocation", checkpoint).start()
