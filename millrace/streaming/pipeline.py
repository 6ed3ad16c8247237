"""The streaming forms of the operators: micro-batches in place of hand-made queues.

``run_available`` works through everything a source has now and ends, as a batch pipeline does; results equal those of one batch.
Filter, unnest and transform need no streaming form: they are the same functions on a streaming DataFrame.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.session import scratch
from millrace.operators.aggregate import aggregate
from millrace.plans.spec import Aggregate


def _start(df: DataFrame, checkpoint: str, name: str, output_mode: str):
    """A query into a folder of its own over all that is available, and what it has written there."""
    path = scratch(df.sparkSession, "streams")
    w = df.writeStream.queryName(name).outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if output_mode == "append":
        q = w.format("parquet").option("path", f"{path}/out").start()
    else:
        # Every batch is the whole result and replaces the one before.
        q = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
    return q, f"{path}/out"


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(df.schema).parquet(path) if exists else spark.createDataFrame([], df.schema)


def run_available(df: DataFrame, checkpoint: str, name: str, output_mode: str = "append") -> DataFrame:
    """Runs a streaming DataFrame over all that is available; gives what it has written."""
    q, path = _start(df, checkpoint, name, output_mode)
    q.awaitTermination()
    return _written(df, path)


def into_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Runs over all that is available and appends to files, each input exactly once across restarts."""
    df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def each_batch(df: DataFrame, checkpoint: str, action: Callable[[DataFrame, int], None]) -> None:
    """Runs an action per micro-batch; the batch's number lets it recognise a batch it has done before."""
    df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_aggregate(df: DataFrame, group_by: Sequence[str], aggregates: Iterable[Aggregate]) -> DataFrame:
    """The aggregate over a stream: state per group, final results in complete mode. Equal to the batch form."""
    return aggregate(df, group_by, aggregates)


def windowed(df: DataFrame, time: str, size: str, late: str, group_by: Sequence[str], aggregates: Iterable[Aggregate], slide: str | None = None) -> DataFrame:
    """Aggregates per event-time window (tumbling, or sliding with ``slide``); rows later than ``late`` are dropped."""
    t = F.col(time).cast("timestamp")
    marked = df.withColumn(time, t).withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    # The window itself is the key, as it carries the watermark.
    out = aggregate(marked.withColumn("__w", w), ["__w", *group_by], aggregates, preserve_key_types=True)
    rest = [c for c in out.columns if c != "__w"]
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *rest)


def stream_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, timeout: str, how: str = "inner") -> DataFrame:
    """Joins two streams on a key where both rows come within ``timeout`` of each other by event time; state older than that goes."""
    a = left.withColumn("__lt", F.col(left_time).cast("timestamp")).withWatermark("__lt", timeout)
    b = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns}).withColumn("__rt", F.col(f"{right_time}_right").cast("timestamp")).withWatermark("__rt", timeout)
    near = F.expr(f"__rt >= __lt - interval {timeout} and __rt <= __lt + interval {timeout}")
    return a.join(b, (a[key] == b[f"{key}_right"]) & near, how).drop("__lt", "__rt")


class KeyedReadiness(StatefulProcessor):
    """Holds rows of a key until all sources have delivered, then passes them on; after the timeout the key's rows go to the dead letters.

    Input rows: (key, source, payload). Output: (key, outcome, n_sources, payloads): outcome ``ready`` or ``dead_letter``,
    payloads a JSON object by source. Each source's latest row of a key counts. Processing time, as the timeout is a wait.
    """

    OUTPUT = "key string, outcome string, n_sources int, payloads string"

    def __init__(self, sources: Sequence[str], timeout_ms: int):
        self.sources, self.timeout_ms = tuple(sources), timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "source string", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                self.rows.updateValue((r.source,), (r.payload,))
        have = {k[0]: v[0] for k, v in self.rows.iterator()}
        if set(self.sources) <= have.keys():
            self._forget()
            yield self._out(key[0], "ready", have)
        elif not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        have = {k[0]: v[0] for k, v in self.rows.iterator()}
        if have:
            self._forget()
            yield self._out(key[0], "dead_letter", have)

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.rows.clear()

    def _out(self, key, outcome: str, have: dict) -> pd.DataFrame:
        import json

        return pd.DataFrame({"key": [key], "outcome": [outcome], "n_sources": [len(have)], "payloads": [json.dumps(have, sort_keys=True)]})

    def close(self) -> None:
        pass


def keyed_readiness(rows: DataFrame, sources: Sequence[str], timeout_ms: int) -> DataFrame:
    """The streaming join of any number of sources with a dead-letter outcome; needs the RocksDB state store.

    rows: a stream of (key, source, payload). Unfinished keys at the end of a bounded run are found by ``operators.join.dead_letter``.
    """
    grouped = rows.select(F.col("key").cast("string").alias("key"), "source", "payload").groupBy("key")
    return grouped.transformWithStateInPandas(KeyedReadiness(sources, timeout_ms), KeyedReadiness.OUTPUT, "Append", "ProcessingTime")


def run_with_timeouts(df: DataFrame, checkpoint: str, name: str, timeout_ms: int, most_sec: float = 600) -> DataFrame:
    """Runs a stream with processing-time timers over all that is available, waits until timers set by the last row are due, and ends.

    Such a query doesn't end by itself: it goes on with empty batches as long as there may be timers. TimeoutError after ``most_sec``.
    """
    q, path = _start(df, checkpoint, name, "append")
    settle(q, timeout_ms, most_sec)
    return _written(df, path)


def wait_for(spark: SparkSession, path: str, q, most_sec: float = 60) -> None:
    """Waits until a query that has been started has made a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, end = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), time.monotonic() + most_sec
    while not fs.exists(at):
        if q.exception():
            raise q.exception()
        if time.monotonic() > end:
            raise TimeoutError(f"{path} wasn't made")
        time.sleep(0.02)


def settle(q, timeout_ms: int, most_sec: float = 600) -> None:
    """Waits until a query has worked through what there is, and timers set by the last row are due; then stops it."""
    began, last_data, empty_after = time.monotonic(), time.monotonic(), 0
    seen = -1
    try:
        if not timeout_ms:
            if q.isActive:
                q.processAllAvailable()
            return
        while q.isActive:
            if time.monotonic() - began > most_sec:
                raise TimeoutError(f"stream {q.name} went on for more than {most_sec} s")
            p = q.lastProgress
            if p is not None and p["batchId"] != seen:
                seen = p["batchId"]
                if p["numInputRows"]:
                    last_data, empty_after = time.monotonic(), 0
                elif time.monotonic() - last_data > timeout_ms / 1000:
                    # The second batch that begins after the timers were due has seen them all.
                    empty_after += 1
                    if empty_after > 2:
                        break
            time.sleep(0.02)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
