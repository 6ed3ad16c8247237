"""The durable ledger of requests: an append log of states in Parquet, one folder per run.

A request's current state is its event with the greatest ``seq``. Nothing is updated in place, so the log can be written by many
tasks and read at any time; ``resume`` makes every request that was under way pending again and leaves finished ones alone.
What is pending is divided into rounds once, so a round reads and writes its own requests only, however long the log has grown;
states are found without reading bodies. Rows without seq are the oldest; copies of a row count once; an empty log has no requests.
Secrets never enter the ledger: headers with credentials are added by the fetching task.
"""

from __future__ import annotations

import itertools
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.session import cut, scratch, tasks_of

SCHEMA = """seq long, request_id string, dag_run_id string, step_id string, method string, url string, headers string, body string, status string,
retry_count int, created_at timestamp, started_at timestamp, completed_at timestamp, response_status int, response_body string, result_path string"""

STATES = ("pending", "inflight", "done", "failed", "skipped")
FINISHED = ("done", "failed", "skipped")


def request_ids(requests: DataFrame) -> DataFrame:
    """Requests with a request_id: the same for the same run, step, method, url and body, so that a rerun finds what it has done."""
    made = F.substring(F.sha2(F.concat_ws("\x1f", "dag_run_id", "step_id", "method", "url", F.coalesce("body", F.lit(""))), 256), 1, 24)
    given = F.col("request_id") if "request_id" in requests.columns else F.lit(None).cast("string")
    return requests.withColumn("request_id", F.coalesce(F.when(given != "", given), made))


def current(events: DataFrame) -> DataFrame:
    """The current row of every request (by run and id). Copies of a row count once; rows without seq are the oldest."""
    rest = [c for c in events.columns if c not in ("dag_run_id", "request_id")]
    top = events.groupBy("dag_run_id", "request_id").agg(F.max(F.struct("seq", *[F.col(c) for c in rest if c != "seq"])).alias("top"))
    return top.select("dag_run_id", "request_id", *[F.col(f"top.`{c}`").alias(c) for c in rest])


def counts(events: DataFrame) -> DataFrame:
    """(dag_run_id, status, n): requests by current state."""
    return current(events).groupBy("dag_run_id", "status").agg(F.count(F.lit(1)).alias("n"))


def resumable(events: DataFrame) -> DataFrame:
    """The requests that a restarted run still has to make, as pending: those pending or under way."""
    return current(events).where(~F.col("status").isin(*FINISHED)).withColumn("status", F.lit("pending")).withColumn("started_at", F.lit(None).cast("timestamp"))


class Ledger:
    """The ledger of one run in a folder that all executors share. One process writes it at a time."""

    def __init__(self, spark: SparkSession, folder: str, dag_run_id: str):
        self.spark, self.run = spark, dag_run_id
        self.folder = f"{folder.rstrip('/')}/dag_run_id={dag_run_id}"
        self.flushed_at, self.unflushed = time.monotonic(), []
        self._top: int | None = None
        self._plan = ""

    def events(self, columns: list[str] | None = None) -> DataFrame:
        """All events of the run; none before the first append."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMA).select(*columns or ["*"])
        return self._read(self.folder).select(*columns or ["*"])

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(*paths)

    def states(self) -> DataFrame:
        """(dag_run_id, request_id, seq, status, retry_count): the current state of every request, without the rest of its row."""
        return current(self.events(["seq", "dag_run_id", "request_id", "status", "retry_count"]))

    def rows_in(self, *states: str) -> DataFrame:
        """The current rows of the requests in these states."""
        wanted = self.states().where(F.col("status").isin(*states)).select("request_id", "seq", F.lit(1).alias("__hit"))
        return self.events().join(wanted, ["request_id", "seq"]).dropDuplicates(["request_id"]).drop("__hit")

    def _append(self, events: DataFrame) -> str:
        known = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMA).schema}
        cells = [(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in known.items()]
        path = f"{self.folder}/append-{uuid.uuid4().hex}"
        events.select(*cells).write.parquet(path)
        self._top = max(self._next() - 1, self._read(path).agg(F.max("seq")).first()[0] or 0)
        return path

    def _next(self) -> int:
        if self._top is None:
            self._top = self.events(["seq"]).agg(F.max("seq")).first()[0] or 0
        return self._top + 1

    def enqueue(self, requests: DataFrame) -> int:
        """Adds requests as pending, in the order of their partitions; those the ledger has stay as they are. Gives the number added."""
        known = self.events(["request_id"]).distinct()
        base = self._next()
        # The order is noted before rows with the same id are dropped, of which the first stays.
        placed = request_ids(requests.withColumn("dag_run_id", F.lit(self.run))).withColumn("seq", F.monotonically_increasing_id() + base)
        rest = [c for c in placed.columns if c not in ("request_id", "seq")]
        first = placed.groupBy("request_id").agg(F.min(F.struct("seq", *rest)).alias("r")).select("request_id", "r.*")
        rows = first.join(known, "request_id", "left_anti").withColumns({"status": F.lit("pending"), "retry_count": F.lit(0), "created_at": F.current_timestamp()})
        return self._read(self._append(rows)).count()

    def _begin(self, rows: DataFrame) -> None:
        self._append(rows.withColumn("seq", F.monotonically_increasing_id() + self._next()).withColumns({"status": F.lit("inflight"), "started_at": F.current_timestamp()}))

    def take(self, most: int | None = None) -> DataFrame:
        """Pending requests, first in first out, marked as under way; gives all that are."""
        waiting = self.rows_in("pending")
        self._begin(waiting.orderBy("seq").limit(most) if most is not None else waiting)
        return self.rows_in("inflight")

    def plan(self, size: int) -> int:
        """Divides all that is pending into rounds of at most ``size`` requests, first in first out; gives their number."""
        waiting = self.rows_in("pending")
        spread = cut(waiting.repartitionByRange(tasks_of(self.spark), "seq").withColumn("__part", F.spark_partition_id()))
        sums = {r["__part"]: r["n"] for r in spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row to a task
        before = dict(zip(sorted(sums), itertools.accumulate((sums[p] for p in sorted(sums)), initial=0), strict=False))
        if not sums:
            return 0
        shift = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("__part"))
        place = F.row_number().over(Window.partitionBy("__part").orderBy("seq", "request_id")) - 1 + shift
        self._plan = scratch(self.spark, "rounds")
        spread.withColumn("round", F.floor(place / F.lit(size)).cast("long")).drop("__part").write.mode("overwrite").partitionBy("round").parquet(self._plan)
        return -(-sum(sums.values()) // size)

    def begin_round(self, number: int) -> DataFrame:
        """The requests of a round of the plan, marked as under way."""
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self._plan}/round={number}")
        self._begin(rows)
        return rows

    def finish(self, responses: DataFrame, status: str | None = None, taken: DataFrame | None = None) -> str:
        """Notes responses (request_id, status_code, body, ok, error, attempts) to the requests ``taken`` (all that are under way): done or
        failed by ``ok``, or the given state."""
        now = taken if taken is not None else self.rows_in("inflight")
        answers = responses.dropDuplicates(["request_id"]).select("request_id", "status_code", F.col("body").alias("__body"), "ok", "error", "attempts")
        joined = now.drop("status", "response_status", "response_body", "retry_count", "completed_at").join(answers, "request_id")
        state = F.lit(status) if status else F.when(F.col("ok"), F.lit("done")).otherwise(F.lit("failed"))
        rows = joined.withColumns({
            "seq": F.monotonically_increasing_id() + self._next(), "status": state, "response_status": F.col("status_code"), "response_body": F.when(F.col("ok"), F.col("__body")).otherwise(F.col("error")),
            "retry_count": F.greatest(F.col("attempts") - 1, F.lit(0)), "completed_at": F.current_timestamp(),
        })
        path = self._append(rows)
        self.unflushed.append(path)
        return path

    def resume(self) -> int:
        """Makes requests that were under way pending again; gives their number."""
        stuck = self.rows_in("inflight").withColumns({"seq": F.monotonically_increasing_id() + self._next(), "status": F.lit("pending"), "started_at": F.lit(None).cast("timestamp")})
        return self._read(self._append(stuck)).count()

    def count(self, status: str) -> int:
        return self.states().where(F.col("status") == status).count()

    def exhausted(self) -> bool:
        return self.states().where(~F.col("status").isin(*FINISHED)).isEmpty()

    def flush(self, path: str, keep_failed: bool = True, fmt: str = "json.gz") -> int:
        """Archives what has finished since the last flush; gives the number of rounds it holds."""
        done, self.unflushed, self.flushed_at = self.unflushed, [], time.monotonic()
        if done:
            self._archive(self._read(*done), path, keep_failed, fmt)
        return len(done)

    def archive(self, path: str, keep_failed: bool = True, fmt: str = "json.gz") -> DataFrame:
        """Writes the finished requests under a folder per day; failed ones too if they are to be kept."""
        self.unflushed, self.flushed_at = [], time.monotonic()
        return self._archive(self.rows_in(*FINISHED), path, keep_failed, fmt)

    def _archive(self, rows: DataFrame, path: str, keep_failed: bool, fmt: str) -> DataFrame:
        kept = ("done", "failed", "skipped") if keep_failed else ("done", "skipped")
        rows = rows.where(F.col("status").isin(*kept))
        day = F.date_format(F.coalesce("completed_at", "created_at"), "yyyy-MM-dd").alias("day")
        if fmt == "parquet":
            rows.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)
        else:
            text = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value")
            rows.select(day, text).write.mode("append").option("compression", "gzip" if fmt.endswith("gz") else "none").partitionBy("day").text(path)
        return rows

    @staticmethod
    def expire(spark: SparkSession, path: str, retention_days: int, today: str) -> list[str]:
        """Deletes the archive's days that are older than so many days before ``today`` (YYYY-MM-DD); gives their names."""
        from datetime import date, timedelta

        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        oldest = (date.fromisoformat(today) - timedelta(days=retention_days)).isoformat()
        gone = []
        for x in fs.listStatus(at) if fs.exists(at) else []:
            name = x.getPath().getName()
            if name.startswith("day=") and name[4:] < oldest:
                fs.delete(x.getPath(), True)
                gone.append(name[4:])
        return sorted(gone)
