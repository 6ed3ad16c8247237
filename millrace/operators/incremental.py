"""Processing only new or changed records, by intervals of sequence numbers.

A log of records carries a growing sequence number. What has been processed is kept as a set of disjoint
closed intervals; a run subtracts it from the ranges that are there now, handles the rows in the gaps (new rows and
rows that were committed late alike), and commits the merged intervals together with its output.

Intervals never cross the edge of a block of ``BLOCK`` numbers, so every operation on sets of intervals is local to a
block: the work is spread evenly whatever the keys of the records are, and no task sees more than a block.

Rows without a number can't be processed by number: they are in no interval, and a run reports how many it saw. Copies of a row have one
number and come out together. An empty table has no interval.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sequence numbers to a block.
BLOCK = 1 << 16
INTERVALS = "block long, lo long, hi long"


def _block(c) -> F.Column:
    return F.floor(c / F.lit(BLOCK)).cast("long")


def intervals_of(df: DataFrame, seq: str) -> DataFrame:
    """The disjoint intervals (block, lo, hi) that cover exactly the numbers in the column ``seq``.

    Nulls are left out, repeated numbers count once, an empty table gives no interval.
    """
    s = df.select(F.col(f"`{seq}`").cast("long").alias("s")).where("s is not null").select(_block(F.col("s")).alias("block"), "s")
    # Sent to its block once: all that follows stays there.
    once = s.repartition("block").distinct()
    runs = once.withColumn("run", F.col("s") - F.row_number().over(Window.partitionBy("block").orderBy("s")))
    return runs.groupBy("block", "run").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select("block", "lo", "hi")


def ranges(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    """A few given ranges, cut at the edges of blocks."""
    df = spark.createDataFrame(pairs, "a long, b long").where("a <= b")
    cut = df.select("a", "b", F.explode(F.sequence(_block(F.col("a")), _block(F.col("b")))).alias("block"))
    lo, hi = F.greatest("a", F.col("block") * BLOCK), F.least("b", F.col("block") * BLOCK + BLOCK - 1)
    return merged(cut.select("block", lo.alias("lo"), hi.alias("hi")))


def _steps(df: DataFrame, name: str) -> DataFrame:
    """Where an interval begins (+1) and where it has ended (-1)."""
    step = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x")
    return df.select("block", step).select("block", "x.at", F.col("x.d").alias(name))


def _sweep(a: DataFrame, b: DataFrame | None, keep: F.Column) -> DataFrame:
    steps = _steps(a, "a").withColumn("b", F.lit(0))
    if b is not None:
        steps = steps.unionByName(_steps(b, "b").withColumn("a", F.lit(0)))
    # Sent to their block once; sums and windows then stay there. Steps of disjoint intervals are few and even.
    at = steps.repartition("block").groupBy("block", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("block").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = at.select("block", "at", F.sum("a").over(so_far).alias("in_a"), F.sum("b").over(so_far).alias("in_b"))
    # Only the points where membership turns matter, so that neighbours come out as one interval.
    turns = level.withColumn("inside", keep).withColumn("before", F.lag("inside", 1, False).over(w)).where("inside <> before")
    return turns.withColumn("hi", F.lead("at").over(w) - 1).where("inside").select("block", F.col("at").alias("lo"), "hi")


def merged(*sets: DataFrame) -> DataFrame:
    """The union of sets of intervals, disjoint again; overlaps and neighbours of a block become one interval."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return _sweep(every, None, F.col("in_a") > 0)


def subtract(available: DataFrame, processed: DataFrame) -> DataFrame:
    """The gaps: what is in ``available`` and not in ``processed``."""
    return _sweep(available, processed, (F.col("in_a") > 0) & (F.col("in_b") <= 0))


#: Intervals that are broadcast at most (24 bytes each); beyond, rows and intervals are merged block by block.
BROADCAST = 50_000


def rows_within(df: DataFrame, seq: str, intervals: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number lies in the (disjoint) intervals. Rows without a number are in none.

    Few intervals go to the rows, and their bounds to the scan. Otherwise both are merged by sorting within a block: the last
    interval that begins at or before a number either covers it or none does. Copies of a row come out as often as they stand there.
    """
    s = F.col(f"`{seq}`").cast("long")
    about = intervals.agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if not about.n:
        return df.limit(0)
    near = df.where(s.between(about.lo, about.hi))
    if about.n <= BROADCAST:
        sides = F.broadcast(intervals.select(F.col("block").alias("__block"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi")))
        return near.join(sides, (_block(s) == F.col("__block")) & s.between(F.col("__lo"), F.col("__hi")), "left_semi")
    names = df.columns
    rows = near.select(_block(s).alias("block"), s.alias("at"), F.lit(None).cast("long").alias("hi"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"))
    both = rows.unionByName(intervals.select("block", F.col("lo").alias("at"), "hi"), allowMissingColumns=True)
    w = Window.partitionBy("block").orderBy("at", F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("reach", F.max("hi").over(w)).where("r is not null and reach >= at").select("r.*")


def latest_per_key(df: DataFrame, key: list[str], order: list[str], state: list[str]) -> DataFrame:
    """One row per key with the state of the row that is greatest by ``order`` (nulls least; ties go to the greatest state)."""
    top = F.max(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*order, *state])])).alias("__top")
    return df.groupBy(*key).agg(top).select(*key, *[F.col(f"__top.`{c}`").alias(c) for c in state])


def current_rows(ledger: DataFrame, log: DataFrame, key: list[str], state: list[str], seq: str, order: list[str]) -> DataFrame:
    """(key..., seq, state..., seen) of the current row of every key of an append log, the one with the greatest number.

    For a consumer that has kept only keys and states so far, in ``log``: seen, if the log's last entry of the key (by ``order``) has the same
    state. One aggregation over both, which combines before the shuffle, so a key with most rows does no harm. Null is a key,
    and a state, like any other. Rows without a number, and what they superseded, don't count.
    """
    cells = lambda names: F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(names)])
    kind = ledger.select(cells([seq, *state])).schema[0].dataType
    logged = log.select(*key, F.lit(None).cast(kind).alias("__row"), cells([*order, *state]).alias("__log"))
    both = ledger.where(F.col(f"`{seq}`").isNotNull()).select(*key, cells([seq, *state]).alias("__row")).unionByName(logged, allowMissingColumns=True)
    top = both.groupBy(*key).agg(F.max("__row").alias("__row"), F.max("__log").alias("__log")).where("__row is not null")
    same = F.col("__log").isNotNull()
    for c in state:
        same = same & F.col(f"__row.`{c}`").eqNullSafe(F.col(f"__log.`{c}`"))
    return top.select(*key, *[F.col(f"__row.`{c}`").alias(c) for c in [seq, *state]], same.alias("seen"))


@dataclass
class Run:
    """What a run works on: its number, the gaps as they were when it began, the rows in them, how many rows had no number, and the files read."""

    number: int
    gaps: DataFrame
    rows: DataFrame
    unnumbered: int = 0
    files: list[tuple[str, int, int]] | None = None


FILES = "path string, size long, changed long"


class IntervalStore:
    """Processed intervals and outputs in a shared folder, committed together.

    A run writes ``run-<n>-<random>/output`` and ``.../intervals`` and then creates the file ``commits/<n>.json``, which
    names both. Only that last step makes a run count, and it succeeds for one writer only; what a broken run has left behind is
    never read, so its records are processed again, none twice and none left out. Of a folder of files the commit also names
    those that were read, so the next run opens new and changed files only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def _numbers(self) -> list[str]:
        at = self._path(f"{self.folder}/commits")
        return sorted(n for x in self._fs.listStatus(at) if (n := x.getPath().getName()).endswith(".json")) if self._fs.exists(at) else []

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/commits/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def head(self) -> dict | None:
        """The last commit."""
        names = self._numbers()
        return self._read(names[-1]) if names else None

    def processed(self) -> DataFrame:
        """The intervals of the last commit; none before the first."""
        head = self.head()
        return self.spark.read.schema(INTERVALS).parquet(head["intervals"]) if head else self.spark.createDataFrame([], INTERVALS)

    def outputs(self) -> list[str]:
        return [c["output"] for c in map(self._read, self._numbers()) if c["output"]]

    def adopt(self, processed: DataFrame) -> None:
        """Commits intervals that were processed before, without output: for a consumer that kept another kind of record so far."""
        run = Run(self._next(), processed, self.spark.createDataFrame([], "seq long"))
        self.commit(run, None)

    def _next(self) -> int:
        return 1 + ((self.head() or {"number": 0})["number"])

    def begin(self, df: DataFrame, seq: str, files: list[tuple[str, int, int]] | None = None) -> Run:
        """The rows not yet processed. The gaps are written down first, so rows that arrive meanwhile wait for the next run."""
        number = self._next()
        at = f"{self.folder}/run-{number}-{uuid.uuid4().hex}/gaps"
        subtract(intervals_of(df, seq), self.processed()).write.parquet(at)
        gaps = self.spark.read.schema(INTERVALS).parquet(at)
        return Run(number, gaps, rows_within(df, seq, gaps), df.where(F.col(f"`{seq}`").isNull()).count(), files)

    def begin_folder(self, folder: str, seq: str, schema) -> Run:
        """The same of a folder of Parquet files to which others add: only files are read that no commit has named, or that have changed since."""
        head = self.head()
        known = {tuple(r) for r in self.spark.read.schema(FILES).parquet(head["files"]).collect()} if head and head.get("files") else set()  # as many as the listing, which is here anyway
        now, listing = [], self._path(folder).getFileSystem(self._conf).listFiles(self._path(folder), True)
        while listing.hasNext():
            x = listing.next()
            if not x.getPath().getName().startswith(("_", ".")):
                now.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
        new = [f for f in now if f not in known]
        df = self.spark.read.schema(schema).parquet(*[f[0] for f in new]) if new else self.spark.createDataFrame([], schema)
        return self.begin(df, seq, now)

    def commit(self, run: Run, output: DataFrame | None) -> str:
        """Writes output and merged intervals and makes them count at once. Raises FileExistsError if another run has been faster."""
        at = f"{self.folder}/run-{run.number}-{uuid.uuid4().hex}"
        if output is not None:
            output.write.parquet(f"{at}/output")
        merged(self.processed(), run.gaps).write.parquet(f"{at}/intervals")
        made = {"number": run.number, "output": f"{at}/output" if output is not None else "", "intervals": f"{at}/intervals", "unnumbered": run.unnumbered}
        if run.files is not None:
            self.spark.createDataFrame(run.files, FILES).write.parquet(f"{at}/files")
            made["files"] = f"{at}/files"
        staged, final = self._path(f"{at}/commit.json"), self._path(f"{self.folder}/commits/{run.number:09d}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise FileExistsError(f"run {run.number} was committed by another writer")
        return made["output"]
