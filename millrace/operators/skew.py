"""Per-key results where a few keys hold most of the rows.

One pass counts the rows of every bucket of keys (a slice of the key's hash) and finds its frequent keys by a mergeable sketch. From
that a plan is made: keys of some weight are packed to tasks by load, one too large for a task is split into shards in
proportion to its load, and what is left of each bucket is packed likewise. Rows go to their task by the plan; the other side of a
join is copied to the shards of split keys only. Everything that reaches the driver, or is broadcast, grows with the number
of tasks, never with rows or keys.

Null keys are a key like any other in aggregates and match nothing in joins; they are spread over all tasks. Keys that the sketch
misses are packed with their bucket, so an estimate that is off costs balance, never rows. An empty table has an empty result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.session import tasks_of

#: Buckets of keys to a task. A key is named in a plan if it has more than 1 / BUCKETS of a task's fair share.
BUCKETS = 8
#: Keys that the sketch of a bucket tracks, and keys that it may name. Its error is at most about 3.5 / TRACKED of the bucket's rows.
TRACKED, NAMED = 4096, 64
#: A key is split if its load is more than this part of a task's fair share.
FULL = 0.5


@dataclass
class Loads:
    """rows: in all; nulls: without a key; buckets: rows of each bucket; keys: estimated rows and bucket of each key of some weight."""

    tasks: int
    rows: int = 0
    nulls: int = 0
    buckets: list[int] = field(default_factory=list)
    keys: dict[str, tuple[int, int]] = field(default_factory=dict)


@dataclass
class Plan:
    """Which task each key, or shard of a key, belongs to. ``shards``: tasks of the shards of each named key (one: it isn't split)."""

    tasks: int
    rows: int
    shards: dict[str, list[int]] = field(default_factory=dict)
    buckets: list[int] = field(default_factory=list)
    loads: list[float] = field(default_factory=list)


def _text(df: DataFrame, keys: str | list[str]) -> Column:
    """The text by which a plan knows a key; equal keys have equal texts. Null if one of the columns is null."""

    def one(k: str) -> Column:
        c = F.col(f"`{k}`")
        # 0.0 and -0.0 are equal.
        return (c + F.lit(0.0) if isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType)) else c).cast("string")

    names = [keys] if isinstance(keys, str) else keys
    return one(names[0]) if len(names) == 1 else F.concat(*[x for k in names for x in (one(k), F.lit("\x1f"))])


def _bucket(text: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(n)).cast("int")


def estimate_loads(df: DataFrame, keys: str | list[str], tasks: int) -> Loads:
    """Loads of a key (of one or several columns), in one pass; about a row to a bucket is shuffled and at most BUCKETS keys to a task come here."""
    text = df.select(_text(df, keys).alias("k"))
    each = text.groupBy(_bucket(F.col("k"), tasks * BUCKETS).alias("b"), F.col("k").isNull().alias("null"))
    found = each.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {NAMED}, {TRACKED})").alias("top"))
    whole = Window.partitionBy()  # over the buckets, not the rows
    named = F.filter("top", lambda x: x["item"].isNotNull() & (x["count"] * (tasks * BUCKETS) > F.sum("n").over(whole)))
    out = Loads(tasks, buckets=[0] * (tasks * BUCKETS))
    for r in found.withColumn("top", named).collect():
        out.rows += r.n
        if r.null:
            out.nulls += r.n
            continue
        out.buckets[r.b] += r.n
        out.keys |= {x["item"]: (x["count"], r.b) for x in r.top or []}
    return out


def make_plan(loads: Loads) -> Plan:
    """Packs keys and buckets to tasks, largest piece first, each to the task with least load so far."""
    tasks, share = loads.tasks, max(1.0, loads.rows / loads.tasks)
    plan = Plan(tasks, loads.rows, buckets=[0] * (tasks * BUCKETS), loads=[loads.nulls / tasks] * tasks)
    pieces: list[tuple[float, int, str | None]] = []
    rest = list(loads.buckets) or [0] * (tasks * BUCKETS)
    for k, (n, bucket) in loads.keys.items():
        parts = min(tasks, max(1, math.ceil(n / (FULL * share))))
        plan.shards[k] = []
        rest[bucket] -= n
        pieces += [(n / parts, i, k) for i in range(parts)]
    pieces += [(float(max(0, n)), i, None) for i, n in enumerate(rest)]
    heap = [(plan.loads[t], t) for t in range(tasks)]
    for n, i, k in sorted(pieces, key=lambda x: (-x[0], x[2] or "", x[1])):
        load, t = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, t))
        plan.loads[t] = load + n
        if k is None:
            plan.buckets[i] = t
        else:
            plan.shards[k].append(t)
    return plan


def plan_for(df: DataFrame, keys: str | list[str], tasks: int | None = None) -> Plan:
    return make_plan(estimate_loads(df, keys, tasks or tasks_of(df.sparkSession)))


def _spread() -> Column:
    # The position of a row in its partition: even for copies of a row, where a hash of the columns isn't.
    return F.monotonically_increasing_id()


def place(df: DataFrame, keys: str | list[str], plan: Plan, spread: Column | None = None) -> DataFrame:
    """df with __shard (number of the row's shard of its key) and __task. spread: a number that decides between shards."""
    named = F.broadcast(df.sparkSession.createDataFrame(list(plan.shards.items()), "__n string, __tasks array<int>"))  # at most BUCKETS keys to a task
    rows = df.withColumns({"__k": _text(df, keys), "__spread": _spread() if spread is None else spread})
    rows = rows.join(named, F.col("__k") == F.col("__n"), "left")
    # Null has no partner in joins, and aggregates combine its shards.
    of_null = F.when(F.col("__k").isNull(), F.pmod("__spread", F.lit(plan.tasks)))
    shard = F.coalesce(of_null, F.pmod("__spread", F.size("__tasks")), F.lit(0)).cast("int")
    light = F.element_at(F.lit(plan.buckets), _bucket(F.col("__k"), len(plan.buckets)) + 1)
    task = F.when(F.col("__k").isNull(), F.col("__shard")).when(F.col("__tasks").isNotNull(), F.element_at("__tasks", F.col("__shard") + 1)).otherwise(light)
    return rows.withColumn("__shard", shard).withColumn("__task", task.cast("int")).drop("__k", "__n", "__tasks", "__spread")


def to_tasks(placed: DataFrame, plan: Plan) -> DataFrame:
    """Sends placed rows to exactly the partition that the plan says."""
    return placed.repartitionById(plan.tasks, F.col("__task"))


def balanced_aggregate(df: DataFrame, keys: str | list[str], partial: dict[str, Column], final: dict[str, Column], plan: Plan, spread: Column | None = None) -> DataFrame:
    """Aggregates by key: ``partial`` per key and shard in the tasks of the plan, then ``final`` over the shards of a key.

    The rows travel to their tasks, so df should have no columns but those needed; of the shards only a row each travels again.
    With ``spread`` equal numbers of a key share a shard, so a count of distinct values adds up if that is a hash of the value.
    """
    names = [keys] if isinstance(keys, str) else keys
    placed = to_tasks(place(df, names, plan, spread), plan)
    first = placed.groupBy("__task", *names, "__shard").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*names).agg(*[c.alias(n) for n, c in final.items()])


def _of_one_type(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the key in the type in which a join compares them."""
    a, b = left.schema[key].dataType, right.schema[key].dataType
    if a == b:
        return left, right
    if isinstance(a, (T.StringType, T.BinaryType)) or isinstance(b, (T.StringType, T.BinaryType)):
        raise ValueError(f"keys of {a.simpleString()} and {b.simpleString()}: cast one of them")
    common = left.sparkSession.range(0).select(F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b)).alias("k")).schema["k"].dataType
    return tuple(df.withColumn(key, F.col(f"`{key}`").cast(common)) for df in (left, right))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, plan: Plan | None = None, how: str = "inner") -> DataFrame:
    """Joins rows of ``left`` (inner or left) with the matching rows of ``right``, which is copied to the shards of split keys only.

    Both sides have the column ``key``, which comes out once, in the wider of both types (text only meets text). Other columns of
    ``right`` whose names also occur in ``left`` come out with the suffix ``_right``. plan: of the left side; made here if there is none.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"fragment_replicate_join can't do {how!r}")
    clash = {c: f"{c}_right" for c in right.columns if c != key and c in left.columns}
    left, right = _of_one_type(left, right.withColumnsRenamed(clash), key)
    plan = plan or plan_for(left, key)
    split = F.broadcast(left.sparkSession.createDataFrame([(k, len(t)) for k, t in plan.shards.items() if len(t) > 1], "__n string, __of int"))
    copies = right.join(split, _text(right, key) == F.col("__n"), "left")
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__of") - 1, F.lit(0))))).drop("__n", "__of")
    copies = place(copies, key, plan, F.col("__copy")).drop("__copy")
    # Both sides are sent to the tasks of the plan, so the join needs no shuffle of its own.
    return to_tasks(place(left, key, plan), plan).join(to_tasks(copies, plan), ["__task", key, "__shard"], how).drop("__task", "__shard")


def key_shares(df: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Rows of each value of each key column: (field_name, field_value, rows, all_rows), for all columns in one scan. Null values have no row."""
    cells = [F.struct(F.lit(k).alias("field_name"), F.col(f"`{k}`").cast("string").alias("field_value")) for k in keys]
    # A null stays until it is counted, as all_rows counts every row.
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    loads = estimate_loads(long, ["field_name", "field_value"], tasks or tasks_of(df.sparkSession))
    counts = balanced_aggregate(long.where("field_value is not null"), ["field_name", "field_value"], {"n": F.count(F.lit(1))}, {"rows": F.sum("n")}, make_plan(loads))
    return counts.withColumn("all_rows", F.lit(loads.rows // len(keys)).cast("long"))
