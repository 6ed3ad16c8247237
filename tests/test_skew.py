import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators import skew


def data(n=4000, seed=2):
    rnd = random.Random(seed)
    return [(rnd.choices(["hot", "warm", None, str(rnd.randrange(300))], [40, 15, 5, 40])[0], i % 7) for i in range(n)]


def test_loads_and_plan(spark):
    d = data()
    loads = skew.estimate_loads(spark.createDataFrame(d, "k string, v int"), "k", 8)
    count, n = Counter(k for k, _ in d), len(d)
    assert loads.rows == n and loads.nulls == count[None] and sum(loads.buckets) == n - count[None]
    assert all(loads.keys[k][0] == count[k] for k in ("hot", "warm"))
    plan = skew.make_plan(loads)
    assert len(plan.shards["hot"]) > len(plan.shards["warm"]) > 1
    assert max(plan.loads) <= 1.25 * n / 8 and abs(sum(plan.loads) - n) < 1


def test_tasks_are_even(spark):
    # Copies of one row, which no hash of its columns could spread.
    d = [("hot", 1)] * 2000 + [(None, 1)] * 1000 + [(str(i % 50), 1) for i in range(1000)]
    df = spark.createDataFrame(d, "k string, v int").repartition(4)
    plan = skew.plan_for(df, "k", 8)
    placed = skew.to_tasks(skew.place(df, "k", plan), plan)
    sizes = dict(placed.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(sizes.values()) == len(d) and max(sizes.values()) < 1.1 * len(d) / 8
    assert placed.where(F.spark_partition_id() != F.col("__task")).count() == 0


def test_aggregate_against_brute_force(spark):
    d = data()
    df = spark.createDataFrame(d, "k string, v int").withColumn("__x", F.lit(1))
    got = skew.balanced_aggregate(df, "k", {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, skew.plan_for(df, "k", 5))
    want = {k: [0, 0] for k, _ in d}
    for k, v in d:
        want[k][0] += 1
        want[k][1] += v
    assert {r.k: [r.n, r.s] for r in got.collect()} == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_against_plain_join(spark, how):
    left = spark.createDataFrame(data(), "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), ("nobody", 4), (None, 5)], "k string, v int")
    got = skew.fragment_replicate_join(left, right, "k", skew.plan_for(left, "k", 6), how)
    assert got.columns == ["k", "v", "v_right"]
    assert rows(got) == rows(left.join(right.withColumnRenamed("v", "v_right"), "k", how))
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(left, right, "k", skew.Plan(2, 1), "full")


def test_join_needs_no_other_shuffle(spark):
    left = spark.createDataFrame(data(), "k string, v int")
    plan = skew.plan_for(left, "k", 6)
    text = skew.fragment_replicate_join(left, left.select("k").distinct(), "k", plan)._jdf.queryExecution().executedPlan().toString()
    assert text.count("shufflepartitionidpassthrough") == 2


def test_empty_and_ties(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert skew.key_shares(none, ["a", "b"]).count() == 0
    df = spark.createDataFrame([("x", "1"), ("y", "1"), (None, "1"), ("x", None)], "a string, b string")
    assert rows(skew.key_shares(df, ["a", "b"], 3)) == [("a", "x", 2, 4), ("a", "y", 1, 4), ("b", "1", 3, 4)]


def test_aggregates_run_in_the_tasks_of_the_plan(spark):
    df = spark.createDataFrame(data(), "k string, v int")
    plan = skew.plan_for(df, "k", 6)
    got = skew.balanced_aggregate(df, "k", {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, plan)
    text = got._jdf.queryExecution().executedPlan().toString()
    # One shuffle by the plan and one of the shards' results.
    assert text.count("shufflepartitionidpassthrough") == 1 and text.count("Exchange hashpartitioning") == 1


def test_many_tasks_stay_even(spark):
    """Rows of a task within 1.25 of the mean at 4,000 tasks, with keys of all weights from a third of the rows down."""
    n, tasks = 2_000_000, 4000
    u = F.rand(7)
    k = F.when(u < 0.33, 0).when(u < 0.5, F.floor(F.rand(8) * 900) + 1).when(u < 0.7, F.floor(F.rand(9) * 9000) + 1000).otherwise(F.col("id") + 100_000)
    df = spark.range(0, n, 1, 8).select(k.cast("long").alias("k"))
    plan = skew.plan_for(df, "k", tasks)
    sizes = skew.place(df, "k", plan).groupBy("__task").count().toPandas()["count"]
    assert sizes.sum() == n and len(sizes) == tasks and sizes.max() <= 1.25 * n / tasks
    assert len(plan.shards) <= skew.BUCKETS * tasks


@pytest.mark.parametrize(("a", "b"), [("int", "double"), ("decimal(5,1)", "decimal(9,3)"), ("date", "timestamp"), ("double", "double")])
def test_keys_of_two_types(spark, a, b):
    ids = spark.range(0, 60, 1, 3)
    of = lambda kind: {"date": "date_add(date'2024-01-01', cast(id % 5 as int))", "timestamp": "cast(date_add(date'2024-01-01', cast(id % 5 as int)) as timestamp)"}.get(kind, f"cast(id % 5 as {kind})")
    left = ids.selectExpr(f"{of(a)} as k", "id as v")
    right = ids.where("id < 10").selectExpr(f"{of(b)} * {'-1' if a == b else '1'} as k" if a not in ("date",) else f"{of(b)} as k", "id as w")
    plain = left.withColumnRenamed("k", "l").join(right, F.col("l") == F.col("k")).count()
    assert skew.fragment_replicate_join(left, right, "k", skew.plan_for(left, "k", 7)).count() == plain > 0
    assert skew.fragment_replicate_join(left, right, "k").count() == plain
    with pytest.raises(ValueError, match="cast one"):
        skew.fragment_replicate_join(left, right.withColumn("k", F.col("k").cast("string")), "k")


def test_distinct_values_of_a_split_key(spark):
    df = spark.range(0, 3000, 1, 4).selectExpr("if(id % 3 = 0, concat('k', id % 50), 'hot') as k", "id % 700 as v")
    plan = skew.plan_for(df, "k", 6)
    assert len(plan.shards["hot"]) > 1
    got = skew.balanced_aggregate(df, "k", {"n": F.count_distinct("v")}, {"n": F.sum("n")}, plan, spread=F.xxhash64("v"))
    assert rows(got) == rows(df.groupBy("k").agg(F.count_distinct("v").alias("n")))
