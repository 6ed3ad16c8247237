import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators.filter import filter_rows
from millrace.plans.spec import Aggregate, Condition
from millrace.streaming import pipeline


def source(spark, folder, df, files=3):
    df.repartition(files).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture(scope="module")
def events(spark):
    return spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 10 + 1_000_000_000).alias("ts"), (F.col("id") * 1.5).alias("v"))


@pytest.mark.parametrize("files", [1, 5])
def test_aggregate_equals_batch(spark, events, tmp_path, files):
    aggs = [Aggregate("n", "", "count"), Aggregate("s", "v", "sum"), Aggregate("p", "v", "percentile", 90)]
    got = pipeline.run_available(pipeline.stream_aggregate(source(spark, tmp_path / "in", events, files), ["k"], aggs), str(tmp_path / "cp"), f"agg{files}", "complete")
    rounded = lambda df: rows(df.withColumn("p", F.round("p", 9)))
    assert rounded(got) == rounded(pipeline.stream_aggregate(events, ["k"], aggs))


def test_files_exactly_once(spark, events, tmp_path):
    s = source(spark, tmp_path / "in", events)
    kept = filter_rows(s, [Condition("k", "neq", "1")])
    for _ in range(2):
        pipeline.into_files(kept, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id")) == rows(events.where("k <> '1'").select("id"))
    events.limit(10).write.mode("append").parquet(str(tmp_path / "in"))
    pipeline.into_files(kept, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200 + events.limit(10).where("k <> '1'").count()


def test_windows(spark, events, tmp_path):
    w = pipeline.windowed(source(spark, tmp_path / "in", events, 1), "ts", "100 seconds", "10 seconds", ["k"], [Aggregate("n", "", "count")])
    got = pipeline.run_available(w, str(tmp_path / "cp"), "win", "append")
    assert {r.n for r in got.collect()} == {3, 4} and got.agg(F.sum("n")).first()[0] >= 270


def test_join(spark, events, tmp_path):
    a = source(spark, tmp_path / "a", events, 1)
    b = source(spark, tmp_path / "b", events.where("id % 2 = 0"), 1)
    got = pipeline.run_available(pipeline.stream_join(a, b, "id", "ts", "ts", "30 seconds"), str(tmp_path / "cp"), "joined")
    assert rows(got.select("id")) == rows(events.where("id % 2 = 0").select("id"))


def test_each_batch(spark, events, tmp_path):
    seen = []
    pipeline.each_batch(source(spark, tmp_path / "in", events, 4), str(tmp_path / "cp"), lambda df, n: seen.append((n, df.count())))
    assert [n for n, _ in seen] == list(range(len(seen))) and sum(c for _, c in seen) == 300 and len(seen) == 4


def test_keyed_readiness(spark, tmp_path):
    pipeline.use_rocksdb(spark)
    data = [("1", "a", "x"), ("2", "a", "y"), ("1", "b", "z"), ("3", "b", "w"), ("1", "c", "v")]
    s = source(spark, tmp_path / "in", spark.createDataFrame(data, "key string, source string, payload string"), 1)
    try:
        got = pipeline.run_with_timeouts(pipeline.keyed_readiness(s, ["a", "b", "c"], 6000), str(tmp_path / "cp"), "ready", 6000, 60).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {(r.key, r.outcome, r.n_sources, r.payloads) for r in got} == {("1", "ready", 3, '{"a": "x", "b": "z", "c": "v"}'), ("2", "dead_letter", 1, '{"a": "y"}'), ("3", "dead_letter", 1, '{"b": "w"}')}
