import math
import threading

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators import generate, sink, transform
from millrace.operators import join as joins
from millrace.operators.aggregate import aggregate
from millrace.operators.filter import filter_rows
from millrace.operators.unnest import project, unnest
from millrace.plans.reference import QUERIES
from millrace.plans.spec import Aggregate, Condition, Connection, JoinConfig, Parameter, RequestTemplate


@pytest.fixture(scope="module")
def batch(spark):
    status = ["Open", "Resolved", "Closed"]
    return spark.createDataFrame([(i, status[i % 3], i + 0.5, i % 2 == 0) for i in range(10)], "id long, status string, score double, even boolean")


@pytest.fixture(scope="module")
def tickets(spark):
    data = [("Alice", "P1", 3.0), ("Bob", "P2", 5.0), ("Alice", "P1", 7.0), ("Bob", "P1", 1.0), ("Alice", "P2", 5.0)]
    return spark.createDataFrame(data, "assignee string, priority string, cycle_time_days double")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(("conditions", "want"), [
    ([("status", "eq", "Resolved")], [1, 4, 7]),
    ([("status", "eq", "Resolved"), ("id", "gt", "3")], [4, 7]),
    ([("status", "neq", "Open"), ("status", "ne", "Closed")], [1, 4, 7]),
    ([("id", "lt", "3")], [0, 1, 2]),
    ([("id", "lte", "3"), ("id", "gte", "2")], [2, 3]),
    ([("score", "gt", "8.5")], [9]),
    ([("score", "eq", "2.5")], [2]),
    ([("status", "lt", "D")], [2, 5, 8]),
    ([("even", "eq", "true"), ("id", "gt", "5")], [6, 8]),
    ([("even", "neq", "1")], [1, 3, 5, 7, 9]),
    ([], list(range(10))),
    ([("status", "not_null", "")], list(range(10))),
    ([("status", "is_null", "")], []),
])
def test_filter(batch, conditions, want):
    for n in (1, 4, 16):
        assert ids(filter_rows(batch.repartition(n), [Condition(*c) for c in conditions])) == want


def test_filter_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, None, math.nan), (2, "x", None), (3, "y", 1.0)], "id long, s string, v double")
    got = lambda *c: ids(filter_rows(df, [Condition(*c)]))
    assert got("s", "neq", "x") == [3] and got("s", "is_null", "") == [1]
    assert got("v", "gt", "0") == [3] and got("v", "gte", "nan") == [] and got("v", "neq", "5") == [1, 3] and got("v", "lt", "9") == [3]


def test_filter_errors(batch):
    for c, error in ((("nope", "eq", "1"), "no such column: nope"), (("id", "like", "1"), "unsupported op 'like'"), (("even", "gt", "1"), "unsupported op 'gt'"), (("id", "eq", "5.7"), "invalid literal")):
        with pytest.raises(ValueError, match=error):
            filter_rows(batch, [Condition(*c)])


def test_filter_reaches_the_scan(spark, batch, tmp_path):
    batch.write.parquet(str(tmp_path / "b"))
    plan = filter_rows(spark.read.parquet(str(tmp_path / "b")), [Condition("id", "gt", "3")]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "ReadSchema: struct<id:bigint>" in plan and "Python" not in plan


def agg(df, keys, *specs, **more):
    return rows(aggregate(df, keys, [Aggregate(*s) for s in specs], **more))


def test_aggregate(tickets):
    v = "cycle_time_days"
    for n in (1, 4, 16):
        df = tickets.repartition(n)
        assert agg(df, ["assignee"], ("avg", v, "avg"), ("sum", v, "sum"), ("min", v, "min"), ("max", v, "max"), ("n", "ignored", "count")) == [("Alice", 5.0, 15.0, 3.0, 7.0, 3), ("Bob", 3.0, 6.0, 1.0, 5.0, 2)]
        assert agg(df, ["assignee", "priority"], ("n", "", "count")) == [("Alice", "P1", 2), ("Alice", "P2", 1), ("Bob", "P1", 1), ("Bob", "P2", 1)]
        assert agg(df, [], ("n", "", "count")) == [(5,)]
    assert agg(tickets.limit(0), [], ("n", "", "count")) == []


def test_aggregate_values(spark):
    df = spark.createDataFrame([("x", 10.0), ("x", 20.0), ("x", 30.0), ("x", 40.0), (None, None), ("y", math.nan), ("y", 2.0)], "g string, v double")
    assert agg(df, ["g"], ("p", "v", "percentile", 50)) == [("x", 25.0), ("y", 2.0), (None, 0.0)]
    assert agg(df.where("g <> 'y' or g is null"), ["g"], ("a", "v", "avg"), ("n", "v", "count")) == [("x", 25.0, 4), (None, 0.0, 1)]
    assert agg(df.where("g = 'y'"), ["g"], ("lo", "v", "min"), ("hi", "v", "max")) == [("y", 2.0, 2.0)]
    keys = spark.createDataFrame([(1, 0.1, True), (1, 0.1, True)], "i int, d double, b boolean")
    assert agg(keys, ["i", "d", "b"], ("n", "", "count")) == [("1", "0.100000", "true", 2)]
    assert agg(keys, ["i"], ("n", "", "count"), preserve_key_types=True) == [(1, 2)]


@pytest.mark.parametrize(("keys", "spec", "error"), [
    (["nope"], ("n", "", "count"), "no such column: nope"),
    (["assignee"], ("s", "nope", "sum"), "no such column: nope"),
    (["assignee"], ("s", "priority", "sum"), "requires a numeric field"),
    (["assignee"], ("s", "cycle_time_days", "median"), "unsupported aggregate func: median"),
    (["assignee"], ("s", "cycle_time_days", "percentile", 101), "between 0 and 100"),
])
def test_aggregate_errors(tickets, keys, spec, error):
    with pytest.raises(ValueError, match=error):
        aggregate(tickets, keys, [Aggregate(*spec)])


def test_unnest(spark):
    df = spark.createDataFrame([(1, ["a", None], ("p", 2)), (2, [], ("q", 3)), (3, None, None)], "id long, xs array<string>, s struct<n:string,m:int>")
    assert rows(unnest(df.drop("s"), "xs", "x")) == [(1, "a"), (1, None)]
    assert rows(unnest(df.drop("s"), "xs", "x", drop_null=False)) == [(1, "a"), (1, None), (2, None), (3, None)]
    assert unnest(df, "xs").columns == ["id", "s", "xs"] and unnest(df, "xs", "id").columns == ["s", "id"]
    assert rows(unnest(df.drop("xs"), "s", "f").select("id", "f.name", "f.value")) == [(1, "m", "2"), (1, "n", "p"), (2, "m", "3"), (2, "n", "q")]
    with pytest.raises(ValueError, match="needs a list"):
        unnest(df, "id")
    with pytest.raises(ValueError, match="no such column"):
        unnest(df, "nope")
    body = spark.createDataFrame([('{"result":{"items":[{"a":1},{"a":2}]}}',), (None,), ("no json",)], "body string")
    assert rows(unnest(project(body, "result.items"), "items")) == [('{"a":1}',), ('{"a":2}',)]


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(1, "a1"), (2, "a2"), (2, "a2b"), (None, "a?")], "key long, v string")
    b = spark.createDataFrame([(2, "b2"), (3, "b3"), (None, "b?")], "key long, v string")
    c = spark.createDataFrame([(2, "c2"), (1, "c1")], "key long, v string")
    return {"a": a, "b": b, "c": c}


def test_join(sides):
    two = {k: sides[k] for k in "ab"}
    assert rows(joins.join(two, JoinConfig("key")).rows) == [(2, "a2", "b2"), (2, "a2b", "b2")]
    assert rows(joins.join(sides, JoinConfig("key")).rows) == [(2, "a2", "b2", "c2"), (2, "a2b", "b2", "c2")]
    assert joins.join(sides, JoinConfig("key")).rows.columns == ["key", "v", "v_b", "v_c"]
    assert rows(joins.join(two, JoinConfig("key", "left", on_timeout="drop")).rows) == [(1, "a1", None), (2, "a2", "b2"), (2, "a2b", "b2"), (None, "a?", None)]
    assert joins.join(two, JoinConfig("key", on_timeout="drop")).dead_letter is None
    full = rows(joins.join(two, JoinConfig("key", on_timeout="emit_null")).rows)
    assert (3, None, "b3") in full and (1, "a1", None) in full and len(full) == 6
    letters = joins.join(two, JoinConfig("key")).dead_letter
    assert {(r.key, r.source) for r in letters.collect()} == {("1", "a"), ("3", "b"), (None, "a"), (None, "b")}
    left = joins.join(two, JoinConfig("key", "left")).dead_letter
    assert {(r.key, r.source) for r in left.where("key is not null").collect()} == {("1", "a")}
    assert {r.source: r.sources for r in letters.where("key is null").collect()} == {"a": ["a"], "b": ["b"]}
    assert rows(joins.presence(two, "key")) == [(1, 1, ["a"]), (2, 2, ["a", "b"]), (3, 1, ["b"])]
    with pytest.raises(ValueError, match="no such column"):
        joins.join(two, JoinConfig("nope"))


@pytest.mark.parametrize("config", [JoinConfig("key"), JoinConfig("key", "left"), JoinConfig("key", on_timeout="emit_null")])
@pytest.mark.parametrize("keys", [["key", "v_b"], ["v_c", "v"], []])
def test_join_grouped(spark, sides, config, keys):
    """As the joined rows grouped: repeated keys and rows, nulls as keys and as values, inputs that lack a key, no rows at all."""
    more = lambda *data: spark.createDataFrame(list(data), "key long, v string")
    inputs = {"a": sides["a"].union(more((2, "a2"), (2, None), (5, "a5"))), "b": sides["b"].union(more((2, "b2"), (2, "b1"), (1, None), (6, "b6"))), "c": sides["c"].union(more((2, "c2"), (6, "c6"), (None, "c?")))}
    measures = {"n": ("count", ""), "last": ("max", "v_b"), "first": ("min", "v_b"), "least": ("min", "key"), "most": ("max", "v_c")}
    for given in (inputs, inputs | {"b": inputs["b"].limit(0)}, {n: df.limit(0) for n, df in inputs.items()}):
        joined = joins.join(given, config).rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("v_b").alias("last"), F.min("v_b").alias("first"), F.min("key").alias("least"), F.max("v_c").alias("most"))
        got = joins.grouped(given, config, keys, measures)
        assert got.dtypes == joined.dtypes and rows(got) == rows(joined)


def test_join_grouped_errors(sides):
    for args, error in (((["nope"], {}), "no such column: nope"), ((["key"], {"x": ("max", "nope")}), "no such column: nope"), ((["key"], {"x": ("avg", "v")}), "unsupported func")):
        with pytest.raises(ValueError, match=error):
            joins.grouped(sides, JoinConfig("key"), *args)


def test_three_way_join_of_many_rows(spark, tmp_path):
    """9 thousand million rows of one nation are counted without being made; if they are made, this is cancelled after a minute."""
    spark.range(300_000).selectExpr("id as c_custkey", "7 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(30_000).selectExpr("format_string('Supplier#%09d', id) as s_name", "7 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, "N7"), (8, "N8")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        assert rows(QUERIES["join_three_way"](spark, str(tmp_path))) == [(7, "N7", 9_000_000_000, "Supplier#000029999")]
    finally:
        stop.cancel()


def test_transform(spark, tmp_path):
    @transform.register("t:double")
    def double(r):
        return {"id": r["id"], "id2": r["id"] * 2}

    df = spark.range(1000).repartition(7)
    for n in (1, 8):
        assert sorted(map(tuple, transform.transform(df, "t:double", row_preserving=True, parallel=n).collect())) == [(i, 2 * i) for i in range(1000)]
    transform.register("t:half", kind="batch")(lambda rs: [{"id": r["id"]} for r in rs if r["id"] % 2])
    assert transform.transform(df, "t:half", "id long").count() == 500
    with pytest.raises(Exception, match="keep the number of rows"):
        transform.transform(df, "t:half", "id long", row_preserving=True).count()
    transform.register("t:nulls")(lambda r: {"a": None, "b": r["id"]})
    assert transform.transform(df, "t:nulls").dtypes == [("a", "string"), ("b", "bigint")]
    assert transform.transform(df.limit(0), "t:double", "id long, id2 long").count() == 0
    (tmp_path / "mine.py").write_text("def f(r):\n    return {'x': r['id'] + 1}\n")
    assert transform.transform(spark.range(3), f"{tmp_path}/mine.py:f").agg(F.sum("x")).first()[0] == 6
    for name in ("nope", f"{tmp_path}/mine.py:g", f"{tmp_path}/none.py:f"):
        with pytest.raises(ValueError, match="unknown transform function"):
            transform.transform(df, name)
    with pytest.raises(ValueError):
        transform.register("t:x", kind="other")


def test_generate(spark):
    up = spark.createDataFrame([("a b",), ("c",), ("c",), (None,)], "k string")
    params = [Parameter("k", "column", from_step="up", field="k"), Parameter("n", "range", range_start=10, range_end=0, range_step=-5), Parameter("p", value="x"), Parameter("l", "list", values=("1", "2"))]
    got = generate.combinations(spark, params, {"up": up})
    assert rows(got) == sorted((k, n, "x", item) for k in ("a b", "c") for n in ("10", "5") for item in ("1", "2"))
    api = Connection("c", base_url="http://h/")
    asked = generate.requests(got, RequestTemplate("POST", "/{k}/{n}?{unknown}", "text/plain", "tag"), api, "run", "step", url_encode=True)
    one = asked.where("url like '%a+b/10%'").first()
    assert one.url == "http://h/a+b/10?{unknown}" and (one.method, one.accept, one.tag) == ("POST", "text/plain", "tag")
    assert asked.select("request_id").distinct().count() == 4 and rows(asked.select("request_id")) == rows(generate.requests(got, RequestTemplate("POST", "/{k}/{n}?{unknown}"), api, "run", "step", True).select("request_id"))
    long = generate.combinations(spark, [Parameter("a", "range", range_end=10_000), Parameter("b", "range", range_end=9000)], {})
    assert long.agg(F.count("*"), F.countDistinct("b")).first()[1] == 9000 and long.count() == 90_000_000
    assert generate.combinations(spark, [Parameter("a", value="x"), Parameter("b", "range")], {}).count() == 0
    assert generate.combinations(spark, [Parameter("a", "list")], {}).count() == 0
    with pytest.raises(ValueError):
        generate.combinations(spark, [Parameter("b", "range", range_end=5, range_step=0)], {})


def test_combinations_are_counted_first(spark, monkeypatch):
    up = spark.range(20).select(F.col("id").cast("string").alias("k"))
    params = [Parameter("a", "column", from_step="up", field="k"), Parameter("b", "column", from_step="up", field="k")]
    assert generate.combinations(spark, params, {"up": up}).count() == 400
    monkeypatch.setattr(generate, "MOST_COMBINATIONS", 399)
    with pytest.raises(ValueError, match="400 combinations"):
        generate.combinations(spark, params, {"up": up})


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "Open", 0.5), (2, 'q"x, y', None), (3, None, 1e-7)], "id long, status string, v double").coalesce(1)
    out = lambda n: str(tmp_path / n)
    assert lines(spark, sink.write(df, out("c"), "csv")) == ["id,status,v", "1,Open,0.500000", '2,"q""x, y",', "3,,0.000000"]
    assert lines(spark, sink.write(df, out("j"), "jsonl"))[1:] == ['{"id":2,"status":"q\\"x, y","v":null}', '{"id":3,"status":null,"v":1.0E-7}']
    import json

    assert json.loads("".join(lines(spark, sink.write(df.repartition(3), out("a"), "json", single_file=True))))[0].keys() == {"id", "status", "v"}
    assert lines(spark, sink.write(df.limit(0), out("e"), "json", single_file=True)) == ["[]"]
    assert rows(spark.read.parquet(sink.write(df, out("p")))) == rows(df)
    assert any(p.suffix == ".gz" for p in (tmp_path / "z").iterdir()) if sink.write(df, out("z"), "json.gz") else False
    assert rows(spark.read.schema(df.schema).json(out("z"))) == rows(df)
    with pytest.raises(ValueError, match="unsupported sink format: xml"):
        sink.write(df, out("x"), "xml")


def test_paths():
    from datetime import UTC, datetime

    now = datetime(2025, 3, 4, 5, 6, 7, tzinfo=UTC)
    assert sink.materialize("a/{date}/{ts}-{date}.csv", "daily", now) == f"a/2025-03-04/{int(now.timestamp())}-2025-03-04.csv"
    assert sink.materialize("{date}", "hourly", now) == "2025-03-04-05" and sink.materialize("{date}", "weekly", now) == "2025-03-04"


def test_schemas_are_inferred_from_all_rows(spark):
    from millrace.operators import transform

    f = lambda r: {"id": r["id"], "n": None if r["id"] < 190 else r["id"] / 2} | ({"late": 1} if r["id"] >= 150 else {})
    transform.register("late_field")(f)
    df = spark.range(200).coalesce(1)
    got = transform.transform(df, "late_field")
    assert got.dtypes == [("id", "bigint"), ("n", "double"), ("late", "bigint")]
    assert got.where("late = 1").count() == 50 and got.agg(F.count("n")).first()[0] == 10
    assert transform.transform(df.repartition(5), "late_field").where("late = 1").count() == 50
    transform.register("mixed_types")(lambda r: {"x": "text" if r["id"] == 199 else r["id"]})
    with pytest.raises(Exception, match="type"):
        transform.transform(df, "mixed_types").count()
