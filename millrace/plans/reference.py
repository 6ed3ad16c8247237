"""Queries over the pipeline operators on whole tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.session import cut, scratch
from millrace.functions.text import folded
from millrace.operators import generate, sink
from millrace.operators import join as joins
from millrace.operators import transform as transforms
from millrace.operators.aggregate import aggregate
from millrace.operators.filter import filter_rows
from millrace.operators.unnest import project, unnest
from millrace.plans import samples  # noqa: F401
from millrace.plans.engine import Lowering
from millrace.plans.parse import parse
from millrace.plans.spec import Aggregate, Condition, Connection, JoinConfig, Parameter, RequestTemplate
from millrace.sources import ledger
from millrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# Filters: every op on every type.


def _filter(name: str, source: str, conditions: list[Condition], keep: list[str], where: str) -> None:
    _add(name, lambda s, d: filter_rows(table(s, d, source), conditions).select(*keep), f"SELECT {', '.join(keep)} FROM {source} WHERE {where}")


_ORDER, _LINE = ["o_orderkey", "o_orderstatus"], ["l_orderkey", "l_linenumber"]
_filter("filter_eq_string", "orders", [Condition("o_orderstatus", "eq", "F")], _ORDER, "o_orderstatus = 'F'")
_filter("filter_neq_string", "orders", [Condition("o_orderstatus", "ne", "F")], _ORDER, "o_orderstatus <> 'F'")
_filter("filter_cmp_string", "orders", [Condition("o_orderpriority", "gte", "2"), Condition("o_orderpriority", "lt", "4")], ["o_orderkey", "o_orderpriority"], "o_orderpriority >= '2' AND o_orderpriority < '4'")
_filter("filter_cmp_int", "lineitem", [Condition("l_partkey", "gt", "100"), Condition("l_linenumber", "lte", "3"), Condition("l_orderkey", "neq", "7")], _LINE, "l_partkey > 100 AND l_linenumber <= 3 AND l_orderkey <> 7")
_filter("filter_cmp_double", "lineitem", [Condition("l_discount", "gte", "0.05"), Condition("l_tax", "lt", "0.06")], _LINE, "l_discount >= 0.05 AND l_tax < 0.06")
_filter("filter_nan", "jira_parser", [Condition("cycle_time_days", "gt", "2.5")], ["id", "key"], "cycle_time_days > 2.5 AND NOT isnan(cycle_time_days)")
_filter("filter_neq_double", "jira_parser", [Condition("cycle_time_days", "neq", "0")], ["id", "key"], "cycle_time_days <> 0")
_filter("filter_and", "orders", [Condition("o_orderstatus", "eq", "O"), Condition("o_totalprice", "gt", "1000"), Condition("o_orderpriority", "not_null")], _ORDER, "o_orderstatus = 'O' AND o_totalprice > 1000")
_filter("filter_empty", "nation", [], ["n_nationkey", "n_name"], "true")
_filter("filter_is_null", "jira_parser", [Condition("assignee", "is_null")], ["id", "status"], "assignee IS NULL")
_filter("filter_not_null", "jira_parser", [Condition("resolution_date", "not_null"), Condition("status", "eq", "Resolved")], ["id", "status"], "resolution_date IS NOT NULL AND status = 'Resolved'")
_add(
    "filter_bool",
    lambda s, d: filter_rows(table(s, d, "lineitem").withColumn("late", F.col("l_linestatus") == "F"), [Condition("late", "eq", "1"), Condition("late", "neq", "no")]).select(*_LINE),
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'",
)

# Aggregates: every function, keys, nulls and empty tables.


def _agg(name: str, source: str, keys: list[str], aggs: list[Aggregate], sql: str, where: str = "true", preserve: bool = False) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        got = aggregate(table(s, d, source).where(where), keys, aggs, preserve)
        return got.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])

    _add(name, query, sql)


_V = "CASE WHEN isnan(cycle_time_days) THEN NULL ELSE cycle_time_days END"
_agg("agg_count", "jira_parser", ["status"], [Aggregate("n", "no_such_column", "count")], "SELECT status, count(*) AS n FROM jira_parser GROUP BY status")
_agg("agg_sum", "lineitem", ["l_returnflag"], [Aggregate("total", "l_quantity", "sum"), Aggregate("lines", "l_linenumber", "sum")], "SELECT l_returnflag, round(coalesce(sum(l_quantity), 0), 4) AS total, round(sum(l_linenumber)::DOUBLE, 4) AS lines FROM lineitem GROUP BY l_returnflag")
_agg("agg_avg", "events", ["event_type"], [Aggregate("mean", "value", "avg")], "SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
_agg("agg_min_max", "jira_parser", ["assignee"], [Aggregate("least", "cycle_time_days", "min"), Aggregate("most", "cycle_time_days", "max")], f"SELECT assignee, round(coalesce(min({_V}), 0), 4) AS least, round(coalesce(max({_V}), 0), 4) AS most FROM jira_parser GROUP BY assignee")
_agg("agg_percentile", "events", ["event_type"], [Aggregate("p95", "value", "percentile", 95), Aggregate("p50", "value", "percentile", 50), Aggregate("p0", "value", "percentile")], "SELECT event_type, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.5), 4) AS p50, round(min(value), 4) AS p0 FROM events GROUP BY event_type")
_agg("agg_multi_key", "lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"], [Aggregate("n", "", "count"), Aggregate("mean", "l_extendedprice", "avg")], "SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL")
_agg("agg_key_types", "lineitem", ["l_linenumber"], [Aggregate("n", "", "count")], "SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL", preserve=True)
_agg("agg_double_key", "lineitem", ["l_discount"], [Aggregate("n", "", "count")], "SELECT printf('%.6f', l_discount) AS l_discount, count(*) AS n FROM lineitem GROUP BY 1")
_agg("agg_global", "orders", [], [Aggregate("n", "", "count"), Aggregate("total", "o_totalprice", "sum"), Aggregate("most", "o_totalprice", "max")], "SELECT count(*) AS n, round(sum(o_totalprice), 4) AS total, round(max(o_totalprice), 4) AS most FROM orders")
_agg("agg_empty_input", "orders", [], [Aggregate("n", "", "count")], "SELECT count(*) AS n FROM orders WHERE false HAVING count(*) > 0", where="o_orderkey < 0")
_add(
    "agg_all_null_zero",
    lambda s, d: aggregate(table(s, d, "nation").withColumn("v", F.lit(None).cast("double")), ["n_regionkey"], [Aggregate("s", "v", "sum"), Aggregate("a", "v", "avg"), Aggregate("lo", "v", "min"), Aggregate("p", "v", "percentile", 50), Aggregate("n", "v", "count")]),
    "SELECT n_regionkey::VARCHAR AS n_regionkey, 0.0::DOUBLE AS s, 0.0::DOUBLE AS a, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS p, count(*) AS n FROM nation GROUP BY ALL",
)

# Transforms.
_add("transform_record", lambda s, d: transforms.transform(table(s, d, "events").select("event_id", "event_type", "props"), "samples:event_record", row_preserving=True), "SELECT event_id, upper(event_type) AS event_type, json_extract(props, '$.k')::BIGINT AS k FROM events")
_add("transform_batch", lambda s, d: transforms.transform(table(s, d, "events").select("event_id", "value"), "samples:event_batch", row_preserving=True), "SELECT event_id, value * 2 AS doubled FROM events")
_add("transform_rows_change", lambda s, d: transforms.transform(table(s, d, "events").select("event_id", "event_type"), "samples:event_twice"), "SELECT event_id, unnest([0, 1]) AS copy FROM events WHERE event_type = 'purchase'")
_add("transform_frame", lambda s, d: transforms.transform(table(s, d, "orders").select("o_orderkey", "o_custkey"), "samples:order_key"), "SELECT o_orderkey AS order_key, o_custkey FROM orders")

# Unnest and field paths.
_add("unnest_embeddings", lambda s, d: unnest(table(s, d, "embeddings"), "embedding", "x").select("vec_id", "label", F.col("x").cast("double").alias("x")), "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings")


def _listed(s: SparkSession, d: str) -> DataFrame:
    words = F.when(F.col("n_regionkey") == 0, None).when(F.col("n_regionkey") == 1, F.array().cast("array<string>")).otherwise(F.split("n_name", " "))
    return table(s, d, "nation").select("n_nationkey", words.alias("words"))


_WORDS = "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation WHERE n_regionkey NOT IN (0, 1)"
_add("unnest_drop_null", lambda s, d: unnest(_listed(s, d), "words", "word"), _WORDS)
_add("unnest_keep_null", lambda s, d: unnest(_listed(s, d), "words", "word", drop_null=False), _WORDS + " UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_regionkey IN (0, 1)")
_add(
    "unnest_struct",
    lambda s, d: unnest(table(s, d, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("n")), "n", "f").select("n_nationkey", "f.name", "f.value"),
    "SELECT n_nationkey, 'n_name' AS name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation",
)
_add("field_path_json", lambda s, d: project(table(s, d, "events"), "props.k").select(F.element_at("k", 1).alias("k")), "SELECT json_extract_string(props, '$.k') AS k FROM events")
_add("field_path_struct", lambda s, d: project(table(s, d, "orders").select(F.struct(F.struct("o_custkey").alias("items")).alias("result")), "result.items.o_custkey"), "SELECT o_custkey FROM orders")

# Joins: request states and the runs they belong to, issues and their zones.


def _join_inputs(s: SparkSession, d: str) -> dict[str, DataFrame]:
    zones = table(s, d, "project_zones").select(F.col("project_key").alias("project"), "tz_name")
    issues = table(s, d, "jira_parser").select(F.split_part("key", F.lit("-"), F.lit(1)).alias("project"), "id", "status")
    return {"issues": issues, "zones": zones}


_ISSUES = "(SELECT split_part(key, '-', 1) AS project, id, status FROM jira_parser) i"
_ZONES = "(SELECT project_key AS project, tz_name FROM project_zones) z"


def _join(name: str, config: JoinConfig, sql: str) -> None:
    _add(name, lambda s, d: joins.join(_join_inputs(s, d), config).rows, sql)


_J = f"SELECT i.project, id, status, tz_name FROM {_ISSUES} {{}} JOIN {_ZONES} ON i.project = z.project"
_join("join_inner", JoinConfig("project", "inner"), _J.format(""))
_join("join_drop", JoinConfig("project", "inner", on_timeout="drop"), _J.format(""))
_join("join_left", JoinConfig("project", "left"), _J.format("LEFT"))
_join("join_emit_null", JoinConfig("project", "inner", on_timeout="emit_null"), _J.replace("i.project, id", "coalesce(i.project, z.project) AS project, id").format("FULL"))
_add(
    "join_dead_letter",
    lambda s, d: joins.join(_join_inputs(s, d), JoinConfig("project")).dead_letter.select("key", "source", F.array_join("sources", ",").alias("sources"), "payload"),
    f"""SELECT i.project AS key, 'issues' AS source, 'issues' AS sources, to_json({{'project': i.project, 'id': id, 'status': status}})::VARCHAR AS payload FROM {_ISSUES} LEFT JOIN {_ZONES} ON i.project = z.project WHERE z.project IS NULL
      UNION ALL SELECT z.project, 'zones', 'zones', to_json({{'project': z.project, 'tz_name': tz_name}})::VARCHAR FROM {_ZONES} WHERE NOT EXISTS (SELECT 1 FROM {_ISSUES} WHERE i.project = z.project)""",
)
_add(
    "join_three_way",
    lambda s, d: joins.grouped({
        "customer": table(s, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"),
        "nation": table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")),
        "supplier": table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name")),
    }, JoinConfig("k"), ["k", "name"], {"n": ("count", ""), "last": ("max", "name_supplier")}),
    "SELECT c_nationkey AS k, n_name AS name, count(*) AS n, max(s_name) AS last FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL",
)

# Fan-out of requests.
_API = Connection("api", base_url="http://api.example/")


def _fan(name: str, parameters: list[Parameter], path: str, sql: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        frames = {"users": table(s, d, "events"), "regions": table(s, d, "region")}
        return generate.requests(generate.combinations(s, parameters, frames), RequestTemplate(path_template=path), _API, "run-1", name).select("method", "url")

    _add(name, query, sql)


_fan("generate_literal", [Parameter("p", value="ENG")], "/x/{p}", "SELECT 'GET' AS method, 'http://api.example/x/ENG' AS url")
_fan("generate_list", [Parameter("p", "list", values=("a", "b", "c"))], "/x/{p}", "SELECT 'GET' AS method, 'http://api.example/x/' || unnest(['a', 'b', 'c']) AS url")
_fan("generate_range", [Parameter("n", "range", range_start=0, range_end=1000, range_step=100)], "/x?at={n}", "SELECT 'GET' AS method, 'http://api.example/x?at=' || n AS url FROM range(0, 1000, 100) t(n)")
_fan("generate_column", [Parameter("u", "column", from_step="users", field="user_id")], "/u/{u}", "SELECT 'GET' AS method, 'http://api.example/u/' || user_id AS url FROM (SELECT DISTINCT user_id FROM events)")
_fan(
    "generate_combination",
    [Parameter("r", "column", from_step="regions", field="r_name"), Parameter("n", "range", range_end=5000), Parameter("k", "list", values=("open", "done"))],
    "/{r}/{k}?at={n}&r={r}",
    "SELECT 'GET' AS method, 'http://api.example/' || r_name || '/' || k || '?at=' || n || '&r=' || r_name AS url FROM (SELECT DISTINCT r_name FROM region), range(0, 5000) t(n), (SELECT unnest(['open', 'done']) AS k)",
)

# The ledger.
_CURRENT = "SELECT dag_run_id, request_id, status FROM request_queue QUALIFY row_number() OVER (PARTITION BY dag_run_id, request_id ORDER BY seq DESC) = 1"


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "request_queue").select("seq", "dag_run_id", "request_id", folded(F.col("status")).alias("status"), "started_at")


_add("ledger_counts", lambda s, d: ledger.counts(_events(s, d)), f"SELECT dag_run_id, lower(trim(status)) AS status, count(*) AS n FROM ({_CURRENT}) GROUP BY ALL")
_add("ledger_resume", lambda s, d: ledger.resumable(_events(s, d)).select("dag_run_id", "request_id", "status"), f"SELECT dag_run_id, request_id, 'pending' AS status FROM ({_CURRENT}) WHERE lower(trim(status)) NOT IN ('done', 'failed', 'skipped')")

# Sinks: written and read again.


def _roundtrip(fmt: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        df = table(s, d, "jira_parser").select("id", "status", "assignee", "created_date")
        path = sink.write(df, f"{scratch(s, 'sinks')}/out", fmt)
        kinds = "id string, status string, assignee string, created_date string"
        if fmt == "parquet":
            return s.read.schema(kinds).parquet(path)
        if fmt == "csv":
            return s.read.schema(kinds).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\0").option("emptyValue", "").csv(path)
        return s.read.schema(kinds).json(path)

    return query


_ALL = "SELECT id, {} AS status, {} AS assignee, {} AS created_date FROM jira_parser"
for _fmt in ("parquet", "csv", "json", "json.gz", "jsonl"):
    _add(f"sink_{_fmt.replace('.', '')}_roundtrip", _roundtrip(_fmt), _ALL.format("status", "assignee", "created_date"))


def sink_csv_text(s: SparkSession, d: str) -> DataFrame:
    """The lines of a CSV sink, without the header."""
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = sink.write(df, f"{scratch(s, 'sinks')}/out", "csv")
    return s.read.text(path).where("value <> 'l_orderkey,l_linenumber,l_quantity,l_returnflag'").select(F.col("value").alias("line"))


_add("sink_csv_text", sink_csv_text, "SELECT l_orderkey || ',' || l_linenumber || ',' || printf('%.6f', l_quantity) || ',' || l_returnflag AS line FROM lineitem")

# Streaming: the same operators over micro-batches.


def _stream(s: SparkSession, d: str, files: int) -> DataFrame:
    """events as a stream of several files, one micro-batch each."""
    folder = f"{scratch(s, 'streams')}/x"
    df = table(s, d, "events")
    df.repartition(files, "event_id").write.parquet(folder)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _stream_agg(s: SparkSession, d: str, files: int) -> DataFrame:
    from millrace.streaming import pipeline

    aggs = [Aggregate("n", "", "count"), Aggregate("total", "value", "sum"), Aggregate("p95", "value", "percentile", 95)]
    name = f"s_{uuid.uuid4().hex}"
    out = pipeline.run_available(pipeline.stream_aggregate(_stream(s, d, files), ["event_type"], aggs), scratch(s, "checkpoints"), name, "complete")
    return cut(out.select("event_type", "n", F.round("total", 4).alias("total"), F.round("p95", 4).alias("p95")))


_STREAM_SQL = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type"
_add("stream_agg_equals_batch", lambda s, d: _stream_agg(s, d, 1), _STREAM_SQL)
_add("stream_split_equals_whole", lambda s, d: _stream_agg(s, d, 4), _STREAM_SQL)


def stream_filter_transform(s: SparkSession, d: str) -> DataFrame:
    """Filter and transform on a stream, into files."""
    from millrace.streaming import pipeline

    kept = filter_rows(_stream(s, d, 3), [Condition("event_type", "neq", "view")]).select("event_id", "event_type", "props")
    at = f"{scratch(s, 'streams')}/x"
    pipeline.into_files(transforms.transform(kept, "samples:event_record"), f"{at}/out", f"{at}/checkpoint")
    return s.read.schema("event_id long, event_type string, k long").parquet(f"{at}/out")


_add("stream_filter_transform", stream_filter_transform, "SELECT event_id, upper(event_type) AS event_type, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type <> 'view'")

# Pipelines: whole documents, lowered.
CYCLE_TIME = {
    "name": "order-cycle-time", "version": "1.0", "start_at": "lines",
    "connections": {"store": {"type": "file", "root": "tables"}},
    "steps": [
        {"id": "lines", "type": "filter", "input": {"from_connection": "store", "path": "lineitem.parquet"}, "condition": [{"field": "l_linestatus", "op": "eq", "value": "F"}]},
        {"id": "lines_keyed", "type": "transform", "input": {"from_step": "lines"}, "function": {"entrypoint": "samples:line_key"}},
        {"id": "orders", "type": "transform", "input": {"from_connection": "store", "path": "orders.parquet"}, "function": {"entrypoint": "samples:order_key"}},
        {"id": "joined", "type": "join", "input": {"inputs": ["lines_keyed", "orders"]}, "join_config": {"key": "order_key", "join": "inner", "on_timeout": "drop"}},
        {"id": "cycle", "type": "transform", "input": {"from_step": "joined"}, "function": {"entrypoint": "samples:order_cycle"}},
        {"id": "result", "type": "aggregate", "input": {"from_step": "cycle"}, "group_by": ["o_orderpriority"], "aggregates": [
            {"name": "mean_days", "field": "cycle_days", "func": "avg"}, {"name": "n", "field": "order_key", "func": "count"}, {"name": "p95_days", "field": "cycle_days", "func": "percentile", "arg": 95}]},
    ],
}


def _lowered(s: SparkSession, d: str, document: dict, names: list[str], step: str, **given: DataFrame) -> DataFrame:
    tables = {f"store/{n}.parquet": table(s, d, n) for n in names}
    return Lowering(s, parse(document), {**tables, **given}).lower()[step]


def pipeline_cycle_time(s: SparkSession, d: str) -> DataFrame:
    """The flagship: two sources, transforms, a join, a filter and an aggregate from one document."""
    got = _lowered(s, d, CYCLE_TIME, ["lineitem", "orders"], "result")
    return got.select("o_orderpriority", F.round("mean_days", 6).alias("mean_days"), "n", F.round("p95_days", 6).alias("p95_days"))


_add(
    "pipeline_cycle_time",
    pipeline_cycle_time,
    """SELECT o_orderpriority, round(avg(x), 6) AS mean_days, count(*) AS n, round(quantile_cont(x, 0.95), 6) AS p95_days
    FROM (SELECT o_orderpriority, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0 AS x
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F') GROUP BY o_orderpriority""",
)
ISSUES = {
    "name": "issue-cycle-time", "start_at": "resolved",
    "connections": {"store": {"type": "file", "root": "tables"}},
    "steps": [
        {"id": "resolved", "type": "filter", "input": {"from_connection": "store", "path": "jira_parser.parquet"}, "condition": [{"field": "status", "op": "eq", "value": "Resolved"}, {"field": "resolution_date", "op": "not_null"}]},
        {"id": "result", "type": "aggregate", "input": {"from_step": "resolved"}, "group_by": ["assignee"], "aggregates": [
            {"name": "mean_days", "field": "cycle_time_days", "func": "avg"}, {"name": "issues", "field": "id", "func": "count"}, {"name": "p95_days", "field": "cycle_time_days", "func": "percentile", "arg": 95}]},
        {"id": "later", "type": "stub", "reason": "pending"},
    ],
}


def pipeline_issues(s: SparkSession, d: str) -> DataFrame:
    got = _lowered(s, d, ISSUES, ["jira_parser"], "result")
    return got.select("assignee", F.round("mean_days", 4).alias("mean_days"), "issues", F.round("p95_days", 4).alias("p95_days"))


_add(
    "pipeline_issues",
    pipeline_issues,
    """SELECT assignee, round(coalesce(avg(cycle_time_days), 0), 4) AS mean_days, count(*) AS issues, round(coalesce(quantile_cont(cycle_time_days, 0.95) FILTER (NOT isnan(cycle_time_days)), 0), 4) AS p95_days
    FROM jira_parser WHERE status = 'Resolved' AND resolution_date IS NOT NULL GROUP BY assignee""",
)
