"""The queries p1 to p5 over whole tables, and SQL that gives the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.session import cut, scratch
from millrace.functions.text import folded, trimmed
from millrace.operators import incremental, nested, percentiles, skew, timestamps
from millrace.sources.tables import table

REQUEST = ["dag_run_id", "request_id"]
STATE = ["status", "completed_at"]
FINAL = ("done", "failed", "skipped")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Requests for the next consumer run: those whose final current row lies in a gap of the committed intervals.

    The log of earlier runs is adopted as a first commit: the numbers of the current rows that succeeded runs have seen as they are now.
    """
    ledger = table(spark, d, "request_queue").select(*REQUEST, folded(F.col("status")).alias("status"), "completed_at", "seq")
    log, runs = table(spark, d, "processed_log"), table(spark, d, "consumer_runs")
    succeeded = runs.where(folded(F.col("outcome")) == "succeeded").select("consumer_run").distinct()
    logged = log.join(F.broadcast(succeeded), "consumer_run").select(*REQUEST, "consumer_run", "logged_at", folded(F.col("status")).alias("status"), "completed_at")  # a fixed table of runs
    current = cut(incremental.current_rows(ledger, logged, REQUEST, STATE, "seq", ["consumer_run", "logged_at"]))
    store = incremental.IntervalStore(spark, scratch(spark, "intervals"))
    store.adopt(incremental.intervals_of(current.where("seen"), "seq"))
    return store.begin(current.where(F.col("status").isin(*FINAL)), "seq").rows.select(*REQUEST)


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs over a ledger that grows file by file: rows and numbers in the output of each, and the files it opened.

    First come the rows of its first half but for some that are late; then the late ones and the rest. Between both a run breaks off
    after its output, and a rival commits too late. A last run finds nothing new.
    """
    ledger = table(spark, d, "request_queue").select(*REQUEST, "seq", "status")
    at = scratch(spark, "runs")
    half = (ledger.agg(F.max("seq")).first()[0] or 0) // 2
    early = F.coalesce((F.col("seq") <= half) & (F.col("seq") % 13 != 5), F.lit(False))
    store, counts = incremental.IntervalStore(spark, f"{at}/state"), []

    def took(n: int, run: incremental.Run, out: str, before: int, refused: bool = False) -> None:
        rows = spark.read.schema(ledger.schema).parquet(out).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("seq"), F.lit(0)).alias("numbers"))
        counts.append(rows.select(F.lit(n).alias("run"), "rows", "numbers", F.lit(before > 0).alias("old_files_opened"), F.lit(refused).alias("rival_refused"), F.lit(run.unnumbered).cast("long").alias("unnumbered")))

    def opened(run: incremental.Run, old: set) -> int:
        return len({f.rpartition("/")[2] for f in run.rows.inputFiles()} & old)

    def files() -> set:
        return {f.rpartition("/")[2] for f in spark.read.schema(ledger.schema).parquet(f"{at}/ledger").inputFiles()}

    ledger.where(early).write.parquet(f"{at}/ledger")
    run, old = store.begin_folder(f"{at}/ledger", "seq", ledger.schema), files()
    took(1, run, store.commit(run, run.rows), 0)
    ledger.where(~early).write.mode("append").parquet(f"{at}/ledger")
    broken = store.begin_folder(f"{at}/ledger", "seq", ledger.schema)
    broken.rows.write.parquet(f"{at}/state/run-{broken.number}-broken/output")
    run, rival = (store.begin_folder(f"{at}/ledger", "seq", ledger.schema) for _ in range(2))
    out, refused = store.commit(run, run.rows), False
    try:
        store.commit(rival, rival.rows)
    except FileExistsError:
        refused = True
    took(2, run, out, opened(run, old), refused)
    run, old = store.begin_folder(f"{at}/ledger", "seq", ledger.schema), files()
    took(3, run, store.commit(run, run.rows), opened(run, old))
    return functools.reduce(DataFrame.unionByName, counts)


P1_RUNS_SQL = """
WITH q AS (SELECT seq, coalesce(seq <= (SELECT max(seq) // 2 FROM request_queue) AND seq % 13 <> 5, false) AS early FROM request_queue)
SELECT 1 AS run, count(seq) AS rows, coalesce(sum(seq), 0)::BIGINT AS numbers, false AS old_files_opened, false AS rival_refused, 0::BIGINT AS unnumbered FROM q WHERE early
UNION ALL SELECT 2, count(seq), coalesce(sum(seq), 0)::BIGINT, false, true, (count(*) - count(seq))::BIGINT FROM q WHERE NOT early
UNION ALL SELECT 3, 0, 0, false, false, 0
"""
P1_SQL = """
WITH cur AS (
  SELECT dag_run_id, request_id, lower(trim(status)) AS status, completed_at FROM request_queue
  QUALIFY row_number() OVER (PARTITION BY dag_run_id, request_id ORDER BY seq DESC) = 1),
last AS (
  SELECT l.dag_run_id, l.request_id, lower(trim(l.status)) AS status, l.completed_at, 1 AS here
  FROM processed_log l JOIN consumer_runs r ON l.consumer_run = r.consumer_run AND r.outcome = 'succeeded'
  QUALIFY row_number() OVER (PARTITION BY l.dag_run_id, l.request_id ORDER BY l.consumer_run DESC, l.logged_at DESC) = 1)
SELECT DISTINCT cur.dag_run_id, cur.request_id
FROM cur LEFT JOIN last ON cur.dag_run_id = last.dag_run_id AND cur.request_id = last.request_id
WHERE cur.status IN ('done', 'failed', 'skipped')
  AND (last.here IS NULL OR cur.status IS DISTINCT FROM last.status OR cur.completed_at IS DISTINCT FROM last.completed_at)
"""

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
GROUPINGS = [["assignee"], ["status"], ["assignee", "status"]]


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of cycle_time_days per assignee, per status and per both."""
    got = percentiles.percentiles([table(spark, d, "jira_parser")], GROUPINGS, "cycle_time_days", PROBS)
    return got.select("grouping", "assignee", "status", "n_values", "p", F.round("value", 6).alias("value"), "error_bound")


def _slices(spark: SparkSession, d: str, groupings: list[list[str]]) -> DataFrame:
    rows = table(spark, d, "jira_parser")
    first = F.coalesce(F.upper(trimmed(F.col("key"))) < "M", F.lit(False))
    slices = [rows.where(first), rows.where(~first)]
    states = [cut(percentiles.state(s, groupings, "cycle_time_days")) for s in slices]
    keys = list(dict.fromkeys(c for g in groupings for c in g))
    got = percentiles.bounds(percentiles.merge(*states), groupings, PROBS).alias("b")
    exact = percentiles.percentiles(slices, groupings, "cycle_time_days", PROBS, states=states).alias("e")
    inside = (F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ["grouping", *keys, "p"]]
    return got.join(exact, same).select("b.grouping", *[f"b.{c}" for c in keys], "b.n_values", "b.p", F.round("value", 6).alias("value"), inside.alias("within_bound"))


def p2_slices(spark: SparkSession, d: str) -> DataFrame:
    """The same per status from stored states of separate slices of the rows (by the project in the key), merged."""
    return _slices(spark, d, [["status"]]).drop("grouping")


def p2_slices_all(spark: SparkSession, d: str) -> DataFrame:
    """The same per assignee, per status and per both."""
    return _slices(spark, d, GROUPINGS)


P2_SQL = f"""
WITH v AS (SELECT assignee, status, cycle_time_days AS v FROM jira_parser WHERE isfinite(cycle_time_days)),
q AS (
  SELECT CASE WHEN grouping(status) = 1 THEN 'assignee' WHEN grouping(assignee) = 1 THEN 'status' ELSE 'assignee+status' END AS "grouping",
    assignee, status, count(*) AS n_values, quantile_cont(v, {PROBS}) AS qs
  FROM v GROUP BY GROUPING SETS ((assignee), (status), (assignee, status)))
SELECT "grouping", assignee, status, n_values, unnest({PROBS}) AS p, round(unnest(qs), 6) AS value, 0.0::DOUBLE AS error_bound FROM q
"""
P2_SLICES_SQL = f"""
SELECT status, n_values, unnest({PROBS}) AS p, round(unnest(qs), 6) AS value, true AS within_bound FROM (
  SELECT status, count(*) AS n_values, quantile_cont(cycle_time_days, {PROBS}) AS qs FROM jira_parser WHERE isfinite(cycle_time_days) GROUP BY status)
"""

P2_SLICES_ALL_SQL = f'SELECT "grouping", assignee, status, n_values, p, value, true AS within_bound FROM ({P2_SQL})'

# The two forms that TESTDATA.md leaves out.
_PLAIN = {"jira_parser": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\+0000\z", "request_queue": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"}


def _instants(spark: SparkSession, d: str, plain_too: bool) -> DataFrame:
    """(table_name, record_id, field_name, value, utc_us) of the non-null values of the three fields."""
    jira, zones = table(spark, d, "jira_parser"), table(spark, d, "project_zones")
    zones = zones.groupBy(F.upper(trimmed(F.col("project_key"))).alias("project")).agg(F.max(trimmed(F.col("tz_name"))).alias("zone"))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("created_date", "resolution_date")])).alias("x")
    project = F.when(F.col("key").contains("-"), F.upper(trimmed(F.substring_index("key", "-", 1)))).alias("project")
    issues = jira.select(F.col("id").alias("record_id"), project, fields).select(F.lit("jira_parser").alias("table_name"), "record_id", "project", "x.*")
    queue, runs = table(spark, d, "request_queue"), table(spark, d, "dag_runs")
    run_zones = runs.groupBy("dag_run_id").agg(F.max(trimmed(F.col("tz_name"))).alias("zone"))
    requests = queue.select(F.lit("request_queue").alias("table_name"), F.col("request_id").alias("record_id"), "dag_run_id", F.lit("created_at").alias("field_name"), F.col("created_at").alias("value"))

    def wanted(df: DataFrame, name: str) -> DataFrame:
        df = df.where(F.col("value").isNotNull())
        return df if plain_too else df.where(~F.col("value").rlike(_PLAIN[name]))

    out = ["table_name", "record_id", "field_name", "value", "zone"]
    a = wanted(issues, "jira_parser").join(zones, "project", "left").select(*out)
    b = wanted(requests, "request_queue").join(run_zones, "dag_run_id", "left").select(*out)
    return a.unionByName(b).withColumn("utc_us", timestamps.utc_micros(F.col("value"), F.col("zone"))).drop("zone")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that denote exactly one instant, but for the two plainest forms."""
    return _instants(spark, d, False).where("utc_us is not null").select("table_name", "record_id", "field_name", "utc_us").distinct()


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Per field, how many values denote an instant, and the first and last instant: over all forms."""
    got = _instants(spark, d, True).groupBy("table_name", "field_name")
    return got.agg(F.count(F.lit(1)).alias("n_values"), F.count("utc_us").alias("n_instants"), F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us"), F.lit(timestamps.zone_edition()).alias("zone_edition"))


# Forms that SQL reads too, by shape.
_SQL_FORMS = {
    "offset": r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:?\d\d)\z",
    "wall": r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?\z",
    "dotted": r"^\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d\z",
    "mail": r"^[A-Z][a-z]{2}, \d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}\z",
    "epoch": r"^1[67]\d{8}(\d{3})?(\d{3})?\z",
}


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The instants of all values in the forms that SQL can read, wall-clock times included; null where there is no single one."""
    got = _instants(spark, d, True)
    form = F.coalesce(*[F.when(F.col("value").rlike(p), F.lit(name)) for name, p in _SQL_FORMS.items()])
    return got.withColumn("form", form).where("form is not null").select("table_name", "record_id", "field_name", "form", "utc_us")


_FORM_SQL = " ".join(f"WHEN regexp_matches(value, '{p}') THEN '{name}'" for name, p in _SQL_FORMS.items())
P3_FORMS_SQL = f"""
WITH pz AS (SELECT upper(trim(project_key)) AS project, max(trim(tz_name)) AS zone FROM project_zones GROUP BY 1),
rz AS (SELECT dag_run_id, max(trim(tz_name)) AS zone FROM dag_runs GROUP BY 1),
j AS (SELECT id, CASE WHEN contains(key, '-') THEN upper(trim(split_part(key, '-', 1))) END AS project, created_date, resolution_date FROM jira_parser),
v AS (
  SELECT 'jira_parser' AS table_name, id AS record_id, 'created_date' AS field_name, created_date AS value, zone FROM j LEFT JOIN pz USING (project)
  UNION ALL SELECT 'jira_parser', id, 'resolution_date', resolution_date, zone FROM j LEFT JOIN pz USING (project)
  UNION ALL SELECT 'request_queue', request_id, 'created_at', created_at, zone FROM request_queue LEFT JOIN rz USING (dag_run_id)),
f AS (SELECT *, CASE {_FORM_SQL} END AS form FROM v),
w AS (
  SELECT * EXCLUDE (zone), (SELECT name FROM pg_timezone_names() WHERE name = zone LIMIT 1) AS zone,
    CASE form WHEN 'wall' THEN try_cast(value AS TIMESTAMP) WHEN 'dotted' THEN try_strptime(value, '%d.%m.%Y %H:%M:%S') END AS wall,
    CASE form WHEN 'offset' THEN epoch_us(try_cast(regexp_replace(value, '([+-][0-9]{{2}})([0-9]{{2}})$', '\\1:\\2') AS TIMESTAMPTZ))
      WHEN 'mail' THEN CASE WHEN strftime(try_strptime(substr(value, 6, 11), '%d %b %Y'), '%a') = left(value, 3) THEN epoch_us(try_strptime(substr(value, 6), '%d %b %Y %H:%M:%S %z')) END
      WHEN 'epoch' THEN value::BIGINT * CASE length(value) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END END AS us
  FROM f WHERE form IS NOT NULL),
z AS (SELECT *, timezone(zone, wall) AS instant FROM w)
SELECT table_name, record_id, field_name, form, coalesce(us, CASE WHEN timezone(zone, instant) = wall
    AND NOT list_contains([timezone(zone, instant + INTERVAL 1 HOUR), timezone(zone, instant - INTERVAL 1 HOUR), timezone(zone, instant + INTERVAL 30 MINUTE), timezone(zone, instant - INTERVAL 30 MINUTE)], wall) THEN epoch_us(instant) END) AS utc_us FROM z
"""


SHARE = 0.03


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of assignee and status on at least 3 % of all rows."""
    counts = skew.key_shares(table(spark, d, "jira_parser"), ["assignee", "status"])
    return counts.where(F.col("rows") >= F.lit(SHARE) * F.col("all_rows")).select("field_name", "field_value")


P4_FOUND_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field_name, {f} AS field_value FROM jira_parser WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) >= 0.03 * (SELECT count(*) FROM jira_parser)" for f in ("assignee", "status"))


def p4_key_results(spark: SparkSession, d: str) -> DataFrame:
    """Per assignee: rows, rows with a finite cycle time, and their sum, least and greatest; null is a key too."""
    rows = table(spark, d, "jira_parser").select("assignee", "cycle_time_days")
    v = F.col("cycle_time_days")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    partial = {"rows": F.count(F.lit(1)), "finite": F.count(v), "total": F.sum(v.cast("decimal(28,6)")), "least": F.min(v), "most": F.max(v)}
    final = {"rows": F.sum("rows"), "finite": F.sum("finite"), "total": F.round(F.sum("total").cast("double"), 3), "least": F.min("least"), "most": F.max("most")}
    return skew.balanced_aggregate(rows, "assignee", partial, final, skew.plan_for(rows, "assignee"))


def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Per assignee and status how many issues (keys) they had: a result that the rows of a key can't be combined for before they meet."""
    rows = table(spark, d, "jira_parser").select("assignee", "status", "key")
    by = ["assignee", "status"]
    return skew.balanced_aggregate(rows, by, {"n": F.count_distinct("key")}, {"issues": F.sum("n")}, skew.plan_for(rows, by), spread=F.xxhash64("key"))


P4_DISTINCT_SQL = "SELECT assignee, status, count(DISTINCT key) AS issues FROM jira_parser GROUP BY assignee, status"


P4_KEYS_SQL = """
SELECT assignee, count(*) AS rows, count(v) AS finite, round(sum(v::DECIMAL(28,6))::DOUBLE, 3) AS total, min(v) AS least, max(v) AS most
FROM (SELECT assignee, CASE WHEN isfinite(cycle_time_days) THEN cycle_time_days END AS v FROM jira_parser) GROUP BY assignee
"""


def p4_skew_join(spark: SparkSession, d: str) -> DataFrame:
    """Every row beside its assignee's load, by fragment and replicate: rows of each (status, assignee) that exceed the assignee's
    mean finite cycle time."""
    rows = table(spark, d, "jira_parser").select("assignee", "status", "cycle_time_days").where("not isnan(cycle_time_days) and abs(cycle_time_days) < double('infinity')")
    plan = skew.plan_for(rows, "assignee")
    means = skew.balanced_aggregate(rows.select("assignee", "cycle_time_days"), "assignee", {"s": F.sum(F.col("cycle_time_days").cast("decimal(28,6)")), "n": F.count(F.lit(1))}, {"mean": F.sum("s").cast("double") / F.sum("n")}, plan)
    joined = skew.fragment_replicate_join(rows, means, "assignee", plan)
    return joined.groupBy("assignee", "status").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("cycle_time_days") > F.col("mean"), 1)).alias("above_mean"))


P4_JOIN_SQL = """
WITH r AS (SELECT assignee, status, cycle_time_days AS v FROM jira_parser WHERE isfinite(cycle_time_days)),
m AS (SELECT assignee, sum(v::DECIMAL(28,6))::DOUBLE / count(*) AS mean FROM r GROUP BY assignee)
SELECT r.assignee, r.status, count(*) AS rows, count(CASE WHEN v > mean THEN 1 END) AS above_mean FROM r JOIN m ON r.assignee = m.assignee GROUP BY r.assignee, r.status
"""

def p4_join_types(spark: SparkSession, d: str) -> DataFrame:
    """Lines per name of a part, joined by keys of two types (whole numbers on the left, doubles on the right)."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity")
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("double").alias("k"), "p_brand")
    joined = skew.fragment_replicate_join(lines, parts, "k")
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


P4_TYPES_SQL = "SELECT p_brand, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"

_PARENTS = ("issue", "subtask", "history")
#: The tables in a response body.
BODY_TABLES = (
    nested.Table("issue", having=("key", "fields"), but_not=("subtasks",), parents=None, columns=("key", "fields.summary", "fields.status.name", "fields.assignee.displayName", "fields.created", "fields.resolutiondate")),
    nested.Table("subtask", held_by="subtasks", parents=_PARENTS, columns=("key", "fields.summary", "fields.status.name")),
    nested.Table("comment", held_by="comments", parents=_PARENTS, columns=("body", "created", "author.displayName")),
    nested.Table("history", held_by="histories", parents=_PARENTS, columns=("created", "author.displayName")),
    nested.Table("item", held_by="items", key=None, parents=_PARENTS, columns=("field", "fromString", "toString")),
)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per object in the response bodies, with the key of its parent."""
    bodies = table(spark, d, "request_queue").select(*REQUEST, "response_body").where("response_body is not null")
    rows = nested.flat_tables(bodies, "response_body", "request_id", REQUEST, BODY_TABLES, columns=False)
    return rows.select(*REQUEST, F.col("table").alias("child_kind"), F.col("parent_key").alias("parent_id"), F.col("row_key").alias("child_id")).distinct()


_TREE_SQL = """
WITH RECURSIVE whole AS (
  SELECT row_number() OVER () AS r, dag_run_id, request_id, response_body AS s FROM request_queue WHERE json_valid(response_body)),
inner_ AS (SELECT r, dag_run_id, request_id, CASE WHEN json_type(s) = 'VARCHAR' AND json_valid(json_extract_string(s, '$')) THEN json_extract_string(s, '$') ELSE s END AS s FROM whole),
node AS MATERIALIZED (SELECT r, dag_run_id, request_id, e.id, e.parent, e.key, e.type, e.value, regexp_replace(e.fullkey, '[[][0-9]+[]]', '[]', 'g') AS path FROM inner_, json_tree(inner_.s) e),
held AS MATERIALIZED (
  SELECT n.*, coalesce(p.type = 'ARRAY', false) AS element, CASE p.type WHEN 'OBJECT' THEN n.key WHEN 'ARRAY' THEN CASE WHEN g.type = 'OBJECT' THEN p.key END END AS held
  FROM node n LEFT JOIN node p ON p.r = n.r AND p.id = n.parent LEFT JOIN node g ON g.r = n.r AND g.id = p.parent),
kind AS MATERIALIZED (
  SELECT *, CASE WHEN type = 'OBJECT' THEN list_filter([
      CASE held WHEN 'subtasks' THEN 'subtask' WHEN 'comments' THEN 'comment' WHEN 'histories' THEN 'history' WHEN 'items' THEN 'item' END,
      CASE WHEN held IS DISTINCT FROM 'subtasks' AND json_exists(value, '$.key') AND json_exists(value, '$.fields') THEN 'issue' END], lambda x: x IS NOT NULL) ELSE [] END AS kinds,
    CASE WHEN type = 'OBJECT' THEN json_extract_string(value, '$.id') END AS own_id
  FROM held),
-- near: id of the nearest issue, subtask or history; home: nearest table around; owners: tables of the nearest row; around: key of that row. All with the node itself.
tree AS (
  SELECT r, dag_run_id, request_id, id, key, type, element, kinds, own_id, NULL::VARCHAR AS parent_id,
    CASE WHEN list_has_any(kinds, ['issue', 'subtask', 'history']) THEN own_id END AS near,
    CASE WHEN kinds = [] THEN ['record'] ELSE kinds END AS own, CASE WHEN kinds = [] THEN ['record'] ELSE kinds END AS owners, coalesce(kinds[-1], 'record') AS home, path AS home_path,
    NULL::VARCHAR AS over, CASE WHEN kinds = [] THEN request_id WHEN kinds[-1] = 'item' THEN '0' ELSE own_id END AS around
  FROM kind WHERE parent IS NULL
  UNION ALL
  SELECT k.r, k.dag_run_id, k.request_id, k.id, k.key, k.type, k.element, k.kinds, k.own_id, t.near,
    CASE WHEN list_has_any(k.kinds, ['issue', 'subtask', 'history']) THEN k.own_id ELSE t.near END,
    CASE WHEN k.kinds <> [] THEN k.kinds WHEN k.element AND k.type <> 'ARRAY' THEN [t.home || substr(k.path, length(t.home_path) + 1)] ELSE [] END AS mine,
    CASE WHEN mine <> [] THEN mine ELSE t.owners END, coalesce(k.kinds[-1], t.home), CASE WHEN k.kinds <> [] THEN k.path ELSE t.home_path END,
    t.around, CASE WHEN k.kinds <> [] AND k.kinds[-1] <> 'item' THEN k.own_id WHEN mine <> [] THEN CASE WHEN k.element THEN k.key ELSE '0' END ELSE t.around END
  FROM tree t JOIN kind k ON k.r = t.r AND k.parent = t.id)
"""
P5_SQL = f"""{_TREE_SQL}
SELECT DISTINCT dag_run_id, request_id, child_kind, CASE child_kind WHEN 'issue' THEN request_id ELSE parent_id END AS parent_id,
  CASE WHEN child_kind <> 'item' THEN own_id WHEN element THEN key ELSE '0' END AS child_id
FROM (SELECT *, unnest(kinds) AS child_kind FROM tree)
"""
P5_TABLES_SQL = f"""{_TREE_SQL}
SELECT "table", sum(a)::BIGINT AS rows, sum(f)::BIGINT AS filled, sum(k)::BIGINT AS with_key, sum(p)::BIGINT AS with_parent FROM (
  SELECT "table", 1 AS a, 0 AS f, (CASE WHEN "table" = 'record' THEN request_id IS NOT NULL WHEN "table" IN ('issue', 'subtask', 'comment', 'history') THEN own_id IS NOT NULL ELSE true END)::INT AS k,
    (CASE WHEN "table" = 'record' THEN false WHEN "table" = 'issue' THEN request_id IS NOT NULL WHEN "table" IN ('subtask', 'comment', 'history', 'item') THEN parent_id IS NOT NULL ELSE over IS NOT NULL END)::INT AS p
  FROM (SELECT *, unnest(own) AS "table" FROM tree)
  UNION ALL SELECT unnest(owners), 0, 1, 0, 0 FROM tree WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL')) GROUP BY "table"
"""


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the flat tables with all their columns: every scalar of every complete body stands in one of them."""
    bodies = table(spark, d, "request_queue").select(*REQUEST, "seq", "response_body").where("response_body is not null")
    return nested.flat_tables(bodies, "response_body", "request_id", [*REQUEST, "seq"], BODY_TABLES, whole=True)


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each flat table has, and how many values that aren't null, over all columns."""
    filled = F.size(F.map_filter("columns", lambda k, v: v.isNotNull()))
    return p5_rows(spark, d).groupBy("table").agg(F.count(F.lit(1)).alias("rows"), F.sum(filled).alias("filled"), F.count("row_key").alias("with_key"), F.count("parent_key").alias("with_parent"))


QUERIES = {
    "p1_found": p1_found, "p1_runs": p1_runs, "p2_percentiles": p2_percentiles, "p2_slices": p2_slices, "p2_slices_all": p2_slices_all, "p3_found": p3_found, "p3_normalised": p3_normalised, "p3_forms": p3_forms,
    "p4_found": p4_found, "p4_key_results": p4_key_results, "p4_distinct": p4_distinct, "p4_skew_join": p4_skew_join, "p4_join_types": p4_join_types, "p5_found": p5_found, "p5_rows": p5_rows, "p5_tables": p5_tables,
}
SQL = {"p1_found": P1_SQL, "p1_runs": P1_RUNS_SQL, "p2_percentiles": P2_SQL, "p2_slices": P2_SLICES_SQL, "p2_slices_all": P2_SLICES_ALL_SQL, "p3_forms": P3_FORMS_SQL, "p4_found": P4_FOUND_SQL, "p4_key_results": P4_KEYS_SQL, "p4_distinct": P4_DISTINCT_SQL, "p4_skew_join": P4_JOIN_SQL, "p4_join_types": P4_TYPES_SQL, "p5_found": P5_SQL, "p5_tables": P5_TABLES_SQL}
