import json

import pytest

from conftest import rows
from millrace.plans import ingestion
from millrace.plans.stream import run_stream


def steps(at, join):
    files = [{"id": n, "type": "filter", "input": {"from_connection": "in", "path": n}, "condition": []} for n in ("a", "b")]
    return {
        "name": "s", "start_at": "a", "connections": {"in": {"type": "file", "root": f"{at}/in"}, "out": {"type": "file", "root": f"{at}/out"}},
        "steps": [*files, {"id": "j", "type": "join", "input": {"inputs": ["a", "b"]}, "join_config": {"key": "k", "timeout": "6s"} | join},
                  {"id": "o", "type": "sink", "connection": "out", "input": {"from_step": "j"}, "output": {"path_template": "o", "format": "parquet"}}],
    }


@pytest.mark.parametrize(("join", "want", "letters"), [
    ({"on_timeout": "dead_letter"}, [(1, "x", 0.5)], {("2", "a"), ("3", "b"), (None, "a")}),
    ({"join": "left", "on_timeout": "drop"}, [(1, "x", 0.5), (2, "y", None)], set()),
    ({"on_timeout": "emit_null"}, [(1, "x", 0.5), (2, "y", None), (3, None, 1.5)], set()),
])
def test_join_policies(spark, tmp_path, join, want, letters):
    spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, v string").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(1, 0.5), (3, 1.5)], "k long, v double").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    report = run_stream(spark, steps(tmp_path, join), most_sec=120, state_dir=f"{tmp_path}/state", dag_run_id="r")
    assert report.success, report.error_message
    got = spark.read.schema("k long, v string, v_b double").parquet(report.outputs["o"])
    assert rows(got) == sorted(want, key=lambda r: r[0])
    if letters:
        found = spark.read.schema("key string, source string, payload string").json(report.outputs["j.dead_letters"]).collect()
        assert {(r.key, r.source) for r in found} == letters
        assert {json.loads(r.payload)["v"] for r in found} == {"y", 1.5, "z"}


def test_responses_flow_through_the_steps(spark, tmp_path, small):
    with ingestion.Loopback(failures=1) as server:
        d = ingestion._document(server.url, max_pending=7)
        d["connections"]["store"]["root"] = small
        d["connections"]["out"] = {"type": "file", "root": str(tmp_path / "out")}
        d["steps"] += [
            {"id": "flat", "type": "transform", "input": {"from_step": "items"}, "function": {"entrypoint": "samples:square", "schema": "key long, root long"}},
            {"id": "some", "type": "filter", "input": {"from_step": "flat"}, "condition": [{"field": "key", "op": "gte", "value": 10}]},
            {"id": "o", "type": "sink", "connection": "out", "input": {"from_step": "some"}, "output": {"path_template": "o", "format": "csv"}},
        ]
        # The keys are asked for in a batch, so that the requests are known.
        from millrace.sources.tables import table

        report = run_stream(spark, d, most_sec=120, state_dir=f"{tmp_path}/state", tables={"store/nation.parquet": table(spark, small, "nation")})
    assert report.success, report.error_message
    assert (report.total_requests, report.successes, report.retries) == (25, 25, 25)
    assert sorted(int(r.key) for r in spark.read.option("header", True).csv(report.outputs["o"]).collect()) == list(range(10, 25))


def test_errors_are_reported(spark, tmp_path):
    assert not run_stream(spark, steps(tmp_path / "none", {}), state_dir=f"{tmp_path}/s").success
