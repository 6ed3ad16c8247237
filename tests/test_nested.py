import json

import nested_brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators import nested
from millrace.plans.training import BODY_TABLES

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["id", "key", "fields", "comments", "items", "subtasks", "histories", "a"]), x, max_size=4), max_leaves=25)


def same_json(key):
    """A key that is an object or array itself comes out as written; here in one form."""
    try:
        return json.dumps(json.loads(key)) if key and key[0] in "[{" else key
    except ValueError:
        return key


def read(texts):
    """The rows of records by the library, as the brute force has them."""
    out = [[] for _ in texts]
    for at, bodies in nested._chunks(pa.array(texts, pa.string())):
        record, made = nested.pivot(nested.triples(bodies), pa.array(["r"] * len(bodies)), BODY_TABLES)
        for r, *row in zip(record.tolist(), *[m.to_pylist() for m in made], strict=True):
            out[at[r]].append((row[0], same_json(row[1]), same_json(row[2]), row[3], sorted(row[4], key=str)))
    return out


def brute(text):
    whole, value = nested_brute.decode(text)
    return [(r.table, same_json(r.parent), same_json(r.key), r.position, sorted(r.columns.items(), key=str)) for r in nested_brute.pivot(value, "r", BODY_TABLES)] if whole else []


def triples_of(text):
    for _, bodies in nested._chunks(pa.array([text], pa.string())):
        t = nested.triples(bodies)
        kinds = {nested._OBJECT: "object", nested._ARRAY: "array"}
        values = t.texts(np.arange(len(t.kind))).to_pylist()
        return list(zip(np.array(t.path_texts(), dtype=object)[t.path].tolist(), map(tuple, nested._ordinals(t).to_pylist()), [kinds.get(k, "scalar") for k in t.kind.tolist()], [None if k < nested._STRING else v for k, v in zip(t.kind.tolist(), values, strict=True)], strict=True))
    return []


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON, max_size=4), st.sampled_from([(", ", ": "), (",", ":"), (" ,\n", "\t: ")]))
def test_triples_and_rows_against_brute_force(values, separators):
    texts = [json.dumps(v, separators=separators, ensure_ascii=i % 2 == 0) for i, v in enumerate(values)]
    assert read(texts) == [brute(t) for t in texts]
    for t in texts:
        whole, value = nested_brute.decode(t)
        want = [(p, o, k if k in ("object", "array") else "scalar", v) for p, o, k, v in nested_brute.triples(value)]
        assert whole and triples_of(t) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*'{}[]:,"\\ntue0123.-eE \n\x01', "true", "null", '"a"', '"id":', "\\u00e9"]), max_size=12).map("".join), min_size=1, max_size=5))
def test_what_is_json(texts):
    """Broken records are told from whole ones, and harm none of their neighbours."""

    def is_json(t):
        try:
            return json.loads(t, parse_constant=nested._refuse) is not None or True
        except ValueError:
            return False

    good = json.dumps({"key": "K", "fields": {}, "id": 1})
    mixed = [x for t in texts for x in (t, good)]
    got = read(mixed)
    assert [bool(r) for r in got] == [is_json(x) for x in mixed]
    assert all(r[0][:3] == ("issue", "r", "1") for r in got[1::2])


NO_JSON = ["", None, "  ", "{", '{"a":1', '{"a":1} x', "[1,]", '{"a":NaN}', "nothing", "{'a':1}", '"half', '{"a" 1}', "[1 2]", "{,}", "]", '{"a":1,}', "[1}", '{"a":"\n"}', '"\\x"', "01", "[-]", '{1:2}', "{} {}", '"\\u12g4"', "[" * 50_000]


@pytest.mark.parametrize("text", NO_JSON)
def test_what_is_no_json(text):
    assert nested_brute.decode(text) == (False, None)
    assert read([text, "1"])[0] == [] and read([text, "[2]"])[1] != []


def test_names_that_come_twice():
    text = '{"a":{"x":1},"b":[1,{"id":3,"id":4}],"a":{"y":[5]},"b":7}'
    assert triples_of(text) == [("$", (), "object", None), ("$.a", (), "object", None), ("$.a.y", (), "array", None), ("$.a.y[]", (0,), "scalar", "5"), ("$.b", (), "scalar", "7")]
    assert read(['{"\\u0061":1,"a":2}']) == [[("record", None, "r", 0, [("a", "2")])]]


def test_json_within_a_string():
    inner = {"key": "A", "fields": {}, "id": 1}
    for text in (json.dumps(json.dumps(inner)), " " + json.dumps(json.dumps(json.dumps(inner)))):
        assert read([text]) == read([json.dumps(inner)])
    assert read([json.dumps("accepted")]) == [[("record", None, "r", 0, [("$", "accepted")])]]
    assert read([json.dumps({"a": json.dumps({"id": 1})})]) == [[("record", None, "r", 0, [("a", '{"id": 1}')])]]


def test_very_deep_and_very_long():
    deep = "[" * 5_000 + '{"comments":[{"id":1}]}' + "]" * 5_000
    assert [r[:3] for r in read([deep])[0] if r[0] == "comment"] == [("comment", None, "1")]
    digits = "9" * 6000
    assert read([f'{{"id":{digits},"comments":{{"id":-0.50E+1}}}}'])[0][1][:3] == ("comment", None, "-0.50E+1")
    assert read([f'{{"id":{digits}}}']) == [[("record", None, "r", 0, [("id", digits)])]]
    long = "x" * (nested.CHUNK + 10)
    assert read([json.dumps({"a": long}), "[1]", json.dumps(long)])[0][0][4] == [("a", long)]


def test_tables_and_links(spark):
    body = {
        "id": 7, "key": "A-1", "fields": {
            "summary": "s", "comment": {"comments": [{"id": "c1", "body": "hi"}, None, {"id": 2.50}]},
            "subtasks": [{"id": "s1", "key": "A-2", "fields": {"summary": "t"}, "comments": {"id": "direct"}}, [{"id": "inner"}]],
        }, "changelog": {"histories": [{"id": None, "items": [3, {"field": "x"}, {"field": "y"}]}, {"id": "h", "items": {"field": "z"}}]},
    }
    df = spark.createDataFrame([("r1", json.dumps(body)), ("r1", json.dumps(body)), ("r2", "{"), ("r3", None), (None, json.dumps([body])), ("r4", json.dumps("\ud800"))], "req string, body string")
    df = df.withColumn("table", F.lit("extra")).withColumn("position", F.lit(9))
    got = nested.flat_tables(df, "body", "req", ["req"], BODY_TABLES)
    want = {
        ("issue", "r1", "7"), ("comment", "7", "c1"), ("comment", "7", "2.50" if "2.50" in json.dumps(body) else "2.5"), ("subtask", "7", "s1"), ("comment", "s1", "direct"),
        ("history", "7", None), ("item", None, "1"), ("item", None, "2"), ("history", "7", "h"), ("item", "h", "0"),
    }
    assert {tuple(r) for r in got.where("req = 'r1'").select("table", "parent_key", "row_key").collect()} == want
    assert got.where("req = 'r1'").count() == 2 * len(want)
    assert {r.parent_key for r in got.where("req is null and table = 'issue'").collect()} == {None}
    items = nested.table_of(got.where("req = 'r1'"), BODY_TABLES[-1], ["req"])
    assert items.columns == ["req", "parent_key", "row_key", "position", "field", "fromString", "toString"]
    assert {r.field for r in items.collect()} == {"x", "y", "z"}
    links = nested.flat_tables(df, "body", "req", ["req"], BODY_TABLES, columns=False)
    assert rows(links) == rows(got.drop("columns"))
    assert nested.flat_tables(df.limit(0), "body", "req", ["req"], BODY_TABLES).count() == 0


def test_triples_of_a_table(spark):
    df = spark.createDataFrame([("r", '{"a":[{"b":1},{"b":null}],"c":{}}'), ("s", "no")], "req string, body string")
    got = {(r.path, tuple(r.ordinals), r.kind, r.value) for r in nested.path_triples(df, "body", ["req"]).collect()}
    assert got == {
        ("$", (), "object", None), ("$.a", (), "array", None), ("$.a[]", (0,), "object", None), ("$.a[].b", (0,), "number", "1"),
        ("$.a[]", (1,), "object", None), ("$.a[].b", (1,), "null", None), ("$.c", (), "object", None),
    }


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_every_scalar_has_a_place_in_the_tables(value):
    text = json.dumps({"key": 1, "a.b": 2, "fields": {"a": {"b": 3}, "a.b": 4}, "comments": value})
    t = nested.triples(pa.array([text]))
    _, (table, _, _, _, columns, row, _) = nested.pivot(t, pa.array(["r"]), BODY_TABLES)
    # An object of two tables has the same columns in both.
    once = list({(n, k): v for n, c in zip(row.to_pylist(), columns.to_pylist(), strict=True) for k, v in c}.values())
    assert sorted(once, key=str) == sorted((v for _, _, k, v in triples_of(text) if k == "scalar"), key=str)
    links = nested.pivot(t, pa.array(["r"]), BODY_TABLES, columns=False, whole=False)[1]
    assert links[0].to_pylist() == [x for x in table.to_pylist() if x in {b.name for b in BODY_TABLES}]


def test_columns_that_nobody_listed(spark):
    issue = {"id": 7, "key": "A-1", "fields": {"labels": ["x", "y"], "parts": [{"name": "p", "ways": [[1], [2, None]]}], "status": {"statusCategory": {"id": 3}}, "customfield_1": True}}
    df = spark.createDataFrame([("r1", json.dumps({"total": 1, "issues": [issue]})), ("r2", '"accepted"'), ("r3", "{")], "req string, body string")
    got = {(r.req, r.table, r.parent_key, r.row_key, r.row, r.parent_row): r.columns for r in nested.flat_tables(df, "body", "req", ["req"], BODY_TABLES, whole=True).collect()}
    kept = {k[:4]: v for k, v in got.items()}
    assert kept == {
        ("r1", "record", None, "r1"): {"total": "1"}, ("r2", "record", None, "r2"): {"$": "accepted"},
        ("r1", "issue", "r1", "7"): {"id": "7", "key": "A-1", "fields.status.statusCategory.id": "3", "fields.customfield_1": "true"},
        ("r1", "issue.fields.labels[]", "7", "0"): {"$": "x"}, ("r1", "issue.fields.labels[]", "7", "1"): {"$": "y"}, ("r1", "issue.fields.parts[]", "7", "0"): {"name": "p"},
        ("r1", "issue.fields.parts[].ways[][]", "0", "0.0"): {"$": "1"}, ("r1", "issue.fields.parts[].ways[][]", "0", "1.0"): {"$": "2"}, ("r1", "issue.fields.parts[].ways[][]", "0", "1.1"): {"$": None},
    }
    at = {k[4]: k for k in got if k[0] == "r1"}
    assert all(at[k[5]][3] == k[2] for k in at.values() if k[5] is not None)


def test_rows_of_the_query_hold_all_scalars(spark, small):
    from millrace.plans.training import REQUEST, p5_rows
    from millrace.sources.tables import table

    bodies = table(spark, small, "request_queue").select(*REQUEST, "response_body")
    scalars = nested.path_triples(bodies, "response_body", REQUEST).where("kind not in ('object', 'array')").count()
    assert scalars and p5_rows(spark, small).agg(F.sum(F.size("columns"))).first()[0] == scalars
