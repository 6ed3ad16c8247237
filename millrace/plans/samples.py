"""Transforms that the sample pipelines use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.timestamps import to_utc
from millrace.operators.transform import register

DAY = 86_400_000_000


@register("samples:order_cycle", kind="frame")
def order_cycle(df: DataFrame) -> DataFrame:
    """Days from order to shipment, on joined order lines."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return df.withColumn("cycle_days", (us("l_shipdate") - us("o_orderdate")) / F.lit(float(DAY)))


@register("samples:line_key", kind="frame")
def line_key(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("l_orderkey", "order_key")


@register("samples:order_key", kind="frame")
def order_key(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("o_orderkey", "order_key")


@register("samples:event_record", schema="event_id long, event_type string, k long")
def event_record(record: dict) -> dict:
    """One record in, one out: a field of the properties."""
    import json

    return {"event_id": record["event_id"], "event_type": record["event_type"].upper(), "k": json.loads(record["props"] or "{}").get("k")}


@register("samples:event_batch", kind="batch", schema="event_id long, doubled double")
def event_batch(records: list[dict]) -> list[dict]:
    return [{"event_id": r["event_id"], "doubled": r["value"] * 2} for r in records]


@register("samples:event_twice", kind="batch", schema="event_id long, copy int")
def event_twice(records: list[dict]) -> list[dict]:
    """A batch that changes its number of rows."""
    return [{"event_id": r["event_id"], "copy": i} for r in records if r["event_type"] == "purchase" for i in (0, 1)]


ISSUE = "id string, key string, status string, assignee string, resolution_date string, created_date string, cycle_time_days double"


@register("samples:issue", schema=ISSUE)
def issue(record: dict) -> dict:
    """The flat row of a nested issue; missing parts are null, a missing assignee is Unassigned."""
    fields = record.get("fields") or {}
    created, resolved = fields.get("created"), fields.get("resolutiondate")
    us, good = to_utc([created, resolved], [None, None])
    return {
        "id": record.get("id"), "key": record.get("key"), "status": (fields.get("status") or {}).get("name"), "assignee": (fields.get("assignee") or {}).get("displayName") or "Unassigned",
        "resolution_date": resolved, "created_date": created, "cycle_time_days": float(us[1] - us[0]) / DAY if good.all() else None,
    }


@register("samples:nation_key", kind="frame")
def nation_key(df: DataFrame) -> DataFrame:
    return df.select(F.col("n_nationkey").cast("long").alias("k"), "n_name")


@register("samples:region_key", kind="frame")
def region_key(df: DataFrame) -> DataFrame:
    return df.select(F.col("r_regionkey").cast("long").alias("k"), "r_name")


@register("samples:square")
def square(record: dict) -> dict:
    return {"key": record["key"], "root": round(record["square"] ** 0.5)}
