"""Fan-out: one request per combination of parameter values."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.filter import column
from millrace.plans.spec import Connection, Parameter, RequestTemplate
from millrace.sources.ledger import request_ids


def values(spark: SparkSession, p: Parameter, steps: Mapping[str, DataFrame]) -> DataFrame:
    """The values of a parameter as one text column of its name. column: the distinct non-null values of an upstream column."""
    if p.source == "literal":
        return spark.range(1).select(F.lit(p.value).alias(p.name))
    if p.source == "list":
        return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in p.values]).cast("array<string>")).alias(p.name))
    if p.source == "range":
        if p.range_step == 0:
            raise ValueError(f"range_step of parameter '{p.name}' must not be 0")
        return spark.range(p.range_start, p.range_end, p.range_step).select(F.col("id").cast("string").alias(p.name))
    upstream = steps[p.from_step]
    return upstream.select(column(upstream, p.field).cast("string").alias(p.name)).where(F.col(p.name).isNotNull()).distinct()


#: Combinations of several column parameters at most. Each is a request, so this many take more than a month at 300 a second.
MOST_COMBINATIONS = 1_000_000_000
#: Numbers of a range that are listed at once.
BLOCK = 4096


def _with_range(df: DataFrame, p: Parameter) -> DataFrame:
    """Each row once per number of the range, in two steps, so that no array is longer than BLOCK or the range's blocks."""
    n = len(range(p.range_start, p.range_end, p.range_step))
    if n == 0:
        return df.withColumn(p.name, F.lit("")).limit(0)
    block = df.select("*", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BLOCK))).alias("__block"))
    first, last = F.col("__block") * BLOCK, F.least(F.col("__block") * BLOCK + BLOCK - 1, F.lit(n - 1))
    number = F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("__i")
    return block.select(*df.columns, number).select(*df.columns, (F.lit(p.range_start) + F.col("__i") * p.range_step).cast("string").alias(p.name))


def combinations(spark: SparkSession, parameters: Sequence[Parameter], steps: Mapping[str, DataFrame]) -> DataFrame:
    """Every combination of values. Values written in the document, and ranges, are listed beside each row; only a second
    column parameter multiplies two sets of rows, which is what such a step asks for (each value set is distinct first)."""
    for p in parameters:
        if p.source == "range" and p.range_step == 0:
            raise ValueError(f"range_step of parameter '{p.name}' must not be 0")
    columns = [p for p in parameters if p.source == "column"]
    listed = [p for p in parameters if p.source != "column"]
    if columns:
        out = values(spark, columns[0], steps)
    else:
        # The longest range is spread over tasks, the rest goes along.
        longest = max((p for p in listed if p.source == "range"), key=lambda p: len(range(p.range_start, p.range_end, p.range_step)), default=None)
        out = values(spark, longest, steps) if longest else spark.range(1).select()
        listed = [p for p in listed if p is not longest]
    if len(columns) > 1:
        # Each value set is distinct; what they multiply to is known before it is made.
        product = math.prod(values(spark, p, steps).count() for p in columns)
        if product > MOST_COMBINATIONS:
            raise ValueError(f"parameters {[p.name for p in columns]} have {product} combinations, more than {MOST_COMBINATIONS}")
    for p in columns[1:]:
        out = out.join(values(spark, p, steps))
    for p in listed:
        if p.source == "range":
            out = _with_range(out, p)
        else:
            texts = p.values if p.source == "list" else (p.value,)
            out = out.select("*", F.explode(F.array(*[F.lit(v) for v in texts]).cast("array<string>")).alias(p.name))
    return out.select(*[p.name for p in parameters])


def requests(combined: DataFrame, template: RequestTemplate, connection: Connection, dag_run_id: str, step_id: str, url_encode: bool = False) -> DataFrame:
    """Requests (request_id, dag_run_id, step_id, method, url, headers, body, accept, tag): {name} in the path is the value of that column."""
    url = F.lit(connection.base_url.rstrip("/") if template.path_template.startswith("/") else connection.base_url)
    parts = [url]
    for text in re.split(r"(\{\w+\})", template.path_template):
        name = text[1:-1] if text.startswith("{") else ""
        if name and name in combined.columns:
            cell = F.col(f"`{name}`").cast("string")
            parts.append(F.url_encode(cell) if url_encode else cell)
        elif text:
            parts.append(F.lit(text))
    made = combined.select(
        F.lit(dag_run_id).alias("dag_run_id"), F.lit(step_id).alias("step_id"), F.lit(template.method).alias("method"), F.concat(*parts).alias("url"),
        F.lit("{}").alias("headers"), F.lit(None).cast("string").alias("body"), F.lit(template.accept).alias("accept"), F.lit(template.tag).alias("tag"),
    )
    return request_ids(made.where(F.col("url").isNotNull()))
