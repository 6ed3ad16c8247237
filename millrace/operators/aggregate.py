"""Grouped aggregates: count, sum, avg, min, max and percentile.

Results are doubles (count: long). Nulls are skipped by all but count, which counts rows and ignores its field; NaN is skipped by min
and max. A group without values has 0.0. Group keys come out as text (doubles with six decimals, null stays null)
unless their types are to be preserved. Without keys there is one row, and none for an empty table.

Percentiles leave out NaN; infinities are values. On a stream they are an aggregate that keeps a group's distinct values as state. In a batch
they are found by bisection, which holds no group in a task; that runs passes at once, over the input itself if that is but a scan,
else over a checkpoint of the columns needed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.session import cut
from millrace.operators import percentiles
from millrace.operators.filter import column
from millrace.plans.spec import Aggregate

FUNCS = ("count", "sum", "avg", "min", "max", "percentile", "approx_percentile")


def as_text(c: Column, kind: T.DataType) -> Column:
    """A cell as text, as keys and CSV have it."""
    return F.when(c.isNotNull(), F.format_string("%.6f", c.cast("double"))) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.cast("string")


def _value(df: DataFrame, a: Aggregate) -> Column:
    c = column(df, a.field)
    if not isinstance(df.schema[a.field].dataType, T.NumericType):
        raise ValueError(f"aggregate '{a.func}' requires a numeric field (got: {a.field})")
    return c.cast("double")


def _measure(df: DataFrame, a: Aggregate) -> Column:
    if a.func not in FUNCS:
        raise ValueError(f"unsupported aggregate func: {a.func}")
    if a.func == "count":
        return F.count(F.lit(1))
    x = _value(df, a)
    if a.func in ("percentile", "approx_percentile") and not 0 <= a.arg <= 100:
        raise ValueError(f"percentile arg must lie between 0 and 100: {a.arg}")
    found = {
        "sum": lambda: F.sum(x),
        "avg": lambda: F.avg(x),
        "min": lambda: F.min(F.nanvl(x, F.lit(None).cast("double"))),
        "max": lambda: F.max(F.nanvl(x, F.lit(None).cast("double"))),
        "percentile": lambda: F.percentile(F.nanvl(x, F.lit(None).cast("double")), F.lit(a.arg / 100)),
        "approx_percentile": lambda: F.percentile_approx(x, a.arg / 100, 10_000),
    }[a.func]()
    return F.coalesce(found, F.lit(0.0))


def _is_scan(df: DataFrame) -> bool:
    return not re.search(r"\b(Join|Aggregate|Generate|Window|Sort|MapIn\w+|\w*EvalPython|RepartitionBy\w+)\b", df._jdf.queryExecution().optimizedPlan().toString())


def _with_percentiles(df: DataFrame, group_by: Sequence[str], aggregates: list[Aggregate], preserve_key_types: bool) -> DataFrame:
    """The aggregates of a batch, percentiles by bisection."""
    used = list(dict.fromkeys([*group_by, *(a.field for a in aggregates if a.func != "count")]))
    df = df.select(*[F.col(f"`{c}`") for c in used])
    df = df if _is_scan(df) else cut(df)
    plain = [a for a in aggregates if a.func != "percentile"]
    out = aggregate(df, group_by, plain or [Aggregate("__n", "", "count")], preserve_key_types)
    keys = [f"__key{i}" for i in range(len(group_by) or 1)]
    # Keys are matched by their text; without keys all rows have the same. Those of the output are text already, unless their types are kept.
    text = lambda c: F.col(f"`{c}`").cast("string") if preserve_key_types else as_text(F.col(f"`{c}`"), df.schema[c].dataType)
    source = df.withColumns({k: text(c) for k, c in zip(keys, group_by, strict=False)} or {keys[0]: F.lit("")})
    out = out.withColumns({k: F.col(f"`{c}`").cast("string") for k, c in zip(keys, group_by, strict=False)} or {keys[0]: F.lit("")})
    for field in dict.fromkeys(a.field for a in aggregates if a.func == "percentile"):
        wanted = [a for a in aggregates if a.func == "percentile" and a.field == field]
        got = percentiles.percentiles([source.select(*keys, F.col(f"`{field}`").alias("__value"))], [keys], "__value", sorted({a.arg / 100 for a in wanted}), infinite=True)
        each = got.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(*[F.max(F.when(F.col("p") == a.arg / 100, F.col("value"))).alias(a.name) for a in wanted])
        out = out.join(each, functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]), "left").drop(*[f"{k}_" for k in keys])
    cells = [F.coalesce(F.col(f"`{a.name}`"), F.lit(0.0)).alias(a.name) if a.func == "percentile" else F.col(f"`{a.name}`") for a in aggregates]
    return out.select(*[F.col(f"`{c}`") for c in group_by], *cells)


def aggregate(df: DataFrame, group_by: Sequence[str], aggregates: Iterable[Aggregate], preserve_key_types: bool = False, sort: bool = False) -> DataFrame:
    """Keys, then aggregates, in the order given; the rows in no order, unless ``sort``: by the keys, nulls first."""
    aggregates = list(aggregates)
    measures = [_measure(df, a).alias(a.name) for a in aggregates]
    if sort:
        return aggregate(df, group_by, aggregates, preserve_key_types).orderBy(*[F.col(f"`{c}`") for c in group_by])
    if not df.isStreaming and any(a.func == "percentile" for a in aggregates):
        return _with_percentiles(df, group_by, aggregates, preserve_key_types)
    if not group_by:
        out = df.agg(*measures, F.count(F.lit(1)).alias("__rows")).where("__rows > 0")
        return out.drop("__rows")
    keys = [column(df, k) if preserve_key_types else as_text(column(df, k), df.schema[k].dataType) for k in group_by]
    return df.groupBy(*[k.alias(n) for k, n in zip(keys, group_by, strict=True)]).agg(*measures)
