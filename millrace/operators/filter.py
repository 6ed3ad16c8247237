"""Rows that meet all conditions (field, op, value).

Comparisons follow SQL: a null cell meets no condition but is_null. Of doubles, NaN meets only neq. An empty list of
conditions keeps all rows. Everything is one expression for Catalyst, so conditions reach the scan.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.spec import Condition

OPS = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "lt": operator.lt, "gte": operator.ge, "lte": operator.le, "is_null": None, "not_null": None}
ALIASES = {"ne": "neq"}


def column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"no such column: {name}")
    return F.col(f"`{name}`")


def literal(value: str, kind: T.DataType):
    """The value of a condition in the type of its column; ValueError if it isn't one."""
    if isinstance(kind, T.IntegralType):
        return F.lit(int(value)).cast("long")
    if isinstance(kind, T.DecimalType):
        return F.lit(value).cast(kind)
    if isinstance(kind, T.FractionalType):
        return F.lit(float(value))
    if isinstance(kind, T.BooleanType):
        return F.lit(value in ("true", "1"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(value).cast(kind)
    return F.lit(value)


def predicate(df: DataFrame, c: Condition) -> Column:
    op = ALIASES.get(c.op, c.op)
    cell = column(df, c.field)
    if op == "is_null":
        return cell.isNull()
    if op == "not_null":
        return cell.isNotNull()
    kind = df.schema[c.field].dataType
    odd = isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    if op not in OPS or odd or (isinstance(kind, T.BooleanType) and op not in ("eq", "neq")):
        raise ValueError(f"unsupported op '{c.op}' for column type {kind.simpleString()}")
    meets = OPS[op](cell, literal(c.value, kind))
    if isinstance(kind, (T.DoubleType, T.FloatType)) and op in ("eq", "gt", "gte"):
        meets = meets & ~F.isnan(cell)
    return meets


def filter_rows(df: DataFrame, conditions: Iterable[Condition]) -> DataFrame:
    """The rows that meet all conditions."""
    return df.where(functools.reduce(operator.and_, [predicate(df, c) for c in conditions], F.lit(True)))
