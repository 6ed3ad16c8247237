"""One row per element of a list, field of a struct, or entry of a map.

The exploded column goes, its siblings stay. With drop_null (the default) rows whose list is null or empty are dropped; else they
stay with a null element. Null elements of a list are elements. A struct gives a row per field with name and value (as
text). The element's column replaces a sibling of the same name.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.filter import column


def unnest(df: DataFrame, field: str, array_column: str = "", drop_null: bool = True) -> DataFrame:
    name = array_column or field
    kind, c = df.schema[field].dataType if field in df.columns else None, column(df, field)
    explode = F.explode if drop_null else F.explode_outer
    if isinstance(kind, T.StructType):
        cells = [F.struct(F.lit(f.name).alias("name"), c[f.name].cast("string").alias("value")) for f in kind.fields]
        c = F.when(c.isNotNull(), F.array(*cells))
    elif isinstance(kind, T.MapType):
        c = F.map_entries(c)
    elif not isinstance(kind, T.ArrayType):
        raise ValueError(f"unnest needs a list or struct, but {field} is {kind.simpleString()}")
    rest = [F.col(f"`{x}`") for x in df.columns if x not in (field, name)]
    return df.select(*rest, explode(c).alias(name))


def project(df: DataFrame, path: str) -> DataFrame:
    """The sub-field at a dot path of the output of a step, alone; of a JSON text (column ``body`` if the path isn't a column's) it is read from the text.

    Everything else goes. The column is named after the last name of the path.
    """
    head, *rest = path.split(".")
    name = (rest or [head])[-1]
    if path in df.columns:
        return df.select(F.col(f"`{path}`").alias(path))
    if head in df.columns and not isinstance(df.schema[head].dataType, T.StringType):
        return df.select(functools.reduce(lambda c, n: c[n], rest, F.col(f"`{head}`")).alias(name))
    text, inner = (head, rest) if head in df.columns else ("body", [head, *rest])
    column(df, text)
    found = F.get_json_object(F.col(f"`{text}`"), "$." + ".".join(inner)) if inner else F.col(f"`{text}`")
    # A list in a JSON text becomes a list of JSON texts.
    listed = F.when(F.substring(F.ltrim(found), 1, 1) == "[", F.from_json(found, "array<string>")).otherwise(F.when(found.isNotNull(), F.array(found)))
    return df.select(listed.alias(name))
