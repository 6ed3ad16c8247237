"""Writing results: CSV, JSON, gzipped JSON, JSON lines and Parquet, at templated paths.

``{date}`` and ``{ts}`` in a path become the run's day or hour (by partition rule) and its epoch seconds, in UTC. Parquet and JSON lines are
written by all tasks into a folder, the scalable form. ``csv`` and ``json`` follow the same rule unless a single file is asked for: then the rows pass through
one task, which streams them. Null is an empty CSV cell and JSON null; doubles have six decimals in CSV and full precision in JSON.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.aggregate import as_text

FORMATS = ("parquet", "csv", "json", "json.gz", "jsonl")


def materialize(template: str, partition: str = "", now: datetime | None = None) -> str:
    """The path of a run. daily: YYYY-MM-DD, hourly: YYYY-MM-DD-HH; anything else is daily."""
    now = (now or datetime.now(UTC)).astimezone(UTC)
    date = now.strftime("%Y-%m-%d-%H" if partition == "hourly" else "%Y-%m-%d")
    return template.replace("{date}", date).replace("{ts}", str(int(now.timestamp())))


def for_csv(df: DataFrame) -> DataFrame:
    """Cells as CSV has them: doubles with six decimals, nested values as JSON."""

    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c).alias(f.name)
        return as_text(c, f.dataType).alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def as_json(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as a JSON object with its nulls."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False, mode: str = "overwrite") -> str:
    """Writes the rows and returns the path; ValueError for an unknown format."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported sink format: {fmt}")
    if fmt == "json" and single_file:
        _array(df).write.mode(mode).text(path)
        return path
    shaped, kind, options = formatted(df.coalesce(1) if single_file and fmt != "parquet" else df, fmt)
    shaped.write.mode(mode).format(kind).options(**options).save(path)
    return path


def formatted(df: DataFrame, fmt: str) -> tuple[DataFrame, str, dict]:
    """The rows as a format has them, Spark's name of the format, and its options."""
    if fmt == "parquet":
        return df, "parquet", {}
    if fmt == "csv":
        blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        return for_csv(df), "csv", {"header": True, "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": ""} | blanks
    return as_json(df), "text", {"compression": "gzip"} if fmt == "json.gz" else {}


def _array(df: DataFrame) -> DataFrame:
    """The rows as lines of one JSON array, streamed through one task without gathering them."""

    def wrap(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            lines = [x for x in batch.column(0).to_pylist() if x is not None]
            if lines:
                yield pa.RecordBatch.from_pydict({"value": [("[" if first and not i else ",") + x for i, x in enumerate(lines)]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    # A row without value, so that an empty table has a task too, which writes the brackets.
    mark = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))
    return as_json(df).unionByName(mark).coalesce(1).mapInArrow(wrap, "value string")
