"""Reading the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its zoneless timestamps read as UTC (the session's zone must be UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = {c: F.col(f"`{c}`").cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoneless) if zoneless else df
