"""Settings read from the running session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only in local mode, where no cluster names one, a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))
        current = sc.getCheckpointDir()
    return current


def durable_dir(spark: SparkSession) -> str:
    """The shared folder itself, where what later sessions need is kept (``shared_dir`` is this session's part of it)."""
    return shared_dir(spark).rstrip("/").rpartition("/")[0]


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder for intermediate tables, on the shared folder; it is deleted when the session's process ends."""
    at = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
