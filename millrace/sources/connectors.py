"""Where files are: named connectors over a local or shared folder and S3-compatible stores."""

from __future__ import annotations

from pathlib import PurePosixPath
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import spec


class Connector(Protocol):
    """A place to read from and write to. ``uri`` is what Spark's readers and writers get."""

    def uri(self, path: str) -> str: ...

    def exists(self, spark: SparkSession, path: str) -> bool: ...


def _inside(path: str) -> str:
    """A relative path that stays below its root; ValueError for others."""
    parts = PurePosixPath(path).parts
    if not parts or path.startswith("/") or ".." in parts or "://" in path:
        raise ValueError(f"path leaves the connector's root: {path!r}")
    return str(PurePosixPath(*parts))


class _Files:
    def uri(self, path: str) -> str:
        raise NotImplementedError

    def _at(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.uri(path))
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, spark: SparkSession, path: str) -> bool:
        fs, at = self._at(spark, path)
        return fs.exists(at)

    def write_text(self, spark: SparkSession, path: str, data: str) -> None:
        """Writes a small text as one file, over any that is there; makes the folders above."""
        fs, at = self._at(spark, path)
        out = fs.create(at, True)
        out.write(bytearray(data.encode()))
        out.close()

    def read_text(self, spark: SparkSession, path: str) -> str:
        """The whole text of a small file."""
        if not self.exists(spark, path):
            raise FileNotFoundError(f"cannot open for read: {self.uri(path)}")
        return spark.read.text(self.uri(path), wholetext=True).first()["value"]


class FileConnector(_Files):
    """Files below a root, local or of any file system that Hadoop knows."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def uri(self, path: str) -> str:
        return f"{self.root}/{_inside(path)}"


class S3Connector(_Files):
    """Objects below a prefix of a bucket, through s3a. The keys go to the session's Hadoop settings, never into paths or plans."""

    def __init__(self, bucket: str, prefix: str = "", endpoint: str = "", access_key: str = "", secret_key: str = ""):
        self.bucket, self.prefix, self.endpoint = bucket, prefix.strip("/"), endpoint
        self._keys = (access_key, secret_key)

    def uri(self, path: str) -> str:
        return "/".join(["s3a:/", self.bucket, *([self.prefix] if self.prefix else []), _inside(path)])

    def settings(self) -> dict[str, str]:
        at = f"fs.s3a.bucket.{self.bucket}"
        found = {f"{at}.endpoint": self.endpoint, f"{at}.access.key": self._keys[0], f"{at}.secret.key": self._keys[1], f"{at}.path.style.access": "true" if self.endpoint else ""}
        return {k: v for k, v in found.items() if v}

    def configure(self, spark: SparkSession) -> None:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in self.settings().items():
            conf.set(k, v)


class Registry:
    """Connectors by name."""

    def __init__(self) -> None:
        self._known: dict[str, Connector] = {}

    def add(self, name: str, connector: Connector) -> None:
        self._known[name] = connector

    def has(self, name: str) -> bool:
        return name in self._known

    def get(self, name: str) -> Connector:
        if name not in self._known:
            raise KeyError(f"unknown connector: {name}")
        return self._known[name]


def registry_of(p: spec.Pipeline, spark: SparkSession | None = None) -> Registry:
    """The connectors that a pipeline's connections describe; http and stub connections have none."""
    out = Registry()
    for c in p.connections:
        if c.type == "s3":
            s3 = S3Connector(c.bucket, c.prefix, c.endpoint, c.access_key, c.secret_key)
            if spark is not None:
                s3.configure(spark)
            out.add(c.name, s3)
        elif c.type == "file":
            out.add(c.name, FileConnector(c.root or c.prefix))
    return out


def read(spark: SparkSession, uri: str) -> DataFrame:
    """A file or folder by its ending: parquet, csv (with header), json (an array, objects or lines), jsonl, txt."""
    ending = uri.rstrip("/").rsplit("/", 1)[-1]
    if ".csv" in ending:
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\0").option("emptyValue", "").csv(uri)
    if ".jsonl" in ending or ".ndjson" in ending:
        return spark.read.json(uri)
    if ".json" in ending:
        return read_json(spark, uri)
    if ".txt" in ending:
        return spark.read.text(uri)
    return spark.read.parquet(uri)


def read_stream(spark: SparkSession, uri: str) -> DataFrame:
    """The files of a folder, or of a pattern, as a stream, with the schema that ``read`` finds: parquet, csv, json lines, txt."""
    ending = uri.rstrip("/").rsplit("/", 1)[-1]
    reader = spark.readStream.schema(read(spark, uri).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and not fs.getFileStatus(at).isDirectory():
        # A stream reads folders: of this one, only the file.
        reader, uri = reader.option("pathGlobFilter", ending), at.getParent().toString()
    if ".csv" in ending:
        return reader.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\0").option("emptyValue", "").csv(uri)
    if ".json" in ending or ".ndjson" in ending:
        return reader.json(uri)
    return reader.text(uri) if ".txt" in ending else reader.parquet(uri)


def read_json(spark: SparkSession, uri: str) -> DataFrame:
    """A JSON document: a list of scalars becomes one column ``value``, anything else what spark.read.json makes of it."""
    first = spark.read.text(uri).limit(1).collect()
    if first and first[0]["value"].lstrip().startswith("["):
        from pyspark.sql import functions as F

        listed = spark.read.text(uri, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
        scalar = listed.limit(1).collect()
        if scalar and not (scalar[0]["value"] or "").lstrip().startswith(("{", "[")):
            return listed
        return spark.read.option("multiLine", True).json(uri)
    return spark.read.json(uri)
