"""Runs queries and compares them with their SQL: python tests/compare.py FOLDER NAME..."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def views(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x if x is None or isinstance(x, (bool, int, str)) else plain(float(x))


def same(df, sql: str, folder: str) -> tuple[bool, str]:
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = views(folder).execute(sql)
    cols = [x[0] for x in rel.description]
    want = Counter(tuple(plain(r[cols.index(n)]) for n in names) for r in rel.fetchall()) if sorted(cols) == names else None
    if want is None:
        return False, f"columns {names} and {sorted(cols)}"
    return got == want, f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"


def main(folder: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.sql.autoBroadcastJoinThreshold": "256k"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql = e.oracle_sql()
    for name, q in e.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            df = q(spark, folder)
            ok, why = same(df, sql[name], folder) if name in sql else (True, f"rows {df.count()}")
        except Exception as x:  # noqa: BLE001
            ok, why = False, f"{type(x).__name__}: {str(x)[:1500]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - t:.1f} s", "" if ok and name in sql else why, flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
