"""Keyed joins of two or more inputs, with a policy for keys that some input never delivers.

In a batch every input is complete, so a key "times out" if an input lacks it. Rows per key multiply as in SQL; null keys match
nothing and count as incomplete. Columns of equal names, other than the key, get the suffix of their input's name.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.filter import column
from millrace.plans.spec import JoinConfig

_ENDS = {"min": F.min, "max": F.max}


@dataclass
class Joined:
    """rows: the output. dead_letter: (key, input, payload) of the rows whose key isn't complete; None unless that is the policy."""

    rows: DataFrame
    dead_letter: DataFrame | None = None


def _distinct_names(inputs: dict[str, DataFrame], key: str) -> list[DataFrame]:
    taken: set[str] = set()
    out = []
    for name, df in inputs.items():
        column(df, key)
        clash = {c: f"{c}_{name}" for c in df.columns if c != key and c in taken}
        df = df.withColumnsRenamed(clash)
        taken |= set(df.columns)
        out.append(df)
    return out


def join(inputs: dict[str, DataFrame], config: JoinConfig) -> Joined:
    """Joins inputs, in their order, on the column of the same name."""
    rows = _folded(_distinct_names(inputs, config.key), config)
    return Joined(rows, dead_letter(inputs, config) if config.on_timeout == "dead_letter" else None)


def _folded(frames: list[DataFrame], config: JoinConfig) -> DataFrame:
    how = "left" if config.join == "left" else "full" if config.on_timeout == "emit_null" else "inner"
    return functools.reduce(lambda a, b: a.join(b, config.key, how), frames)


def grouped(inputs: dict[str, DataFrame], config: JoinConfig, group_by: Sequence[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows of ``join``, grouped: group_by, then measures, which are name -> (count, min or max; column). Columns are named as ``join`` names them.

    The joined rows are never made, as rows per key multiply. Each input is grouped by the key and those of its columns that stand in
    group_by; the counts of these groups multiply to the number of joined rows, and the least and greatest values are those of the joined rows.
    """
    frames = _distinct_names(inputs, config.key)
    known = {c for df in frames for c in df.columns}
    if missing := [c for c in [*group_by, *(c for func, c in measures.values() if func != "count")] if c not in known]:
        raise ValueError(f"no such column: {missing[0]}")
    if wrong := [func for func, _ in measures.values() if func not in ("count", *_ENDS)]:
        raise ValueError(f"unsupported func over joined rows: {wrong[0]}")
    folded = []
    for i, df in enumerate(frames):
        own = [c for c in df.columns if c != config.key]
        keys = [F.col(f"`{c}`") for c in [config.key, *(c for c in own if c in group_by)]]
        ends = [_ENDS[func](f"`{c}`").alias(f"__end_{name}") for name, (func, c) in measures.items() if func != "count" and c in own]
        folded.append(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__rows_{i}"), *ends))
    # An input that lacks a key takes part in its rows once, as nulls.
    n = functools.reduce(lambda a, b: a * b, [F.coalesce(f"__rows_{i}", F.lit(1)) for i in range(len(frames))])

    def measure(name: str, func: str, c: str) -> Column:
        return F.coalesce(F.sum(n), F.lit(0)) if func == "count" else _ENDS[func](f"`{c}`" if c == config.key else f"`__end_{name}`")

    return _folded(folded, config).groupBy(*[F.col(f"`{c}`") for c in group_by]).agg(*[measure(name, func, c).alias(name) for name, (func, c) in measures.items()])


def presence(inputs: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, n_sources, sources) of every key that isn't null: which inputs have it."""
    keys = [df.select(column(df, key).alias(key)).where(F.col(f"`{key}`").isNotNull()).distinct().withColumn("__source", F.lit(name)) for name, df in inputs.items()]
    every = functools.reduce(DataFrame.unionByName, keys)
    return every.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_sources"), F.array_sort(F.collect_list("__source")).alias("sources"))


def dead_letter(inputs: dict[str, DataFrame], config: JoinConfig) -> DataFrame:
    """The rows of keys that not all inputs have: (key as text, source, sources there, payload as JSON). For a left join only
    keys that the first input has; what else is there was never waited for. Rows without a key are dead letters of their own source
    (for a left join those of the first), and go there without a shuffle, however many there are."""
    there = presence(inputs, config.key).where(F.col("n_sources") < len(inputs))
    first = next(iter(inputs))
    if config.join == "left":
        there = there.where(F.array_contains("sources", first))
    out = []
    for name, df in inputs.items():
        # Keys are told apart from columns of the payload.
        row = df.select(F.col(f"`{config.key}`").alias("__k"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("payload"))
        hit = row.join(there, row["__k"] == there[config.key])
        out.append(hit.select(F.col("__k").cast("string").alias("key"), F.lit(name).alias("source"), "sources", "payload"))
        if config.join != "left" or name == first:
            out.append(row.where("__k is null").select(F.col("__k").cast("string").alias("key"), F.lit(name).alias("source"), F.array(F.lit(name)).alias("sources"), "payload"))
    return functools.reduce(DataFrame.unionByName, out)
