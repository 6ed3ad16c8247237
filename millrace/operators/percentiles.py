"""Exact percentiles per group of very large numeric columns, by bisection of value intervals.

Every percentile of a group has an interval of values that holds its rank. A pass counts, per group, the rows below all inner
points of the interval at once (``PARTS`` - 1 of them, that is ten halvings a pass) and keeps the part that holds the rank, with
the least and greatest value really in it as new ends, so each pass gains whatever the distribution. Passes count where the
rows are: the open intervals are sent to them (broadcast up to BROADCAST of them; more are joined with salt), and only counts of
groups and parts are shuffled, never values. A rank is resolved when the ends of its interval are at most ``tolerance`` apart,
by default equal: then the error is 0. Once FEW values are left in open intervals, each is counted by itself. What is left between the ends is the error bound that comes out with each value.

Counts, least and greatest values add up, so slices (partitions, days) combine: ``state`` gives the first pass of a slice on a
grid that doesn't depend on the data, ``merge`` adds states, ``bounds`` reads percentiles off a state with the stated bound, and
``percentiles`` goes on from there to the exact values. Each pass reads the slices again, so they should be tables or ``cut``.

Nulls and NaN aren't values and are left out; so are infinities, unless they are asked for. Null is a group of its own; a group without values has
no row. Ties and copies count as often as they occur. The percentile p of n values is the linear interpolation at rank p * (n - 1). Keys
come out as text; a grouping column that has the name of another column here comes out with the suffix _key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.session import cut

#: Parts into which a pass divides an open interval.
PARTS = 1024
#: Steps of the grid of the first pass to 1 on the scale |v| ** (1 / 16). A cell around v is 16 / (GRID * |v| ** (1/16)) of v wide.
GRID = 1024
#: Cells of the grid on either side of 0. Values beyond its end, about 5e33, share a cell, which later passes part like any other.
CELLS = 1 << 17
#: A pass at least parts the least from the greatest value of a cell; in practice 3 to 6 passes resolve doubles.
MOST_PASSES = 80
#: Open intervals that are broadcast at most (about 100 bytes each). Beyond, each is copied to SALT tasks, which share its rows.
BROADCAST, SALT = 200_000, 16
#: When no more values than this lie in open intervals, over all groups, the next pass counts every value by itself and so is the last.
FEW = 1_000_000

_TAKEN = {"grouping", "cell", "n", "lo", "hi", "n_values", "p", "end", "rank", "before", "size", "part", "least", "most", "value", "lower", "upper", "error_bound", "v", "from"}


def _cell(v: Column) -> Column:
    # Square roots are correctly rounded and so keep the order of values, over all magnitudes of doubles.
    place = F.floor(F.least(F.sqrt(F.sqrt(F.sqrt(F.sqrt(F.abs(v))))) * GRID, F.lit(float(CELLS)))).cast("long")
    place = F.when(F.abs(v) == float("inf"), F.lit(CELLS + 1)).otherwise(place)
    return F.when(v < 0, -place - 1).otherwise(place)


def _part(v: Column, lo: Column, hi: Column) -> Column:
    # Halves, as hi - lo may exceed the largest double.
    return F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * PARTS), F.lit(PARTS - 1)).cast("int")


def grouping_name(columns: list[str]) -> str:
    return "+".join(columns) if columns else "all"


def _columns(groupings: list[list[str]]) -> list[str]:
    return list(dict.fromkeys(c for g in groupings for c in g))


def _out(column: str) -> str:
    return f"{column}_key" if column in _TAKEN else column


def _group(groupings: list[list[str]]) -> list[str]:
    return ["grouping", *map(_out, _columns(groupings))]


def _values(df: DataFrame, groupings: list[list[str]], value: str, infinite: bool) -> DataFrame:
    """(key columns, v, cell) of each value."""
    v = F.col(f"`{value}`").cast("double")
    is_value = v.isNotNull() & ~F.isnan(v)
    if not infinite:
        is_value = is_value & (F.abs(v) < F.lit(float("inf")))
    once = df.where(is_value).select(*[F.col(f"`{c}`").cast("string").alias(_out(c)) for c in _columns(groupings)], (v + F.lit(0.0)).alias("v"))
    return once.withColumn("cell", _cell(F.col("v")))


def _each(df: DataFrame, groupings: list[list[str]]) -> DataFrame:
    """Every row once per grouping, without the keys that the grouping doesn't have."""
    names = _columns(groupings)
    rest = [c for c in df.columns if c not in map(_out, names)]
    keys = [F.struct(F.lit(grouping_name(g)).alias("grouping"), *[(F.col(_out(c)) if c in g else F.lit(None).cast("string")).alias(_out(c)) for c in names]) for g in groupings]
    return df.select(*rest, F.inline(F.array(*keys)))


def state(df: DataFrame, groupings: list[list[str]], value: str, infinite: bool = False) -> DataFrame:
    """The first pass over a slice: (grouping, keys..., cell, n, lo, hi). May be stored, and merged with those of other slices."""
    cells = _each(_values(df, groupings, value, infinite), groupings).groupBy(*_group(groupings), "cell")
    return cells.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def merge(*states: DataFrame) -> DataFrame:
    """The state of all slices together: counts add up, ends widen."""
    every = functools.reduce(DataFrame.unionByName, states)
    keys = [c for c in every.columns if c not in ("n", "lo", "hi")]
    return every.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _ranks(of: DataFrame, group: list[str], probs: list[float]) -> DataFrame:
    """The cells of a state that hold a wanted rank: adds n_values, p, end (0: rank below, 1: rank above) and rank in the cell."""
    whole = Window.partitionBy(*group)
    before = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = of.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("n_values", F.sum("n").over(whole))
    at = lambda p: F.lit(p) * (F.col("n_values") - 1)
    wanted = [F.struct(F.lit(p).alias("p"), F.lit(e).alias("end"), f(at(p)).cast("long").alias("rank")) for p in probs for e, f in ((0, F.floor), (1, F.ceil))]
    held = F.filter(F.array(*wanted), lambda x: (x["rank"] >= F.col("before")) & (x["rank"] < F.col("before") + F.col("n")))
    each = cells.select(*group, "cell", "lo", "hi", F.col("n").alias("size"), "n_values", "before", F.explode(held).alias("w"))
    return each.select(*group, "cell", "lo", "hi", "size", "n_values", "w.p", "w.end", (F.col("w.rank") - F.col("before")).alias("rank"))


def _interpolated(found: DataFrame, group: list[str]) -> DataFrame:
    both = found.groupBy(*group, "n_values", "p").agg(
        F.min(F.when(F.col("end") == 0, F.col("lo"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("lo"))).alias("b"),
        F.min(F.when(F.col("end") == 0, F.col("hi"))).alias("a_hi"), F.max(F.when(F.col("end") == 1, F.col("hi"))).alias("b_hi"),
    )
    rank = F.col("p") * (F.col("n_values") - 1)
    part = rank - F.floor(rank)
    mix = lambda a, b: F.when((F.col(a) == F.col(b)) | (part == 0), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * part)
    return both.select(*group, "n_values", "p", mix("a", "b").alias("lower"), mix("a_hi", "b_hi").alias("upper"))


def bounds(of: DataFrame, groupings: list[list[str]], probs: list[float]) -> DataFrame:
    """Percentiles read off a state alone: (grouping, keys..., n_values, p, lower, upper); the true value lies between both.

    Both ends are values in the cell, so upper - lower is at most the width of a cell: 16 / (GRID * |v| ** (1/16)) of v."""
    return _interpolated(_ranks(of, _group(groupings), probs), _group(groupings))


def _inside(rows: DataFrame, open_: DataFrame, n_open: int, group: list[str]) -> DataFrame:
    """(group, cell, from, hi, v) of the values that lie in an open interval. The intervals of a group are disjoint, so a value is in one at most."""
    sides = open_.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("cell").alias("__cell"), F.col("lo").alias("from"), "hi").distinct()
    # Only null keys need a comparison of their own; most groups aren't null, and a plain equality hashes.
    key = lambda c: F.col(c).eqNullSafe(F.col(f"__{c}"))
    near = functools.reduce(lambda a, b: a & b, [*map(key, group), F.col("cell") == F.col("__cell"), F.col("v") >= F.col("from"), F.col("v") <= F.col("hi")])
    if n_open <= BROADCAST:
        met = rows.join(F.broadcast(sides), near)
    else:
        rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)))
        met = rows.join(sides.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), near & (F.col("__salt") == F.col("__copy")))
    return met.select(*group, "cell", "from", "hi", "v")


def percentiles(slices: list[DataFrame], groupings: list[list[str]], value: str, probs: list[float], states: list[DataFrame] | None = None, tolerance: float = 0.0, infinite: bool = False) -> DataFrame:
    """Percentiles over all slices: (grouping, keys..., n_values, p, value, error_bound); the true one is at most error_bound away.

    states: states of the slices that were stored before; else they are made now. tolerance: width at which an interval is narrow enough.
    """
    bad = [p for p in probs if not 0 <= p <= 1]
    if bad:
        raise ValueError(f"percentiles lie between 0 and 1, not at {bad}")
    group = _group(groupings)
    first = merge(*(states or [state(s, groupings, value, infinite) for s in slices])) if len(slices) > 1 or states else state(slices[0], groupings, value, infinite)
    wide = (F.col("lo") < F.col("hi")) & (F.col("hi") / 2 - F.col("lo") / 2 > tolerance / 2)
    every = cut(_ranks(first, group, probs))
    found, wanted = [every.where(~wide)], every.where(wide)
    rows = _each(functools.reduce(DataFrame.unionByName, [_values(s, groupings, value, infinite) for s in slices]), groupings)
    for _ in range(MOST_PASSES):
        left = wanted.select(*group, "cell", "lo", "size").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("values")).first()
        n_open = left.n
        if not n_open:
            break
        part = (F.col("v") if left["values"] <= FEW else _part(F.col("v"), F.col("from"), F.col("hi"))).alias("part")
        parts = _inside(rows, wanted, n_open, group).groupBy(*group, "cell", "from", part)
        parts = parts.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy(*group, "cell", "from").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnsRenamed({c: f"__{c}" for c in [*group, "cell", "from"]})
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*group, "cell"]] + [F.col("lo") == F.col("__from"), F.col("rank") >= F.col("before"), F.col("rank") < F.col("before") + F.col("n")]
        held = wanted.drop("hi", "size").join(parts, functools.reduce(lambda a, b: a & b, same))
        held = cut(held.select(*group, "cell", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("n").alias("size"), "n_values", "p", "end", (F.col("rank") - F.col("before")).alias("rank")))
        found.append(held.where(~wide))
        wanted = held.where(wide)
    else:
        raise RuntimeError("some ranks weren't resolved")
    both = _interpolated(functools.reduce(DataFrame.unionByName, found), group)
    same = F.col("lower") == F.col("upper")
    middle = F.when(same, F.col("lower")).otherwise(F.col("lower") / 2 + F.col("upper") / 2)
    error = F.when(same, F.lit(0.0)).otherwise(F.col("upper") / 2 - F.col("lower") / 2)
    return both.select(*group, "n_values", "p", middle.alias("value"), error.alias("error_bound"))
