"""Mixing sources to target shares of all tokens.

Documents get a hash-random key. Within each source they are sorted by ranges of that key (a range is a slice of the hash, as many for a
source as it has rows for, so that no task holds more than about RANGE_ROWS of them, however large the source); prefix
sums of tokens are taken in each range and shifted by the sum of the ranges before. A source's budget is its share of the
total; it gets as many whole epochs as fit, and the documents up to the cut of its last epoch. The cut lies at the document boundary
nearest to the budget, so a source misses it by half a document at most.

Without a given total the mix is as large as it can be with no source beyond its greatest number of repeats. Shares of sources without
tokens can't be reached; the others then share the total in their proportion. Null sources match no target; documents without
tokens are never chosen; a source named twice in a mix has both shares; ties of the key are broken by the document's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.session import cut

#: Rows to a range of the random key.
RANGE_ROWS = 50_000
SEED = 17


def prefix_sums(sized: DataFrame, source: str, doc: str, tokens: str, seed: int = SEED, totals: DataFrame | None = None) -> DataFrame:
    """sized with ``before`` (tokens of the documents of the source that come before by the random key), ``source_tokens`` and ``source_docs``."""
    key = F.xxhash64(F.lit(seed), F.col(doc))
    totals = totals or sized.groupBy(source).agg(F.count(F.lit(1)).alias("source_docs"), F.sum(tokens).alias("source_tokens"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / RANGE_ROWS))
    # The top of the hash as a number from 0 to 1; a range holds a slice of it.
    place = (F.shiftrightunsigned(key, 11).cast("double")) / F.lit(float(1 << 53))
    keyed = sized.join(totals, source).withColumn("__key", key).withColumn("__range", F.floor(place * ranges).cast("int"))
    sums = keyed.groupBy(source, "__range").agg(F.sum(tokens).alias("__sum"))
    earlier = Window.partitionBy(source).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(source, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(source, "__range").orderBy(F.shiftrightunsigned("__key", 1), "__key", doc).rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn("__within", F.coalesce(F.sum(tokens).over(inside), F.lit(0)))
    return within.join(sums, [source, "__range"]).withColumn("before", F.col("__within") + F.col("__shift")).drop("__key", "__range", "__within", "__shift")


def budgets(totals: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, source_docs, source_tokens, budget) of each target.

    totals: (source, source_docs, source_tokens). Null shares and repeats count as 0.
    """
    wanted = targets.groupBy("mix_name", "source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    zero = F.lit(0).cast("long")
    known = wanted.join(totals, "source", "left").withColumn("source_docs", F.coalesce("source_docs", zero)).withColumn("source_tokens", F.coalesce("source_tokens", zero))
    usable = (F.col("source_tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    mix = Window.partitionBy("mix_name")
    share = F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(mix))
    known = known.withColumn("__share", share).withColumn("__cap", F.col("source_tokens") * F.col("max_repeats"))
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.min(F.col("__cap") / F.col("__share")).over(mix)
    # least() passes over nulls, so a target without a usable share is told apart first.
    budget = F.when(usable, F.least(F.floor(total * F.col("__share") + F.lit(1e-6)).cast("long"), F.col("__cap")))
    return known.withColumn("budget", F.coalesce(budget, zero)).drop("__share", "__cap")


def mix(sized: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", tokens: str = "tokens", total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """How often each chosen document is used: (mix_name, source, doc, tokens, uses).

    sized: one row per document with its size. targets: (mix_name, source, target_share, max_repeats), few rows.
    """
    sized = sized.select(F.col(source).alias("source"), F.col(doc).alias(doc), F.col(tokens).cast("long").alias("tokens")).where(f"source is not null and tokens > 0 and `{doc}` is not null")
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("tokens").alias("source_tokens"))
    # A row to a source, written down as it is needed twice.
    totals = cut(totals)
    summed = prefix_sums(sized, "source", doc, "tokens", seed, totals)
    plan = budgets(totals, targets, total_tokens).where("budget > 0").select("mix_name", "source", "max_repeats", "budget")
    chosen = summed.join(plan, "source")
    epochs = F.floor(F.col("budget") / F.col("source_tokens"))
    rest = F.col("budget") - epochs * F.col("source_tokens")
    # In the last epoch a document is taken if more than half of it lies before the cut.
    last = (F.col("before") + F.col("tokens") / 2 < rest) & (epochs < F.col("max_repeats"))
    uses = (epochs + F.when(last, 1).otherwise(0)).cast("int")
    return chosen.withColumn("uses", uses).where("uses > 0").select("mix_name", "source", doc, "tokens", "uses")


def shares(chosen: DataFrame, sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """What a mix really holds: (mix_name, source, target_share, max_repeats, available_tokens, docs, most_uses, tokens, share)."""
    totals = sized.where("source is not null and tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("tokens").alias("source_tokens"))
    used = chosen.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("docs"), F.max("uses").alias("most_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    every = budgets(totals, targets, total_tokens).join(used, ["mix_name", "source"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = F.sum(zero("used_tokens")).over(Window.partitionBy("mix_name"))
    share = F.when(whole > 0, zero("used_tokens") / whole).otherwise(F.lit(0.0))
    return every.select("mix_name", "source", "target_share", "max_repeats", F.col("source_tokens").alias("available_tokens"), zero("docs").alias("docs"), zero("most_uses").alias("most_uses"), zero("used_tokens").alias("tokens"), F.round(share, 6).alias("share"))


def sized_once(sized: DataFrame) -> DataFrame:
    """Sizes written down, as they are read several times and dear to make."""
    return cut(sized)
