"""The queries p6 to p8 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.session import cut
from millrace.llm import mixing, packing, quality, tokens
from millrace.llm.oracle import SQL  # noqa: F401
from millrace.sources.tables import table


def _packs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    # A fixed table of a few rows.
    return sorted((r.pack_name, r.capacity_tokens) for r in table(spark, d, "pack_sizes").where("capacity_tokens > 0").distinct().collect())


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text, or piece of a text, for each capacity."""
    return packing.packing(table(spark, d, "documents"), "text", ["doc_id"], _packs(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, tokens in them, the share of their room that is filled, and the tokens of neighbours and of unrelated fillers."""
    of = lambda how: F.sum(F.when(F.col("placed") == how, F.col("tokens")).otherwise(0))
    placed = p6_packing(spark, d).where("container is not null").groupBy("pack_name", "capacity_tokens", "container").agg(F.sum("tokens").alias("t"), of(packing.NEIGHBOUR).alias("near"), of(packing.FILLER).alias("far"))
    whole = placed.groupBy("pack_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("most"), F.sum("near").alias("neighbour_tokens"), F.sum("far").alias("filler_tokens"))
    return whole.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: documents, and of these how many lost tokens, have some twice, or are split without need; and containers that are too full."""
    placed = cut(p6_packing(spark, d))
    sizes = tokens.token_counts(table(spark, d, "documents"), "text", ["doc_id"]).withColumnRenamed("tokens", "size")
    each = placed.groupBy("pack_name", "capacity_tokens", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("first_token").alias("begins"), F.sum("tokens").alias("placed"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    packs = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity_tokens")) for n, c in _packs(spark, d)]))
    both = sizes.select("*", packs.alias("x")).select("doc_id", "size", "x.*").join(each, ["pack_name", "capacity_tokens", "doc_id"], "full")
    bad = lambda c: F.count(F.when(F.coalesce(c, F.lit(True)), 1))
    of_docs = both.groupBy("pack_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("docs"), bad((F.col("placed") < F.col("size")) | (F.col("end") != F.col("size"))).alias("lost"), bad((F.col("placed") > F.col("size")) | (F.col("begins") < F.col("pieces"))).alias("doubled"),
        bad(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens")))).alias("needless_splits"),
    )
    full = placed.where("container is not null").groupBy("pack_name", "capacity_tokens", "container").agg(F.sum("tokens").alias("t")).groupBy("pack_name", "capacity_tokens").agg(F.count(F.when(F.col("t") > F.col("capacity_tokens"), 1)).alias("over_full"))
    return of_docs.join(full, ["pack_name", "capacity_tokens"], "left").na.fill(0, ["over_full"])


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized = mixing.sized_once(tokens.token_counts(table(spark, d, "documents"), "text", ["doc_id", "source"]))
    targets = table(spark, d, "mix_targets")
    return mixing.mix(sized, targets), sized, targets


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of each mix as they are reached."""
    return mixing.shares(*_mix(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target: documents chosen twice, used too often, of another source or size than in the table, and budgets missed by more than a document."""
    chosen, sized, targets = _mix(spark, d)
    chosen = cut(chosen)
    real = sized.select(F.col("doc_id"), F.col("source").alias("real_source"), F.col("tokens").alias("real_tokens"))
    most = targets.groupBy("mix_name", "source").agg(F.max("max_repeats").alias("max_repeats"))
    each = chosen.join(real, "doc_id", "left").join(most, ["mix_name", "source"], "left").groupBy("mix_name", "source").agg(
        (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("doubled"), F.count(F.when(F.col("uses") > F.coalesce("max_repeats", F.lit(0)), 1)).alias("over_repeated"),
        F.count(F.when(~F.col("source").eqNullSafe(F.col("real_source")) | ~F.col("tokens").eqNullSafe(F.col("real_tokens")), 1)).alias("wrong"), F.sum(F.col("uses") * F.col("tokens")).alias("used"),
    )
    totals = sized.where("source is not null and tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("tokens").alias("source_tokens"), F.max("tokens").alias("longest"))
    plan = mixing.budgets(totals.drop("longest"), targets).join(totals.select("source", "longest"), "source", "left")
    both = plan.join(each, ["mix_name", "source"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    missed = (F.abs(zero("used") - zero("budget")) > zero("longest")).cast("long")
    return both.select("mix_name", "source", zero("doubled").alias("doubled"), zero("over_repeated").alias("over_repeated"), zero("wrong").alias("wrong"), missed.alias("missed"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"), "text", ["doc_id"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are natural prose: of all that is said of them, those without the reason on running sentences."""
    return _quality(spark, d).where(~F.array_contains("reasons", "not_running_prose")).select("doc_id").distinct()


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    """All statistics of every document, and the published rules that it breaks."""
    got = _quality(spark, d)
    return got.select("doc_id", *[F.round(f, 6).alias(f) if not f.startswith("n_") else F.col(f) for f in quality.FIELDS], F.array_join("reasons", ",").alias("reasons"))


QUERIES = {"p6_packing": p6_packing, "p6_fill": p6_fill, "p6_checks": p6_checks, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_found": p8_found, "p8_quality": p8_quality}
