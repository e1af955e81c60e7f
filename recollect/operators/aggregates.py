"""Counts, duplicates, fingerprints and percentiles over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.numbering import running_total

#: Ids digested together; also how many digests the next level takes in.
DIGEST_BLOCK = 4096


def project_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project").agg(F.count("*").alias("count")).orderBy("project")


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Content hashes held by several rows: how many, and the first id."""
    present = rows.where(F.coalesce("content_hash", F.lit("")) != "")
    groups = present.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    return groups.where(F.col("copies") > 1)


def id_digest(rows: DataFrame) -> DataFrame:
    """One fingerprint per project of its set of ids.

    A tree of three levels, whatever the ids: digests of blocks of neighbouring ids, of blocks of
    blocks, and of these. A project's fingerprint depends on its own ids alone.
    """
    level = rows.select("project", F.col("id").alias("at"), F.col("id").cast("string").alias("item"))
    for block in (F.floor(F.col("at") / DIGEST_BLOCK), F.floor(F.col("at") / DIGEST_BLOCK), F.lit(0)):
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda s: s["item"])
        level = level.groupBy("project", block.alias("block")).agg(F.sha2(F.array_join(ordered, ","), 256).alias("item"))
        level = level.withColumnRenamed("block", "at")
    return level.select("project", F.substring("item", 1, 16).alias("digest"))


def nearest_rank(rows: DataFrame, key: str, value: str, percents: list[int]) -> DataFrame:
    """``key, percent, value``: the value at rank ``ceil(percent / 100 * n)`` of each key.

    Equal values are counted first. The counts are summed up along one global order of keys and
    values, so that neither a key with most of the rows nor a value does gather in one task.
    """
    counts = rows.select(key, value).where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    summed = running_total(counts, [F.col(key), F.col(value)], "_n", "_to")
    groups = summed.groupBy(F.col(key).alias("_key")).agg(F.min(F.col("_to") - F.col("_n")).alias("_from"), F.sum("_n").alias("_all"))
    wanted = groups.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    rank = F.greatest(F.ceil(F.col("percent") * F.col("_all") / 100), F.lit(1))
    at = F.col("_from") + rank
    inside = (F.col("_to") - F.col("_n") < at) & (at <= F.col("_to"))
    joined = summed.join(wanted, F.col(key).eqNullSafe(F.col("_key")))
    return joined.where(inside).select(key, "percent", value)
