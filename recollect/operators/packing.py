"""Ranking survivors and cutting them by count or by token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.numbering import running_totals

KEYS = ["project", "query_id"]


def _chosen() -> Column:
    budgeted = F.coalesce(F.col("max_tokens"), F.lit(0)) > 0
    return F.when(budgeted, F.col("running_tokens") <= F.col("max_tokens")).otherwise(F.col("rank") <= F.col("limit"))


def pack(survivors: DataFrame) -> DataFrame:
    """Mark which survivors of each query are returned.

    Needs ``project, query_id, id, score, cost, limit, max_tokens``. With a budget the
    longest best-first prefix whose running cost stays within it is chosen: every
    cost is positive, so the running sum only grows and a plain comparison stops
    at the first row that does not fit. Without one, ``limit`` rows are chosen.
    For lists of a query's survivors, which its budget bounds; longer ones: ``pack_long``.
    """
    ordered = Window.partitionBy(*KEYS).orderBy(F.desc("score"), F.asc("id"))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        survivors.withColumn("rank", F.row_number().over(ordered))
        .withColumn("running_tokens", F.sum("cost").over(running))
        .withColumn("survivors", F.count("*").over(Window.partitionBy(*KEYS)))
        .withColumn("chosen", _chosen())
    )


def pack_long(rows: DataFrame) -> DataFrame:
    """As ``pack``, where one query may have most of the rows: these are spread over the tasks.

    All rows stand in one order, best first within each query; a query's own sums are what the
    running sums exceed those before its first row by.
    """
    order = [F.col("project"), F.col("query_id"), F.desc("score"), F.asc("id")]
    summed = running_totals(rows.withColumn("_one", F.lit(1)), order, {"_cost_to": "cost", "_rank_to": "_one"})
    base = summed.groupBy(F.col("project").alias("_p"), F.col("query_id").alias("_q")).agg(
        F.min(F.col("_cost_to") - F.col("cost")).alias("_cost_from"),
        F.min(F.col("_rank_to") - 1).alias("_rank_from"),
        F.count("*").alias("survivors"),
    )
    same = F.col("project").eqNullSafe(F.col("_p")) & F.col("query_id").eqNullSafe(F.col("_q"))
    joined = summed.join(base, same)
    return (
        joined.withColumn("rank", (F.col("_rank_to") - F.col("_rank_from")).cast("int"))
        .withColumn("running_tokens", F.col("_cost_to") - F.col("_cost_from"))
        .withColumn("chosen", _chosen())
        .drop("_one", "_p", "_q", "_cost_to", "_cost_from", "_rank_to", "_rank_from")
    )


def recall_stats(packed: DataFrame, asked: DataFrame) -> DataFrame:
    """One row for each query of ``asked`` (``project, query_id, candidates``): how many rows were
    looked at, survived and were returned, their tokens, and how many the budget cut."""
    chosen = F.col("chosen")
    counted = packed.groupBy(*KEYS).agg(
        F.max("survivors").alias("survivors"),
        F.count_if(chosen).alias("returned"),
        F.sum(F.when(chosen, F.col("cost"))).alias("tokens_used"),
        F.count_if(~chosen & (F.coalesce(F.col("max_tokens"), F.lit(0)) > 0)).alias("truncated"),
    )
    joined = asked.select(*KEYS, "candidates").join(counted, KEYS, "left")
    return joined.select(*KEYS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "survivors", "returned", "tokens_used", "truncated")])
