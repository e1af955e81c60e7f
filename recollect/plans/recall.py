"""The recall pipeline: embed, search one project, filter, de-duplicate, pack.

Rows are fetched in rounds: first a number that nearly always suffices, then eight times as many
for the queries whose limit or budget the survivors do not fill, until it is filled or the project
has no more rows above the score. Greedy de-duplication decides best first, so what a round finds
is the beginning of what all rows would give. Lists that reach LONG_LIST rows are no longer one
group: rounds over tables of conflicts de-duplicate them, and they are packed in one global order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.embedding import Embedder, embed
from recollect.functions.text import hit_cost, shingle_hashes
from recollect.operators.dedup import SIMILARITY, greedy_dedup
from recollect.operators.independent import greedy_dedup_spread
from recollect.operators.knn import FETCH_BUDGETED, FETCH_FLOOR, FETCH_PER_RESULT, KEYS, top_k
from recollect.operators.packing import pack, pack_long
from recollect.session import Scratch

DEFAULT_LIMIT = 5
#: Rows found that are broadcast to the lookup of texts, up to this count (about 64 MiB).
BROADCAST_HITS = 1_000_000
#: Each round fetches so many times the rows of the one before.
GROWTH = 8
#: Rows fetched for a query from which its list is spread over tasks.
LONG_LIST = FETCH_BUDGETED * GROWTH * GROWTH

ROW_COLUMNS = ["kind", "text", "tags", "file_path", "line_start", "line_end", "content_hash"]


def plan_queries(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Fill in defaults and the fetch size; embed ``query`` unless vectors are given.

    Optional columns: ``limit, max_tokens, min_score``.
    """

    def optional(name: str, kind: str):
        return F.col(name).cast(kind) if name in queries.columns else F.lit(None).cast(kind)

    vector = F.col("embedding") if "embedding" in queries.columns else embed(F.col("query"), embedder)
    planned = queries.select(
        F.col("query_id").cast("long").alias("query_id"),
        "project",
        vector.alias("embedding"),
        F.coalesce(optional("limit", "int"), F.lit(DEFAULT_LIMIT)).alias("limit"),
        optional("max_tokens", "long").alias("max_tokens"),
        optional("min_score", "double").alias("min_score"),
    )
    budgeted = F.coalesce(F.col("max_tokens"), F.lit(0)) > 0
    sized = F.least(F.lit(FETCH_BUDGETED), F.greatest(F.col("limit") * FETCH_PER_RESULT, F.lit(FETCH_FLOOR)))
    return planned.withColumn("fetch_k", F.when(budgeted, FETCH_BUDGETED).otherwise(sized)).dropDuplicates(KEYS)


def weigh(rows: DataFrame) -> DataFrame:
    """``rows`` with what dedup and packing need to know of each text."""
    cost = hit_cost(*(F.col(c) for c in ["id", "kind", "file_path", "line_start", "line_end", "text"]))
    return rows.withColumns({"cost": cost, "grams": shingle_hashes(F.col("text"))})


def found_for(memories: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows nearest to each query, narrow, with the query's parameters."""
    vectors = memories.select("project", "id", "embedding", "content_hash")
    return top_k(vectors, planned).join(planned.drop("embedding"), KEYS)


def weighed(memories: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` rows above their query's score, with their texts' costs and shingles.

    Texts are looked up for the hits alone, and a text found by many queries is weighed once.
    ``passed`` counts the rows of each query.
    """
    above = F.col("min_score").isNull() | (F.col("score") >= F.col("min_score"))
    found = found.where(above).withColumn("passed", F.count("*").over(Window.partitionBy(*KEYS)))
    found = found.drop("min_score", "rank")
    rows = memories.select("project", "id", *ROW_COLUMNS)
    ids = found.select("project", "id").distinct()
    if found.count() > BROADCAST_HITS:
        return weigh(rows.join(ids, ["project", "id"], "left_semi")).join(found, ["project", "id"])
    mine = F.struct(*[c for c in found.columns if c not in ("project", "id")])
    by_row = found.groupBy("project", "id").agg(F.collect_list(mine).alias("found_by"))
    # Only hits are shuffled: by row, to spread the weighing.
    hits = rows.join(F.broadcast(by_row), ["project", "id"]).repartition("project", "id")
    return weigh(hits).select("*", F.inline("found_by")).drop("found_by")


def candidates(memories: DataFrame, planned: DataFrame) -> DataFrame:
    """Scored, weighed rows of one round's queries after the score filter; ``candidates`` counts
    them before it."""
    return weighed(memories, Scratch(memories.sparkSession).keep(found_for(memories, planned)))


def survivors(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``candidates`` without the redundant ones, ranked and packed."""
    return pack(greedy_dedup(rows, similarity))


def long_survivors(rows: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """As ``survivors``, for lists of any length."""
    return pack_long(greedy_dedup_spread(rows, scratch, similarity))


@dataclass
class Recalled:
    """All survivors of all queries, ranked, the answer being ``where(chosen)``; and every query
    with the number of rows looked at."""

    hits: DataFrame
    queries: DataFrame


def recall_all(memories: DataFrame, queries: DataFrame, embedder: Embedder | None = None) -> Recalled:
    scratch = Scratch(memories.sparkSession)
    asked = planned = scratch.keep(plan_queries(queries, embedder))
    hits, looked, most = [], [], FETCH_BUDGETED
    while True:
        found = scratch.keep(found_for(memories, planned))
        rows = weighed(memories, found)
        packed = scratch.keep(survivors(rows) if most < LONG_LIST else long_survivors(rows, scratch))
        looked.append(found.groupBy(*KEYS).agg(F.max("candidates").alias("candidates")))
        # More could help where all rows fetched were good and some are still wanted.
        state = packed.groupBy(*KEYS).agg(
            (F.max("candidates") >= F.max("fetch_k")).alias("more"),
            (F.max("passed") == F.max("candidates")).alias("good"),
            F.bool_and("chosen").alias("all_chosen"),
            F.max("survivors").alias("n"),
        )
        budgeted = F.coalesce(F.col("max_tokens"), F.lit(0)) > 0
        unfilled = F.when(budgeted, F.col("all_chosen")).otherwise(F.col("n") < F.col("limit"))
        again = planned.join(state.where("more AND good"), KEYS).where(unfilled).select(planned.columns)
        again = scratch.keep(again.withColumn("fetch_k", F.col("fetch_k") * GROWTH))
        hits.append(packed.join(again.select(*KEYS), KEYS, "left_anti"))
        if again.isEmpty():
            break
        planned, most = again, most * GROWTH
    counted = reduce(DataFrame.unionAll, looked).groupBy(*KEYS).agg(F.max("candidates").alias("candidates"))
    every = asked.select(*KEYS).join(counted, KEYS, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return Recalled(reduce(DataFrame.unionByName, hits), every)


def recall(memories: DataFrame, queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """All survivors of all queries, ranked; the answer is ``where(chosen)``."""
    return recall_all(memories, queries, embedder).hits
