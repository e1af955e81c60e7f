"""Greedy de-duplication without a group for each query: rounds over tables of conflicts.

A greedy pass keeps a row unless a better one that is kept conflicts with it. Which rows that keeps
is the lexicographically first independent set of the conflicts, and it can be found in rounds: a row
with no better undecided row in conflict is kept, and what conflicts with it is dropped. Each round
settles at least the best undecided row of every list, and mostly a large share of all.

Rows of equal texts, of equal gram sets or of equal places are cliques: the best undecided row of a
clique stands for it, so copies make no pairs. Only different gram sets and different places are
joined in pairs. A row of any list may be in any task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import shingle_hashes
from recollect.operators.dedup import SIMILARITY
from recollect.operators.overlap import overlap_pairs
from recollect.operators.similarity import distinct_sets, similar_pairs
from recollect.session import Scratch

_LIST = ["project", "query_id"]


def first_independent(rows: DataFrame, conflicts: list[tuple[str, DataFrame | None]], scratch: Scratch) -> DataFrame:
    """The ``row`` numbers that a greedy pass over ``row, rank`` keeps, smaller ranks first.

    Each conflict is a column of ``rows`` that names a clique (null: none), and perhaps a kept table
    ``a, b`` of cliques of that column that conflict with one another. Ranks must differ.
    """
    both = [None if e is None else e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) for _, e in conflicts]
    undecided, kept = scratch.keep(rows), []
    while not undecided.isEmpty():
        judged, free = undecided, F.lit(True)
        for k, ((column, _), edges) in enumerate(zip(conflicts, both)):
            best = undecided.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("of")).agg(F.min("rank").alias("best"))
            if edges is not None:
                near = best.join(edges, F.col("of") == F.col("b")).select(F.col("a").alias("of"), "best")
                best = best.unionAll(near).groupBy("of").agg(F.min("best").alias("best"))
            named = best.select(F.col("of").alias(f"of{k}"), F.col("best").alias(f"best{k}"))
            judged = judged.join(named, F.col(column) == F.col(f"of{k}"), "left")
            free = free & (F.col(column).isNull() | (F.col(f"best{k}") >= F.col("rank")))
        chosen = scratch.keep(judged.where(free).select(rows.columns))
        kept.append(chosen.select("row"))
        rest = undecided.join(chosen.select("row"), "row", "left_anti")
        for (column, _), edges in zip(conflicts, both):
            gone = chosen.where(F.col(column).isNotNull()).select(F.col(column).alias("gone")).distinct()
            if edges is not None:
                gone = gone.unionAll(gone.join(edges, F.col("gone") == F.col("b")).select("a")).distinct()
            rest = rest.join(gone, F.col(column) == F.col("gone"), "left_anti")
        undecided = scratch.keep(rest.select(rows.columns))
    empty = rows.select("row").where("false")
    return reduce(DataFrame.unionAll, kept, empty)


def _place(path: Column, start: Column, end: Column) -> Column:
    return F.when(path.isNotNull() & start.isNotNull() & end.isNotNull(), F.struct(*_LIST, path.alias("file_path"), start.alias("line_start"), end.alias("line_end")))


def greedy_dedup_spread(candidates: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """As ``dedup.greedy_dedup``, for lists of any length: no task needs a whole list.

    Rows of equal list, score and id count as one after the other in some order.
    """
    if "grams" not in candidates.columns:
        candidates = candidates.withColumn("grams", shingle_hashes(F.col("text")))
    numbered = scratch.keep(candidates.withColumn("_row", F.monotonically_increasing_id()))
    sets, member = distinct_sets(numbered.select("_row", *_LIST, "grams"), scratch, *_LIST)
    alike = similar_pairs(sets, scratch, similarity)
    place = _place(F.col("file_path"), F.col("line_start"), F.col("line_end"))
    places = scratch.keep(
        numbered.select(place.alias("p")).where("p IS NOT NULL").distinct().select(F.monotonically_increasing_id().alias("place"), "p.*")
    )
    met = scratch.keep(overlap_pairs(places, "place", [*_LIST, "file_path"]))
    at = places.select("place", F.struct(*_LIST, "file_path", "line_start", "line_end").alias("p"))
    text = F.when(F.coalesce("content_hash", F.lit("")) != "", F.struct(*_LIST, "content_hash"))
    rows = (
        numbered.select(F.col("_row").alias("row"), F.struct(-F.col("score"), "id", "_row").alias("rank"), text.alias("text"), place.alias("at"))
        .join(member.select(F.col("_row").alias("row"), "node"), "row")
        .join(at, F.col("at") == F.col("p"), "left")
        .select("row", "rank", "text", "node", "place")
    )
    kept = scratch.keep(first_independent(rows, [("text", None), ("node", alike), ("place", met)], scratch))
    found = numbered.join(kept, F.col("_row") == F.col("row"), "left_semi")
    return found.drop("_row", "grams")
