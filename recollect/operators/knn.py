"""Exact nearest neighbours by cosine score, per project and per query.

A query is named by project and ``query_id``. Few queries go to every task as matrices; more are
dealt into blocks and meet blocks of vectors through a shuffle, so that neither side passes through
the driver. Either way a task multiplies and keeps its best k rows of each query, and what is
shuffled after that is k rows per query and task, merged in lanes.

Where rows have a ``content_hash``, rows with equal texts count once: the best of them stands for
all, as de-duplication would keep no other. Copies so never crowd out other texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.batches import give_back
from recollect.functions.vectors import list_matrix

# How many rows are fetched first.
FETCH_BUDGETED = 400
FETCH_PER_RESULT = 6
FETCH_FLOOR = 12

#: Queries that go to every task: at 384 doubles each, 12 MiB at most. More meet the vectors in
#: blocks of so many queries and about so many vectors.
BROADCAST_QUERIES = 4096
QUERY_BLOCK, VECTOR_BLOCK = 2048, 20_000
#: Scores are compared at this many decimals, so that neither the batch
#: boundaries nor the summation order can change a ranking.
SCORE_DECIMALS = 9
#: Vectors multiplied at once.
_AT_ONCE = 1000

KEYS = ["project", "query_id"]
HITS = "query_id long, project string, fetch_k int, id long, text_key long, score double"
_NAMES = [c.split()[0] for c in HITS.split(", ")]


def fetch_count(limit: int, budgeted: bool) -> int:
    """How many rows to look at first, as dedup and packing throw some away. If that leaves a
    question unanswered, more are fetched."""
    return FETCH_BUDGETED if budgeted else min(FETCH_BUDGETED, max(FETCH_PER_RESULT * limit, FETCH_FLOOR))


@dataclass
class _Best:
    """The best rows of one query seen so far in one task, one for each text."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))

    def offer(self, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if len(self.ids) == self.k:
            fits = scores >= self.scores[-1]
            scores, ids, keys = scores[fits], ids[fits], keys[fits]
            if not len(ids):
                return
        scores, ids, keys = (np.concatenate(p) for p in ((self.scores, scores), (self.ids, ids), (self.keys, keys)))
        # Copies take places, so look at more than k until k texts are among them.
        look = self.k
        while True:
            chosen = np.arange(len(ids))
            if look < len(ids):
                chosen = np.flatnonzero(scores >= np.partition(scores, len(scores) - look)[len(scores) - look])
            order = chosen[np.lexsort((ids[chosen], -scores[chosen]))]
            _, first = np.unique(keys[order], return_index=True)
            if len(first) >= self.k or look >= len(ids):
                break
            look *= 4
        order = order[np.sort(first)[: self.k]]
        self.scores, self.ids, self.keys = scores[order], ids[order], keys[order]


def _multiply(best: list[_Best], matrix: np.ndarray, vectors: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
    if vectors.shape[1] != matrix.shape[1]:
        raise ValueError(f"embedding dimension mismatch: {vectors.shape[1]} vs {matrix.shape[1]}")
    for a in range(0, len(ids), _AT_ONCE):
        some = slice(a, a + _AT_ONCE)
        scores = np.round(vectors[some].astype(np.float64) @ matrix.T, SCORE_DECIMALS) + 0.0
        for keep, column in zip(best, scores.T):
            keep.offer(column, ids[some], keys[some])


def _hits(project: str, query_ids: np.ndarray, best: list[_Best]) -> pa.RecordBatch:
    sizes = [len(b.ids) for b in best]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(query_ids, sizes), type=pa.int64()),
            pa.array([project] * sum(sizes), type=pa.string()),
            pa.array(np.repeat([b.k for b in best], sizes), type=pa.int32()),
            pa.array(np.concatenate([b.ids for b in best] or [np.empty(0)]), type=pa.int64()),
            pa.array(np.concatenate([b.keys for b in best] or [np.empty(0)]), type=pa.int64()),
            pa.array(np.concatenate([b.scores for b in best] or [np.empty(0)]), type=pa.float64()),
        ],
        names=_NAMES,
    )


def _narrow(vectors: DataFrame) -> DataFrame:
    """Ids and vectors, and a key that rows of equal text share."""
    own = F.xxhash64(F.lit("id"), F.col("id"))
    key = own
    if "content_hash" in vectors.columns:
        key = F.when(F.coalesce("content_hash", F.lit("")) == "", own).otherwise(F.xxhash64("content_hash"))
    return vectors.select("project", "id", key.alias("text_key"), "embedding")


# -- few queries: one matrix for each project in every task -------------------------


def _matrices(rows: list) -> dict:
    groups: dict[str, list] = {}
    for row in rows:
        groups.setdefault(row.project, []).append(row)
    return {
        project: (
            np.array([r.query_id for r in group], dtype=np.int64),
            [int(r.fetch_k) for r in group],
            np.array([r.embedding for r in group], dtype=np.float64),
        )
        for project, group in groups.items()
    }


def search(vectors: DataFrame, asked: dict) -> DataFrame:
    """Each task's best rows for ``asked``: {project: (query ids, ks, query matrix)}."""
    shared = vectors.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, best = shared.value, {}
        for batch in batches:
            projects = batch.column("project")
            for project in pc.unique(projects).to_pylist():
                if project not in wanted:
                    continue
                rows = batch.filter(pc.equal(projects, project))
                _, ks, matrix = wanted[project]
                ids, keys = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_key"))
                _multiply(best.setdefault(project, [_Best(k) for k in ks]), matrix, list_matrix(rows.column("embedding")), ids, keys)
        for project, kept in best.items():
            yield _hits(project, wanted[project][0], kept)
        give_back()

    return _narrow(vectors.where(F.col("project").isin(sorted(asked)))).mapInArrow(run, HITS)


# -- many queries: blocks of queries and blocks of vectors -------------------------------


def _block_best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
    queries, vectors = queries.combine_chunks(), vectors.combine_chunks()
    best = [_Best(k) for k in queries["fetch_k"].to_pylist()]
    if queries.num_rows and vectors.num_rows:
        matrix = list_matrix(queries["query_vector"]).astype(np.float64)
        _multiply(best, matrix, list_matrix(vectors["embedding"]), vectors["id"].to_numpy(), vectors["text_key"].to_numpy())
    project = queries["asked_project"][0].as_py() if queries.num_rows else ""
    return pa.Table.from_batches([_hits(project, queries["query_id"].to_numpy(), best)])


def block_search(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """The best rows of each block of vectors for each block of queries of the same project.

    Blocks are dealt by hash; a project has as many as its rows fill, so that no group grows.
    """
    ceiling = lambda size: F.ceil(F.count("*") / size).cast("int")
    n_queries = asked.groupBy("project").agg(ceiling(QUERY_BLOCK).alias("query_blocks"))
    n_vectors = vectors.groupBy("project").agg(ceiling(VECTOR_BLOCK).alias("vector_blocks"))
    blocks = n_queries.join(n_vectors, "project")
    block = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    # Renamed: both sides may come from one table.
    left = asked.join(blocks, "project").select(
        F.col("project").alias("asked_project"), "query_id", "fetch_k", F.col("embedding").alias("query_vector"),
        block("query_id", "query_blocks").alias("asked_q"), every("vector_blocks").alias("asked_v"),
    )
    right = _narrow(vectors).join(blocks, "project").select(
        "project", "id", "text_key", "embedding", block("id", "vector_blocks").alias("v"), every("query_blocks").alias("q")
    )
    pairs = left.groupBy("asked_project", "asked_q", "asked_v").cogroup(right.groupBy("project", "q", "v"))
    return pairs.applyInArrow(_block_best, HITS)


# -- merging -------------------------------------------------------------------------


def _ranked(found: DataFrame, *keys: str) -> DataFrame:
    """One row for each text, the best ``fetch_k`` of each group; one exchange serves both windows."""
    best_first = [F.desc("score"), F.asc("id")]
    dealt = found.repartition(*keys)
    once = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "text_key").orderBy(*best_first)))
    once = once.where("rank = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))).where("rank <= fetch_k")


def _merged(found: DataFrame, tasks: int) -> DataFrame:
    """The best of what the tasks found, merged in lanes so that no task merges all."""
    lanes = math.isqrt(max(tasks, 1))
    if lanes > 1:
        laned = found.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
        found = _ranked(laned, *KEYS, "lane").drop("rank", "lane")
    return _ranked(found, *KEYS)


def top_k(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The ``fetch_k`` best rows of each query ``query_id, project, embedding, fetch_k``.

    ``vectors`` has ``project, id, embedding`` and perhaps ``content_hash``. Ties go to the lower
    id. Rows come with ``rank`` and ``candidates``, how many were found for the query. Queries of
    one project and id count once.
    """
    asked = queries.select(*KEYS, "embedding", F.col("fetch_k").cast("int").alias("fetch_k")).where("fetch_k > 0")
    asked = asked.dropDuplicates(KEYS)
    head = asked.limit(BROADCAST_QUERIES + 1).collect()  # a bounded number
    if len(head) <= BROADCAST_QUERIES:
        found = search(vectors, _matrices(head))
        kept = _merged(found, found.rdd.getNumPartitions())
    else:
        found = block_search(vectors, asked)
        kept = _merged(found, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept.withColumn("candidates", F.count("*").over(Window.partitionBy(*KEYS))).drop("fetch_k", "text_key")


def nearest(vectors: DataFrame, project: str, vector: np.ndarray, k: int) -> list[tuple[int, float]]:
    """``(id, score)`` of the k best rows for one query, best first."""
    found = search(vectors, {project: (np.array([0]), [k], np.asarray(vector, dtype=np.float64)[None, :])})
    best = _merged(found, found.rdd.getNumPartitions() // 64)
    return [(r.id, r.score) for r in best.orderBy("rank").select("id", "score").collect()]
