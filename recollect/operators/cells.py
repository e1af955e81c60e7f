"""Exact nearest neighbours that leave out what cannot be near.

Vectors are laid out in cells around centres, each cell a folder. A cell has a radius, the largest
angle between its centre and a vector of it. By the triangle inequality for angles no vector of a
cell can have a better score than ``cos(angle(query, centre) - radius)``; cells whose bound is below
the least score asked for, or below the k-th score found so far, are neither read nor compared.

Centres come from a bounded sample; that only steers how much can be left out. Every vector is in a
cell and every bound holds, so answers are those of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.vectors import list_matrix
from recollect.operators.knn import KEYS, block_search
from recollect.session import Scratch

#: Cells at most, and vectors of the sample for each.
MAX_CELLS, SAMPLED = 1024, 16
_ITERATIONS, _SEED = 6, 7
#: What rounding may move an angle or a bound.
_SLACK = 1e-6


@dataclass
class CellIndex:
    """``vectors``: ``project, id, embedding, cell`` in folders by cell; ``cells``: ``project, cell,
    radius, longest, n``; ``centres``: a direction for each cell, MAX_CELLS at most."""

    vectors: DataFrame
    cells: DataFrame
    centres: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def fit_centres(vectors: DataFrame, cells: int | None = None) -> np.ndarray:
    """Directions around which vectors gather, by k-means over a sample of SAMPLED for each cell."""
    n = vectors.count()
    cells = max(1, min(MAX_CELLS, cells or math.isqrt(n)))
    # The first by a hash of the id: a sample that reruns repeat.
    drawn = vectors.where(F.size("embedding") > 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLED * cells).select("embedding")
    taken = [r.embedding for r in drawn.collect()]
    if not taken:
        return np.zeros((0, 0))
    sample = _unit(np.array(taken, dtype=np.float64))
    centres = sample[np.random.default_rng(_SEED).permutation(len(sample))[:cells]]
    for _ in range(_ITERATIONS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        moved = _unit(sums)
        centres = np.where((moved != 0).any(axis=1)[:, None], moved, centres)
    return centres


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The angle of each row to each centre; a right angle where either has no direction."""
    if not len(centres):
        return np.zeros((len(rows), 0))
    return np.arccos(np.clip(_unit(rows) @ centres.T, -1, 1))


def build(vectors: DataFrame, scratch: Scratch, cells: int | None = None) -> CellIndex:
    """Deal ``project, id, embedding`` rows into cells, each row to the centre at the smallest angle."""
    centres = fit_centres(vectors, cells)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list_matrix(batch.column("embedding")).astype(np.float64)
            angles = _angles(rows, shared.value)
            cell = angles.argmin(axis=1)
            more = {"angle": angles[np.arange(len(cell)), cell], "length": np.linalg.norm(rows, axis=1), "cell": cell.astype(np.int32)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], [*batch.schema.names, *more])

    narrow = vectors.select("project", "id", "embedding").where(F.size("embedding") > 0)
    placed = narrow.mapInArrow(place, "project string, id long, embedding array<float>, angle double, length double, cell int")
    kept = scratch.keep_by(placed, "cell")
    cells_of = kept.groupBy("project", "cell").agg(
        F.max("angle").alias("radius"), F.max("length").alias("longest"), F.count("*").alias("n")
    )
    return CellIndex(kept.drop("angle", "length"), scratch.keep(cells_of), centres)


def bounds(index: CellIndex, queries: DataFrame) -> DataFrame:
    """``project, query_id, cell, n, bound`` for each query and cell of its project: no vector of the
    cell has a higher score."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list_matrix(batch.column("embedding")).astype(np.float64)
            angles = pa.array(_angles(rows, shared.value).tolist(), pa.list_(pa.float64()))
            columns = [batch.column("project"), batch.column("query_id"), pa.array(np.linalg.norm(rows, axis=1)), angles]
            yield pa.RecordBatch.from_arrays(columns, ["project", "query_id", "size", "angles"])

    asked = queries.select("project", "query_id", "embedding").mapInArrow(
        measure, "project string, query_id long, size double, angles array<double>"
    )
    apart = F.greatest(F.get("angles", F.col("cell")) - F.col("radius") - _SLACK, F.lit(0.0))
    best = F.greatest(F.cos(apart), F.lit(0.0)) * F.col("size") * F.col("longest") + _SLACK
    return asked.join(index.cells, "project").select("project", "query_id", "cell", "n", best.alias("bound"))


def _probe(index: CellIndex, queries: DataFrame, probes: DataFrame) -> DataFrame:
    """The best rows of the probed cells for each query; other cells' folders are not opened."""
    wanted = sorted(r.cell for r in probes.select("cell").distinct().collect())  # MAX_CELLS at most
    inside = lambda df: df.withColumn("project", F.concat_ws(":", F.col("cell").cast("string"), "project"))
    asked = inside(queries.join(probes.select(*KEYS, "cell"), KEYS)).select("project", "query_id", "embedding", "fetch_k")
    found = block_search(inside(index.vectors.where(F.col("cell").isin(wanted))).drop("cell"), asked)
    return found.select(F.expr("substring(project, instr(project, ':') + 1)").alias("project"), "query_id", "id", "score")


def _best(found: DataFrame, queries: DataFrame) -> DataFrame:
    ranked = Window.partitionBy(*KEYS).orderBy(F.desc("score"), F.asc("id"))
    joined = found.join(queries.select(*KEYS, "fetch_k", "min_score"), KEYS).where("min_score IS NULL OR score >= min_score")
    return joined.withColumn("rank", F.row_number().over(ranked)).where("rank <= fetch_k")


@dataclass
class Found:
    """``hits``: ``project, query_id, rank, id, score``; ``work``: ``project, query_id, compared``, how
    many vectors stood in the cells that were read for each query."""

    hits: DataFrame
    work: DataFrame


def search(index: CellIndex, queries: DataFrame, scratch: Scratch) -> Found:
    """The ``fetch_k`` best rows of each query ``query_id, project, embedding, fetch_k, min_score``
    (null: any score), as a full scan gives them. Ties go to the lower id.

    The cells with the best bounds that hold enough rows are read first. What they give is a score
    that the other cells must be able to reach.
    """
    asked = scratch.keep(queries.select(*KEYS, "embedding", "fetch_k", "min_score").where("fetch_k > 0").dropDuplicates(KEYS))
    reach = asked.select(*KEYS, "fetch_k", "min_score")
    open_cells = scratch.keep(
        bounds(index, asked).join(reach, KEYS).where("min_score IS NULL OR bound >= min_score").drop("min_score")
    )
    by_bound = Window.partitionBy(*KEYS).orderBy(F.desc("bound"), F.asc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    ordered = scratch.keep(open_cells.withColumn("before", F.coalesce(F.sum("n").over(by_bound), F.lit(0))))
    first = ordered.where("before < fetch_k")
    found = scratch.keep(_best(_probe(index, asked, first), asked))
    enough = found.where("rank = fetch_k").select(*KEYS, F.col("score").alias("least"))
    second = scratch.keep(
        ordered.where("before >= fetch_k").join(enough, KEYS, "left").where("least IS NULL OR bound >= least").drop("least")
    )
    more = _probe(index, asked, second)
    hits = _best(found.select(*KEYS, "id", "score").unionByName(more.select(*KEYS, "id", "score")), asked)
    work = first.unionByName(second).groupBy(*KEYS).agg(F.sum("n").alias("compared"))
    every = asked.select(*KEYS).join(work, KEYS, "left")
    return Found(hits.select(*KEYS, "rank", "id", "score"), every.withColumn("compared", F.coalesce("compared", F.lit(0))))
