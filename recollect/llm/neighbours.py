"""Near-duplicate vectors by p-stable hashing and exact cosine checks.

For unit vectors a cosine is a distance: cosine c lies at sqrt(2 - 2c). A table hashes a vector by
the cells into which a few random projections fall, each projection being divided into cells of one
width; the smaller the distance, the likelier all cells agree. Vectors that share the bucket of any
table are compared by their exact cosine.

Width, projections and tables come from the number of vectors by a cost model under one condition
that holds at every size: a pair whose cosine is just the threshold meets in some table with
probability RECALL; closer pairs meet more surely. More vectors so get finer buckets and more tables.

Equal vectors are one row from the start. A bucket of any size is dealt into blocks, and the pairs
of blocks are compared by different tasks, as matrices; no pair leaves a task. What leaves it is how
many links each vector has there, and a link from each vector to the first of those it is connected
with. A pair counts in the first table in which it meets, which both vectors' keys tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.base import Scratch
from recollect.llm.components import components
from recollect.llm.vectors import matrix, sound
from recollect.llm.words import give_back, mixed

#: Links have this cosine at least; the chance to find a link just there.
COSINE, RECALL = 0.9, 0.95
#: Vectors of a block; two of them meet in a task.
BLOCK = 1024
#: What a row sent to a bucket costs, in comparisons.
ROW_COST = 60.0
SEED = 20_011

_CELLS = ["tab", "key", "dim", "c1", "c2"]
_FOUND = "node long, root long, n long"


# -- hashing ----------------------------------------------------------------------


def collision(distance: float, width: float) -> float:
    """The chance that a projection puts two vectors ``distance`` apart into one cell."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def design(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[float, int, int]:
    """Cell width, projections a table and tables for ``n`` vectors.

    The cheapest by rows sent and by comparisons of unrelated vectors, which stand at right angles.
    """
    near, far, best = math.sqrt(2 - 2 * cosine), math.sqrt(2), None
    for width in [near * x / 4 for x in range(6, 33)]:
        p, q = collision(near, width), collision(far, width)
        for k in range(1, 65):
            tables = math.ceil(math.log(1 - recall) / math.log1p(-(p**k)))
            price = n * tables * (ROW_COST + k + 0.5 * n * q**k)
            if best is None or price < best[0]:
                best = (price, width, k, tables)
    return best[1:]


def _hashed(rows: np.ndarray, width: float, k: int, tables: int) -> np.ndarray:
    """A key of each row in each table."""
    dim = rows.shape[1]
    rng = np.random.default_rng([SEED, dim])
    directions, offsets = rng.standard_normal((dim, tables * k)), rng.random(tables * k)
    cells = np.floor(rows @ directions / width + offsets).astype(np.int64).view(np.uint64)
    keys = np.full((len(rows), tables), np.uint64(dim))
    for j in range(k):
        keys = mixed(keys ^ (cells[:, j::k] + np.uint64(j + 1)))
    return keys.view(np.int64)


def _directions(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by the largest entry first, so that no square over- or underflows."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def keyed(nodes: DataFrame, width: float, k: int, tables: int) -> DataFrame:
    """``nodes`` with ``keys``, one for each table. Batches may mix dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                keys = _hashed(_directions(matrix(some.column("vector"), int(dim))), width, k, tables)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], [*some.schema.names, "keys"])
        give_back()

    return nodes.mapInArrow(run, "node long, dim int, copies long, vector array<double>, keys array<long>")


# -- comparing ------------------------------------------------------------------


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first of all rows that each row is connected with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def compared(
    table: int, vectors: np.ndarray, keys: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows ``left`` and ``right`` of a bucket (within, where they are the same).

    Returns how many links each row has that no earlier table finds, and its root.
    """
    n, first, second = np.zeros(len(vectors), dtype=np.int64), [], []
    inside = left is right
    for a in range(0, len(left), 512):
        some = left[a : a + 512]
        i, j = np.nonzero(vectors[some] @ vectors[right].T >= cosine)
        i, j = some[i], right[j]
        if inside:
            i, j = i[i < j], j[i < j]
        first.append(i)
        second.append(j)
        new = np.ones(len(i), dtype=bool)
        for t in range(table):
            new &= keys[i, t] != keys[j, t]
        np.add.at(n, i[new], copies[j[new]])
        np.add.at(n, j[new], copies[i[new]])
    return n, _roots(len(vectors), np.concatenate(first), np.concatenate(second))


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut where a cell ends; two blocks at most are held beyond a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in _CELLS]
        changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        same = bool(held) and all(held[-1].column(c)[held[-1].num_rows - 1].as_py() == x[0] for c, x in zip(_CELLS, columns))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, int(changes[-1]))])
            held = [batch.slice(int(changes[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _whole_cells(batches):
            cells = cells.combine_chunks().to_batches()[0]
            columns = {c: cells.column(c).to_numpy() for c in [*_CELLS, "block", "node", "copies"]}
            changed = np.logical_or.reduce([columns[c][1:] != columns[c][:-1] for c in _CELLS])
            bounds = np.concatenate([[0], np.flatnonzero(changed) + 1, [cells.num_rows]])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a < 2:
                    continue
                own = {c: columns[c][a:b] for c in ("block", "node", "copies")}
                tab, dim, c1, c2 = (int(columns[c][a]) for c in ("tab", "dim", "c1", "c2"))
                left = np.flatnonzero(own["block"] == c1)
                right = left if c1 == c2 else np.flatnonzero(own["block"] == c2)
                if not len(left) or not len(right):
                    continue
                some = cells.slice(a, b - a)
                vectors = _directions(matrix(some.column("vector"), dim))
                keys = pa.compute.list_flatten(some.column("keys")).to_numpy().reshape(b - a, -1)
                n, root = compared(tab, vectors, keys, own["copies"], left, right, cosine)
                hit = (n > 0) | (root != np.arange(b - a))
                out.append((own["node"][hit], own["node"][root[hit]], n[hit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "root", "n"])
        give_back()

    return run


def linked(nodes: DataFrame, scratch: Scratch, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``node, root, n`` rows: parts of the number of links of each node, and links of its class."""
    width, k, tables = design(max(nodes.count(), 2), cosine, recall)
    known = scratch.keep(keyed(nodes, width, k, tables))
    rows = known.select("node", "dim", F.posexplode("keys").alias("tab", "key"))
    sizes = scratch.keep(
        rows.groupBy(F.col("tab").alias("t"), F.col("key").alias("k"), F.col("dim").alias("d"))
        .agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("met"))
        .where("met > 1")
        .drop("met")
    )
    met = rows.join(sizes, (F.col("tab") == F.col("t")) & (F.col("key") == F.col("k")) & (F.col("dim") == F.col("d")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = met.select(
        F.col("node").alias("member"), "tab", "key", block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    full = dealt.join(known, F.col("member") == F.col("node")).select(
        "tab", "key", "dim", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"),
        "block", "node", "copies", "vector", "keys",
    )
    placed = full.repartition(*_CELLS).sortWithinPartitions(*_CELLS)
    return scratch.keep(placed.mapInArrow(_compare(cosine), _FOUND))


# -- rows -------------------------------------------------------------------------


def near_vectors(
    rows: DataFrame, scratch: Scratch, id_column: str = "vec_id", vector: str = "embedding",
    cosine: float = COSINE, recall: float = RECALL,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row, whatever its other columns.

    Vectors that are null, empty, all zero or hold null or non-finite entries link with nothing, as do
    vectors of different lengths. Each repeated row or id is a vector of its own and links with its
    equals. Rows without an id take part; a component's id is its smallest one, null if it has
    none. ``kept`` says that id and component id are the same, null being the same as null, so
    repeats of the smallest id are all kept. An empty table gives an empty result.
    """
    named = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    fit = sound("vector") & F.exists("vector", lambda x: x != 0)
    # Two hashes with different seeds name a vector.
    hashed = [F.when(F.coalesce(fit, F.lit(False)), F.xxhash64(F.lit(s), "vector")).alias(f"h{s}") for s in (1, 2)]
    narrow = scratch.keep(named.select("vec_id", *hashed))
    found = scratch.keep(
        named.where(fit).groupBy(*hashed)
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
        .select(F.monotonically_increasing_id().alias("node"), F.size("vector").alias("dim"), "*")
    )
    parts = linked(found.select("node", "dim", "copies", "vector"), scratch, cosine, recall)
    counts = parts.groupBy(F.col("node").alias("of")).agg(F.sum("n").alias("n"))
    stars = components(parts.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    known = scratch.keep(
        found.drop("vector", "dim")
        .join(counts, F.col("node") == F.col("of"), "left")
        .join(stars.withColumnRenamed("node", "star"), F.col("node") == F.col("star"), "left")
        .select("h1", "h2", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"),
                F.coalesce("root", "node").alias("root"))
    )
    least = known.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component"))
    classes = scratch.keep(known.join(least, F.col("root") == F.col("top")).select("h1", "h2", "links", "component"))
    alone = narrow.where("h1 is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    own = narrow.where("h1 is not null").withColumnsRenamed({"h1": "own1", "h2": "own2"})
    joined = own.join(classes, (F.col("own1") == F.col("h1")) & (F.col("own2") == F.col("h2"))).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id")
    )
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def keep_first(rows: DataFrame, scratch: Scratch, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows that carry the smallest id of their component, with all their columns."""
    kept = scratch.keep(near_vectors(rows, scratch, id_column, vector).where("kept").select(F.col("vec_id").alias("_kept_id")).distinct())
    return rows.join(kept, F.col(id_column).cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")
