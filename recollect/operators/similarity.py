"""Pairs of similar sets of whole tables, found without comparing all.

Grams have one global order, rare ones first. Two sets with Jaccard similarity t or more share a
gram among the first ``n - ceil(t n) + 1`` of each, so sets meet only where such prefixes do, and
only with sets of a like size. A pair that meets at several grams is taken once. What passes these
tests is verified with whole sets, which are sent to where the pairs are, once for each meeting place
and not once for each pair.

Most grams are in few prefixes, and their sets meet as they are. A gram that very many prefixes hold is
dealt by bands of size and into blocks, pairs of which meet in different tasks. The order needs counts in all of the table; these are kept for BUCKETS hash buckets of grams, a
table of bounded size. Which order it is changes how many sets meet, never the answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.batches import give_back, list_shares, shares
from recollect.session import Scratch, broadcast_if_small

#: Buckets of gram counts (8 bytes each in every task) and sets of a block.
BUCKETS, BLOCK = 1 << 18, 512
#: What makes rounding harmless where a bound is a whole number.
_SLACK = 1e-9

_CELL = ["gram", "band", "c1", "c2"]


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - _SLACK) + 1 if n else 0


def _bucket(grams: np.ndarray) -> np.ndarray:
    """Grams are hashes already."""
    return (grams.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)


def gram_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold grams of each bucket. Tasks add up their own; BUCKETS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for share in (s for batch in batches for s in list_shares(batch, "grams")):
            total += np.bincount(_bucket(share.column("grams").flatten().to_numpy()), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])
        give_back()

    rows = sets.select("grams").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows.toLocalIterator():
        out[r.bucket] = r.n
    return out


def prefixes(sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """``gram, own_band, node, n, pos, prev`` for each gram of each set's prefix.

    Sizes are divided into bands such that similar sets are in the same or in neighbouring ones.
    ``prev`` is the gram before in the order.
    """
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    base = math.log(1 / threshold) * 1.001 if threshold < 1 else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A share at a time: what is sent on is a multiple of the prefixes, and batches may be large.
        for share in (s for batch in batches for s in list_shares(batch, "grams")):
            lists, out = share.column("grams"), []
            values, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
            for node, a, b in zip(share.column("node").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                n = b - a
                if not n:
                    continue
                own = values[a:b]
                own = own[np.lexsort((own, shared.value[_bucket(own)]))][: prefix_length(n, threshold)]
                p = len(own)
                out.append((own, np.full(p, int(math.log(n) / base)), np.full(p, node), np.full(p, n), np.arange(1, p + 1), np.concatenate([[0], own[:-1]])))
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _ENTRY)
        give_back()

    return sets.select("node", "grams").mapInArrow(run, ", ".join(f"{c} long" for c in _ENTRY))


_ENTRY = ["gram", "own_band", "node", "n", "pos", "prev"]


def _dealt(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """``entries`` with the cells in which they meet and their ``block`` there.

    Entries of a gram make one cell, of no band (-1). Those of a gram with over BLOCK of them are in their own
    band and the next, and in a cell for each pair of their block with another of the band.
    """
    met = entries.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("met"))
    crowds = broadcast_if_small(scratch.keep(met.where(F.col("met") > BLOCK).select("g")))
    bands = F.explode(F.array("own_band", F.col("own_band") + 1))
    banded = entries.join(crowds, F.col("gram") == F.col("g")).select(*_ENTRY, bands.alias("band"))
    counted = banded.groupBy(F.col("gram").alias("g"), F.col("band").alias("w")).agg(F.count("*").alias("met"))
    blocks = scratch.keep(counted.select("g", "w", F.ceil(F.col("met") / BLOCK).alias("blocks")))
    split = (
        banded.join(broadcast_if_small(blocks), (F.col("gram") == F.col("g")) & (F.col("band") == F.col("w")))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(*_ENTRY, "band", "block", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"))
    )
    zero = F.lit(0).cast("long")
    alone = entries.join(crowds, F.col("gram") == F.col("g"), "left_anti").select(
        *_ENTRY, F.lit(-1).cast("long").alias("band"), zero.alias("block"), zero.alias("c1"), zero.alias("c2")
    )
    return alone.unionByName(split)


#: Narrow rows that are looked at together, where batches are smaller.
_TOGETHER = 1 << 15


def whole_groups(keys: list[str], use: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A task's function over rows sorted by ``keys``: ``use`` gets rows of many keys at a time, but
    all rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(b.num_rows for b in held) + batch.num_rows < _TOGETHER:
                held.append(batch)
                continue
            cuts = _starts([batch.column(c).to_numpy() for c in keys])
            if held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in keys):
                cuts = cuts[1:]
            if len(cuts):
                # What is before the last cut is whole, the last key may go on in the next batch.
                held.append(batch.slice(0, cuts[-1]))
                yield from use(pa.Table.from_batches(held).combine_chunks().to_batches())
                held = []
            held.append(batch.slice(cuts[-1] if len(cuts) else 0))
        if held:
            yield from use(pa.Table.from_batches(held).combine_chunks().to_batches())
        give_back()

    return run


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """The places at which a row differs from the one before, the first included."""
    return np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1])


#: Pairs of rows that a task judges at once; those of one row are never divided.
_PAIRS = 1 << 17


def _meet(threshold: float):
    def judged(x: dict[str, np.ndarray], first: int, partners: np.ndarray) -> pa.RecordBatch | None:
        """Of rows from ``first`` on, each with so many rows after it, the pairs that may be alike."""
        i = np.repeat(np.arange(first, first + len(partners)), partners)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners) - partners, partners)
        n, m = x["n"][i], x["n"][j]
        # Sizes leave few pairs, so they are judged first.
        fits = np.minimum(n, m) >= threshold * np.maximum(n, m) - _SLACK
        fits &= (x["band"][i] < 0) | (np.maximum(x["own_band"][i], x["own_band"][j]) == x["band"][i])
        fits &= (x["c1"][i] == x["c2"][i]) | (x["block"][i] != x["block"][j])
        i, j, n, m = i[fits], j[fits], n[fits], m[fits]
        rest = 1 + np.minimum(n - x["pos"][i], m - x["pos"][j])
        fits = rest >= threshold / (1 + threshold) * (n + m) - _SLACK
        # Where the grams before are the same, the two have met there.
        fits &= (x["pos"][i] == 1) | (x["pos"][j] == 1) | (x["prev"][i] != x["prev"][j])
        i, j = i[fits], j[fits]
        if not len(i):
            return None
        a, b = x["node"][i], x["node"][j]
        columns = [np.minimum(a, b), np.maximum(a, b), *[x[c][i] for c in _CELL]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", *_CELL])

    def use(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in [*_CELL, "block", "own_band", "node", "n", "pos", "prev"]}
            starts = _starts([x[c] for c in _CELL])
            sizes = np.diff(np.append(starts, batch.num_rows))
            partners = np.repeat(starts + sizes, sizes) - np.arange(batch.num_rows) - 1
            for a, b in shares(partners.tolist(), _PAIRS, batch.num_rows):
                if (found := judged(x, a, partners[a:b])) is not None:
                    yield found

    return use


def _verify(threshold: float):
    def use(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if pairs.num_rows:
            lists = sets["grams"].combine_chunks()
            place = {node: k for k, node in enumerate(sets["node"].to_pylist())}
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            _, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            sizes, mark = np.diff(offsets), np.zeros(int(code.max(initial=0)) + 1, dtype=bool)
            pairs = pairs.sort_by([("a", "ascending"), ("b", "ascending")])
            a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            for s, e in zip(starts, [*starts[1:], len(a)]):
                i, j = place[a[s]], np.array([place[x] for x in b[s:e]])
                own = code[offsets[i] : offsets[i + 1]]
                mark[own] = True
                common = np.array([mark[code[offsets[k] : offsets[k + 1]]].sum() for k in j])
                mark[own] = False
                likeness = common / (sizes[i] + sizes[j] - common)
                keep = likeness >= threshold
                found.append((a[s:e][keep], b[s:e][keep], likeness[keep]))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(["a", "b", "similarity"], columns)))

    return use


def similar_pairs(sets: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """``a, b, similarity`` of all pairs of different nodes, ``a < b``, that are alike by ``threshold`` or more.

    ``sets`` is a kept table of ``node`` (unique) and ``grams``, distinct hashes in any order. An empty
    set is like no other. Equal sets should be one node: copies of it are then no pairs.
    """
    entries = scratch.keep(prefixes(sets, gram_counts(sets), threshold))
    cells = _dealt(entries, scratch)
    # A number of its own: these rows are few bytes for the pairs they make, and Spark joins tasks by bytes.
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = (
        cells.repartition(tasks, *_CELL).sortWithinPartitions(*_CELL)
        .mapInArrow(whole_groups(_CELL, _meet(threshold)), "a long, b long, gram long, band long, c1 long, c2 long")
    )
    pairs = scratch.keep(candidates.groupBy("a", "b").agg(F.min(F.struct(*_CELL)).alias("cell")))
    needed = pairs.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("member")).distinct()
    sent = needed.join(sets, F.col("member") == F.col("node")).select("at", "node", "grams")
    verified = pairs.groupBy("cell").cogroup(sent.groupBy("at")).applyInArrow(
        _verify(threshold), "a long, b long, similarity double"
    )
    return scratch.keep(verified)


def distinct_sets(rows: DataFrame, scratch: Scratch, *within: str) -> tuple[DataFrame, DataFrame]:
    """``node, grams`` of the distinct sets of ``rows`` (``grams`` sorted), and ``rows`` with their ``node``.

    With ``within`` columns, sets meet only where these are equal.
    """
    grams = F.col("grams")
    if within:
        # As the first gram of its group would have it: grams of different groups differ.
        place = F.xxhash64(*within)
        grams = F.transform("grams", lambda g: F.xxhash64(place, g))
    named = rows.withColumns({"_g1": F.xxhash64(F.lit(1), *within, "grams"), "_g2": F.xxhash64(F.lit(2), *within, "grams")})
    sets = scratch.keep(
        named.groupBy("_g1", "_g2").agg(F.first(grams).alias("grams"))
        .select(F.monotonically_increasing_id().alias("node"), F.col("_g1").alias("g1"), F.col("_g2").alias("g2"), "grams")
    )
    member = named.join(sets.select("node", "g1", "g2"), (F.col("_g1") == F.col("g1")) & (F.col("_g2") == F.col("g2")))
    return sets.select("node", "grams"), member.drop("_g1", "_g2", "g1", "g2")


def similar_rows(rows: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """``a, b, similarity``: pairs of representatives, the smallest ``id`` of rows with equal ``grams``."""
    # The smallest id is found where equal sets meet, so that the grams are formed once.
    named = rows.select("id", "grams", F.xxhash64(F.lit(1), "grams").alias("g1"), F.xxhash64(F.lit(2), "grams").alias("g2"))
    distinct = named.groupBy("g1", "g2").agg(F.first("grams").alias("grams"), F.min("id").alias("id"))
    sets = scratch.keep(distinct.select(F.monotonically_increasing_id().alias("node"), "id", "grams"))
    pairs = similar_pairs(sets.select("node", "grams"), scratch, threshold)
    one, two = (sets.select(F.col("node").alias(n), F.col("id").alias(i)) for n, i in (("n1", "i1"), ("n2", "i2")))
    labelled = pairs.join(one, F.col("a") == F.col("n1")).join(two, F.col("b") == F.col("n2"))
    return labelled.select(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b"), "similarity")
