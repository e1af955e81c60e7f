"""Near-duplicate texts: SimHash candidates within a wide radius, verified by shingle similarity.

Texts are alike if the Jaccard similarity of their five-word shingles is SIMILAR or more. At that
similarity a tenth to a sixth of the bits of two fingerprints differ, so the radius is much
wider than where fingerprints alone decide. A fingerprint has two halves of 64 bits. The first is
probed by the generalised pigeonhole principle: correlated bits share a partition, and dynamic
programming allocates thresholds over measured candidate counts. Within a partition two words at
most t bits apart meet at a key that is within t / 2 bits of both. What meets is checked by both
halves, which leaves hardly any unrelated texts at any size of corpus.

Links of tasks are spanning forests, never all pairs. Texts that are connected so are compared
by whole shingle sets, in blocks, where a pair that verified links already connect needs no look.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import simhash
from recollect.llm.base import Scratch, row_hash
from recollect.llm.components import components
from recollect.llm.words import Words, give_back, gram_hashes, mixed, pieces
from recollect.session import broadcast_if_small

#: Words to a shingle and similarity from which texts are copies.
SHINGLE, SIMILAR = 5, 0.8
#: Differing bits at most, of the first half and of both. At a similarity of 0.8 the means are 10 and 19.
TAU, TAU_BOTH = 11, 27
#: Numbers of partitions that are tried, the highest threshold of one, and members of a block.
PARTITIONS, MOST, BLOCK = (2, 3, 4, 5, 6), 3, 1024
#: Rows of a key from which they are dealt into blocks. A row is sent once for each block of its key, so
#: blocks are larger than the keys that the plan makes of texts that are not alike.
KEY_BLOCK = 8192
#: Pairs of fingerprints that are compared at once.
_PAIRS = 1 << 18
#: Texts that must have a key of their own before it is looked at as one that needs blocks: fewer
#: add up to a few of these for each word around a key.
NOTED = 32
#: What a row sent to a key costs, in comparisons.
ROW_COST = 1000.0

_CELL = ["key", "cell"]


# -- fingerprints -----------------------------------------------------------------


def shingles(text: str | None) -> np.ndarray:
    """A number for each shingle of a text, repeats included. A-Z are lower-cased, words are runs other
    than the six ASCII spaces; a text of fewer words is one shingle, one without words has none."""
    words = Words([(text or "").encode().lower()])
    n = len(words.starts)
    return gram_hashes(words.hashes(), min(SHINGLE, n)) if n else np.zeros(0, dtype=np.uint64)


def fingerprints(grams: np.ndarray) -> tuple[int, int]:
    """Two SimHashes of the shingles, signed: of the numbers themselves and of these mixed once more."""
    out = []
    for values in (grams, mixed(grams ^ np.uint64(simhash.SEED))):
        ones = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big", signed=True))
    return out[0], out[1]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, row, t1, t2, fp, fp2``: identity, 128 bits that name the text, fingerprints. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                name = xxhash.xxh3_128_digest((text or "").encode())
                rows.append((*(int.from_bytes(x, "big", signed=True) for x in (name[:8], name[8:])), *fingerprints(shingles(text))))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "row", "t1", "t2", "fp", "fp2"])

    found = docs.select("doc_id", row_hash(docs).alias("row"), "text")
    return found.mapInArrow(run, "doc_id long, row long, t1 long, t2 long, fp long, fp2 long")


# -- plan ------------------------------------------------------------------------


def ball(width: int, radius: int) -> np.ndarray:
    """All words of ``width`` bits with ``radius`` ones at most, fewest first."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], dtype=np.int64)


def _agreement(texts: DataFrame, choices: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each number of partitions and part, how many pairs of texts have equal bits in it."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = simhash._unpacked(batch["fp"].to_numpy(np.int64))
            for parts, groups in choices.items():
                for k, group in enumerate(groups):
                    yield pd.DataFrame({"parts": parts, "part": k, "key": simhash._pack(bits[:, group])})

    keys = texts.select("fp").mapInPandas(emit, "parts int, part int, key long").groupBy("parts", "part", "key").agg(F.count("*").alias("n"))
    pairs = keys.groupBy("parts", "part").agg(F.sum(F.col("n").cast("double") * F.col("n") / 2).alias("pairs"))
    return {(r["parts"], r["part"]): r["pairs"] for r in pairs.collect()}  # a few numbers


def plan(texts: DataFrame) -> list[tuple[list[int], int]]:
    """The partitions to probe, each a list of bits and its threshold."""
    n, together = simhash._bit_statistics(texts)
    choices = {parts: simhash.correlated_groups(n, together, parts) for parts in PARTITIONS}
    pairs, best = _agreement(texts, choices), None
    for parts, groups in choices.items():
        costs = []
        for k, group in enumerate(groups):
            sent = [len(ball(len(group), (t + 1) // 2)) for t in range(MOST + 1)]
            costs.append([0.0, *[ROW_COST * n * s + pairs.get((parts, k), 0.0) * s * s for s in sent]])
        if sum(len(c) - 1 for c in costs) < TAU + 1:
            continue
        total, thresholds = simhash.allocate(costs, TAU)
        if best is None or total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return best[1]


# -- candidates -------------------------------------------------------------------


def _keys(bits: np.ndarray, number: int, group: list[int]) -> np.ndarray:
    """Keys of a part, which no other part has."""
    return simhash._pack(bits[:, group]) | (number << 40)


def probes(texts: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``key, tag, fp, fp2``. Two words meet where the radii around them add up to the threshold: keys
    in the larger ball of both meet if either is in its smaller ball. ``tag`` is the unit, and in its
    lowest bit whether the key is in the smaller ball."""
    names = ["key", "tag", "fp", "fp2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, fp, fp2 = (batch.column(c).to_numpy() for c in ("unit", "fp", "fp2"))
            bits = simhash._unpacked(fp)
            for number, (group, t) in enumerate(parts):
                around = ball(len(group), (t + 1) // 2)
                inner = (np.arange(len(around)) < len(ball(len(group), t // 2))).astype(np.int64)
                keys = (_keys(bits, number, group)[:, None] ^ around[None]).ravel()
                tags = (2 * unit[:, None] + inner[None]).ravel()
                columns = [keys, tags, *(np.repeat(c, len(around)) for c in (fp, fp2))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return texts.select("unit", "fp", "fp2").mapInArrow(run, "key long, tag long, fp long, fp2 long")


def crowded(texts: DataFrame, parts: list[tuple[list[int], int]], scratch: Scratch) -> DataFrame:
    """``of_key, blocks`` for the keys that very many texts are sent to.

    Counted are own keys, and only those of NOTED texts or more are spread to the keys around them, so
    no more than a few rows for each text are exchanged.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = simhash._unpacked(batch.column("fp").to_numpy())
            for number, (group, _) in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(bits, number, group))], ["key"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            for number, (group, t) in enumerate(parts):
                around, some = ball(len(group), (t + 1) // 2), keys >> 40 == number
                near = (keys[some][:, None] ^ around[None]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(n[some], len(around)))], ["key", "n"])

    noted = texts.select("fp").mapInArrow(own, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= NOTED)
    met = scratch.keep(noted).mapInArrow(spread, "key long, n long").groupBy(F.col("key").alias("of_key")).agg(F.sum("n").alias("n"))
    return scratch.keep(met.where(F.col("n") > KEY_BLOCK).select("of_key", F.ceil(F.col("n") / KEY_BLOCK).alias("blocks")))


def forest(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The first of all rows that each row is connected with, also by ``root`` where that is given."""
    if root is not None:
        i, j = np.concatenate([i, np.arange(n)]), np.concatenate([j, root])
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def near_rows(fp: np.ndarray, fp2: np.ndarray, inner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The root of each row when the near ones of ``left`` and ``right`` are connected.

    What is near is joined to the forest a strip at a time, as a cell of copies has the square of its rows
    in pairs. Connected rows stand together, and a strip of them meets only what they are not connected with.
    """
    root, todo, linked = np.arange(len(fp)), left, False
    while len(todo):
        others, same = right, len(todo)
        if linked:
            todo = todo[np.argsort(root[todo], kind="stable")]
            own = root[todo[0]]
            same = int(np.searchsorted(root[todo], own, side="right"))
            if same > 1:
                others = right[root[right] != own]
            else:
                same = len(todo)
        if not len(others):
            todo = todo[same:]
            continue
        # Rows of other roots may only come along where nothing was left out.
        some = todo[: min(same, max(1, _PAIRS // len(others)))]
        todo = todo[len(some) :]
        apart = np.bitwise_count((fp[some, None] ^ fp[None, others]).view(np.uint64))
        i, j = np.nonzero(apart <= TAU)
        both = apart[i, j] + np.bitwise_count((fp2[some[i]] ^ fp2[others[j]]).view(np.uint64))
        good = (both <= TAU_BOTH) & (inner[some[i]] | inner[others[j]])
        if good.any():
            root, linked = forest(len(fp), some[i[good]], others[j[good]], root if linked else None), True
    return root


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` of a spanning forest of what is near in each cell; batches are sorted by cell."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch:
        x = {c: rows[c].to_numpy() for c in [*_CELL, "tag", "fp", "fp2"]}
        cuts = np.flatnonzero(np.logical_or.reduce([x[c][1:] != x[c][:-1] for c in _CELL])) + 1
        found = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x["key"])]):
            if b - a < 2:
                continue
            tag, fp, fp2 = (x[c][a:b] for c in ("tag", "fp", "fp2"))
            unit, inner, cell = tag >> 2, (tag >> 1 & 1).astype(bool), int(x["cell"][a])
            left = np.flatnonzero(tag & 1)
            right = left if cell >> 20 == cell & 0xFFFFF else np.flatnonzero(~tag & 1)
            root = near_rows(fp, fp2, inner, left, right)
            moved = np.flatnonzero(root != np.arange(b - a))
            found.append((unit[moved], unit[root[moved]]))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in _CELL]
        # All but the last cell of what is there is whole.
        last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if held and (cut or any(held[-1].column(c)[-1].as_py() != x[0] for c, x in zip(_CELL, columns))):
            yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield links(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield links(pa.Table.from_batches(held))
    give_back()


def _dealt(rows: DataFrame, keys: list[str], unit: str, scratch: Scratch, block: int) -> DataFrame:
    """``rows`` whose keys are shared, dealt into pairs of blocks ``c1 <= c2``; a key's rows fill
    as many blocks as they need, so no task gets more of a key than two blocks."""
    sizes = rows.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.count("*").alias("met")).where("met > 1")
    sizes = scratch.keep(sizes.select(*[f"of_{k}" for k in keys], F.ceil(F.col("met") / block).alias("blocks")))
    met = rows.join(sizes, [F.col(k) == F.col(f"of_{k}") for k in keys])
    own = F.pmod(F.xxhash64(unit), F.col("blocks"))
    spread = met.select(*rows.columns, own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return spread.select(*rows.columns, "block", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"))


def dealt(texts: DataFrame, parts: list[tuple[list[int], int]], scratch: Scratch) -> DataFrame:
    """``key, cell, tag, fp, fp2``: what is sent to the keys, once for each block of its key. A cell is a pair
    of blocks; the lowest bit of ``tag`` says whether the row is of the first."""
    rows = probes(texts, parts)
    sent = rows.join(broadcast_if_small(crowded(texts, parts, scratch)), F.col("key") == F.col("of_key"), "left")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64(F.shiftright("tag", 1)), blocks)
    spread = sent.select("key", "tag", "fp", "fp2", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    low = F.least("own", "other")
    return spread.select(
        "key", (low * (1 << 20) + F.greatest("own", "other")).alias("cell"),
        (F.col("tag") * 2 + (F.col("own") == low).cast("long")).alias("tag"), "fp", "fp2",
    )


def candidates(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: links that connect all texts within the radii. What is sent to the keys is exchanged once."""
    cells = dealt(texts, plan(texts), scratch)
    sorted_ = cells.repartition(*_CELL).sortWithinPartitions(*_CELL)
    return scratch.keep(sorted_.mapInArrow(_meet, "a long, b long").distinct())


# -- verification ------------------------------------------------------------------


def _grams(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [np.unique(shingles(t)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int64()))], ["cluster", "unit", "grams"])

    return docs.select("cluster", "unit", "text").mapInArrow(run, "cluster long, unit long, grams array<long>")


def texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``cluster, unit, text`` of one document of each member, and of rows equal to it, read where they lie:
    up to a million members the texts of all others are not exchanged for it."""
    key = F.struct(F.col("own.doc_id").alias("doc_id"), F.col("own.row").alias("row"))
    wanted = broadcast_if_small(members.select("unit", "cluster", key.alias("of")))
    named = docs.select("doc_id", row_hash(docs).alias("row"), "text").join(
        wanted, F.col("row").eqNullSafe(F.col("of.row")) & F.col("doc_id").eqNullSafe(F.col("of.doc_id"))
    )
    return named.select("cluster", "unit", "text")


def verified(c1: int, c2: int, block: np.ndarray, sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """The root of each row when rows of the two blocks that are alike are connected."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    _, code = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    mark, root = np.zeros(len(code) + 1, dtype=bool), np.arange(n)
    for i in np.flatnonzero(block == c1):
        # A pair that is connected already needs no look; nor does one of too unlike sizes.
        others = np.flatnonzero((block == c2) & (root != root[i]))
        others = others[np.minimum(sizes[others], sizes[i]) >= similar * np.maximum(sizes[others], sizes[i])]
        if c1 == c2:
            others = others[others > i]
        if not len(others):
            continue
        own = code[ends[i] : ends[i + 1]]
        mark[own] = True
        for j in others:
            if root[j] == root[i]:
                continue
            common = int(mark[code[ends[j] : ends[j + 1]]].sum())
            whole = sizes[i] + sizes[j] - common
            if not whole or common / whole >= similar:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
        mark[own] = False
    return root


def _compare(cell: pa.Table) -> pa.Table:
    lists = cell["grams"].combine_chunks()
    sets = np.split(lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
    unit = cell["unit"].to_numpy()
    root = verified(cell["c1"][0].as_py(), cell["c2"][0].as_py(), cell["block"].to_numpy(), sets)
    moved = np.flatnonzero(root != np.arange(len(unit)))
    return pa.table({"a": unit[moved], "b": unit[root[moved]]})


def classified(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, row, first`` of every row of ``docs``; rows of one class share ``first``, a struct
    ``(no_id, doc_id, row)``.

    Classes are the texts that chains of similar ones connect. Equal texts are in one class; so are
    all without words, null ones included. Rows without an id come last in a class. An empty table
    gives an empty result.
    """
    rows = scratch.keep(measured(docs))
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    texts = scratch.keep(
        rows.groupBy("t1", "t2").agg(F.min(who).alias("own"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"))
        .withColumn("unit", F.monotonically_increasing_id())
    )
    if texts.isEmpty():
        return rows.select("doc_id", "row", who.alias("first"))
    near = scratch.keep(components(candidates(texts, scratch), scratch))
    members = texts.join(near, F.col("unit") == F.col("node")).select("unit", F.col("root").alias("cluster"), "own")
    members = scratch.keep(members.union(texts.join(near.select("root").distinct(), F.col("unit") == F.col("root")).select("unit", F.col("root"), "own")).distinct())
    sets = scratch.keep(_grams(texts_of(docs, members)).dropDuplicates(["unit"]))
    cells = _dealt(sets, ["cluster"], "unit", scratch, BLOCK // 4)
    links = cells.groupBy("cluster", "c1", "c2").applyInArrow(_compare, "a long, b long")
    classes = components(scratch.keep(links), scratch)
    rooted = texts.join(classes, F.col("unit") == F.col("node"), "left").select("t1", "t2", "own", F.coalesce("root", "unit").alias("class"))
    firsts = rooted.groupBy(F.col("class").alias("of")).agg(F.min("own").alias("first"))
    told = scratch.keep(rooted.join(firsts, F.col("class") == F.col("of")).select(F.col("t1").alias("x1"), F.col("t2").alias("x2"), "first"))
    return rows.join(told, (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2"))).select("doc_id", "row", "first")


def keep_first(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The first document of every class with its columns."""
    return simhash.keep_firsts(docs, classified(docs, scratch), scratch)
