"""Near-duplicates by SimHash fingerprints and the generalised pigeonhole principle.

Two fingerprints link if they differ in TAU bits at most. With the bits dealt into partitions and
thresholds t_i such that the t_i + 1 add up to TAU + 1, two linked fingerprints differ in at most
t_i bits of some partition i; a partition with threshold -1 is not probed. Bits that go together
share a partition, so that the parts are as independent as they can be; thresholds come from
dynamic programming over the candidates that the parts' frequencies promise.

Equal fingerprints are one row from the start, so copies cost nothing further. Fingerprints that
share a key of a partition are compared where the key has few of them. Where it has many they are
linked through the neighbours that they have in common: two words within two bits of each other
have a word that is within one bit of both, and all words within one bit of it are within two bits
of each other, so a star over each such neighbour links exactly what a comparison would, in time
proportional to the number of fingerprints.
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

from recollect.llm.base import Scratch, fresh, row_hash
from recollect.llm.components import components
from recollect.llm.words import pieces
from recollect.session import broadcast_if_small

BITS, TAU, SHINGLE, SEED = 64, 2, 3, 42
#: Fingerprints under one key that are compared with each other; more are linked by stars.
COMPARED = 128
#: Numbers of partitions that are tried.
PARTITIONS = (2, 3, 4)

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text: a bit is set if over half of the shingles' hashes have it.

    A-Z are lower-cased; words are runs other than the six ASCII spaces. Shingles count as often
    as they occur. A text of fewer words than a shingle is one shingle; without words it is zero.
    """
    words = (text or "").encode().lower().split()  # bytes: exactly the six spaces, exactly A-Z
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    last = ends[min(SHINGLE, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts, last)])
    counts = np.zeros(BITS, dtype=np.int64)
    table = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    for k in range(8):
        counts[8 * k : 8 * k + 8] = np.bincount(table[:, k], minlength=256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def hexadecimal(column: str) -> F.Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


# -- partitions and thresholds --------------------------------------------------


def _bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and how often each two bits are set together.

    Every task sends one 64 by 64 table; these are added on the executors.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            x = _unpacked(batch["fp"].to_numpy(np.int64)).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": total[i, j]})

    rows = prints.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    together = np.zeros((BITS, BITS), dtype=np.float64)
    for r in rows.collect():  # 4,096 numbers at most
        together[r["i"], r["j"]] = r["n"]
    return prints.count(), together


def _unpacked(values: np.ndarray) -> np.ndarray:
    """Bits as columns, the highest first."""
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def correlated_groups(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of bits of nearly equal size; correlated bits go to one group."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = (BITS * (k + 1)) // parts - (BITS * k) // parts
        group = [min(free)]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: link[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], tau: int = TAU) -> tuple[float, list[int]]:
    """Thresholds from -1 upwards whose t + 1 add up to ``tau + 1`` at least cost.

    ``costs[i][t + 1]`` is what probing partition i with threshold t costs.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, price in enumerate(cost):
                at = used + t
                if at <= tau + 1 and (at not in following or total + price < following[at][0]):
                    following[at] = (total + price, [*chosen, t - 1])
        best = following
    return best[tau + 1]


def _ball(width: int, radius: int) -> int:
    return sum(1 for r in range(radius + 1) for _ in combinations(range(width), r)) if radius >= 0 else 0


def _cost(n: int, together: np.ndarray, group: list[int]) -> list[float]:
    """Rows that are sent and candidates that are compared, for thresholds -1, 0 and 1.

    Chance that two fingerprints agree in a part: that of each bit, multiplied; correlation is
    what the grouping has put inside the part, so the estimate errs on the low side alike for all.
    """
    p = np.diag(together)[group] / max(n, 1)
    agree = float(np.prod(p * p + (1 - p) * (1 - p)))
    prices = [0.0]
    for t in (0, 1):
        ball = _ball(len(group), t)
        prices.append(4.0 * n * ball + 0.5 * n * n * agree * ball)
    return prices


def plan(prints: DataFrame) -> list[tuple[list[int], int]]:
    """The partitions to probe, each a list of bits and its threshold."""
    n, together = _bit_statistics(prints)
    choices = []
    for parts in PARTITIONS:
        groups = correlated_groups(n, together, parts)
        total, thresholds = allocate([_cost(n, together, g) for g in groups])
        choices.append((total, parts, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(choices, key=lambda c: (c[0], c[1]))[2]


# -- probing --------------------------------------------------------------------


def _pack(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits), dtype=np.int64)
    for column in bits.T:
        out = (out << 1) | column.astype(np.int64)
    return out


def probes(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``part, key, fp``: the keys that each fingerprint has, or is within reach of, in each part.

    With threshold 1 every fingerprint goes to its own key and to those one bit away; two parts
    that differ in one bit so meet twice, which is one probe more than needed but treats both alike.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            bits = _unpacked(values)
            for number, (group, threshold) in enumerate(parts):
                own = _pack(bits[:, group])
                keys = [own] + [own ^ (1 << k) for k in range(len(group) if threshold == 1 else 0)]
                yield pd.DataFrame({
                    "part": np.full(len(values) * len(keys), number, dtype=np.int32),
                    "key": np.concatenate(keys), "fp": np.tile(values, len(keys)),
                })

    return prints.select("fp").mapInPandas(emit, "part int, key long, fp long")


def spanning_links(values: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of what lies within TAU bits among a few fingerprints."""
    values = np.sort(values)
    apart = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= TAU
    root, links = np.arange(len(values)), []
    for i, j in zip(*np.nonzero(np.triu(apart, 1))):
        if root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root[root == high] = low
            links.append((int(values[i]), int(values[j])))
    return links


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [link for fps in batch["fps"] for link in spanning_links(np.asarray(fps, dtype=np.int64))]
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _stars(prints: DataFrame) -> DataFrame:
    """Links through common neighbours: a key has 65 fingerprints at most."""
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    near = F.concat(F.array("fp"), F.transform(bits, lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    met = prints.select("fp", F.explode(near).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("fps"))
    return met.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that join all within TAU bits."""
    keyed = scratch.keep(probes(prints, plan(prints)))
    sizes = scratch.keep(
        keyed.groupBy(F.col("part").alias("p"), F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    )
    met = keyed.join(sizes, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")))
    few = met.where(F.col("n") <= COMPARED).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    compared = few.select("fps").mapInPandas(_compare, "a long, b long")
    many = met.where(F.col("n") > COMPARED).select("fp").distinct()
    return compared.union(_stars(many)).distinct()


# -- documents ------------------------------------------------------------------


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, row, fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = [_signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.int64())], ["doc_id", "row", "fp"])

    return docs.select("doc_id", row_hash(docs).alias("row"), "text").mapInArrow(run, "doc_id long, row long, fp long")


def classes(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """``fp, first``: every distinct fingerprint and the first row of its class.

    ``first`` is a struct ``(no_id, doc_id, row)``, the smallest of the class; rows without an id
    come last.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = scratch.keep(prints.groupBy("fp").agg(F.min(first).alias("own")))
    linked = components(links(groups.select("fp"), scratch), scratch)
    rooted = groups.join(linked, groups["fp"] == linked["node"], "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root")
    )
    joined = scratch.keep(rooted.where(F.col("root") != F.col("fp")))  # only few fingerprints have links
    roots = rooted.join(joined.select(F.col("root").alias("r")).distinct(), F.col("root") == F.col("r"), "left_semi")
    least = roots.groupBy(F.col("root").alias("least_root")).agg(F.min("own").alias("least"))
    return rooted.join(least, F.col("root") == F.col("least_root"), "left").select(
        "fp", F.coalesce("least", "own").alias("first")
    )


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, row, fp, first`` of every row of ``docs``; rows of one class share ``first``.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are in
    one class. A class without any id has none in ``first``. An empty table gives an empty result.
    """
    prints = scratch.keep(fingerprinted(docs))
    found = scratch.keep(classes(prints, scratch)).withColumnRenamed("fp", "class_fp")
    return prints.join(found, prints["fp"] == found["class_fp"]).drop("class_fp")


def keep_first(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The first document of every class with its columns; repeats of that row go as well."""
    return keep_firsts(docs, near_duplicates(docs, scratch), scratch)


def keep_firsts(docs: DataFrame, classified: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that are ``first`` in the class that ``doc_id, row, first`` rows tell, once each."""
    rows = scratch.keep(classified)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    name = [F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")]
    dropped = rows.where(~same).select(*name).distinct()
    repeated = scratch.keep(rows.where(same).groupBy(*name).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    key = fresh(docs, "_row")
    named = docs.withColumn(key, row_hash(docs))
    leave = broadcast_if_small(scratch.keep(dropped.union(repeated)))
    once = broadcast_if_small(repeated)
    is_row = lambda of: (named[key] == of["of_row"]) & named["doc_id"].eqNullSafe(of["of_id"])
    single = named.join(leave, is_row(leave), "left_anti")
    again = named.join(once, is_row(once), "left_semi").dropDuplicates(["doc_id", key])
    return single.union(again).drop(key)
