"""Greedy removal of redundant candidates, best first.

A candidate is dropped when a better, kept one has the same content hash,
overlaps its lines in the same file, or shares enough word shingles. Which rows
survive depends on the order of decisions, so each query's list, bounded by what is
fetched for it, is one group; the queries are spread over the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollect.functions.batches import give_back
from recollect.functions.text import shingle_hashes

#: Fixed value: Jaccard similarity from which two texts count as the same.
SIMILARITY = 0.85

class _Kept:
    """What has been kept so far, indexed for the three tests."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.hashes: set[str] = set()
        self.ranges: dict[str, list[tuple[int, int]]] = {}
        self.grams: list[np.ndarray] = []
        self.holders: dict[int, list[int]] = {}

    def covers(self, path, start, end) -> bool:
        return any(start <= e and s <= end for s, e in self.ranges.get(path, ()))

    def resembles(self, grams: np.ndarray, probes: list[int]) -> bool:
        maybe = {k for g in probes for k in self.holders.get(g, ())}
        for other in (self.grams[k] for k in maybe):
            if min(len(grams), len(other)) < self.similarity * max(len(grams), len(other)) - 1e-9:
                continue
            shared = len(np.intersect1d(grams, other, assume_unique=True))
            if shared / (len(grams) + len(other) - shared) >= self.similarity:
                return True
        return False

    def add(self, content_hash, place, grams: np.ndarray, probes: list[int]) -> None:
        if content_hash:
            self.hashes.add(content_hash)
        if place:
            self.ranges.setdefault(place[0], []).append(place[1:])
        for g in probes:
            self.holders.setdefault(g, []).append(len(self.grams))
        self.grams.append(grams)


def _rare_first(lists: pa.ListArray) -> tuple[list[np.ndarray], int]:
    """Each row's grams as numbers, sorted, the rarest in the group lowest; and how many
    numbers belong to a single row."""
    _, code, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    number = np.empty(len(count), dtype=np.int64)
    number[np.argsort(count, kind="stable")] = np.arange(len(count))
    rows = np.split(number[code], np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
    return [np.sort(r) for r in rows], int((count == 1).sum())


_JUDGED = ["grams", "content_hash", "file_path", "line_start", "line_end"]


def _survivors(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["id"].to_numpy(), -group["score"].to_numpy()))
        # Texts are not copied to be judged; only those of survivors are, once.
        judged = group.select(_JUDGED).take(pa.array(order)).combine_chunks()
        grams, unshared = _rare_first(judged["grams"].chunk(0))
        # Two sets this similar share one of their first few grams in any common order.
        heads = (g[: len(g) - math.ceil(similarity * len(g) - 1e-9) + 1] for g in grams)
        probes = (h[h >= unshared].tolist() for h in heads)
        kept, rows = _Kept(similarity), []
        tests = zip(*(judged[c].to_pylist() for c in _JUDGED[1:]), grams, probes)
        for at, (content_hash, path, start, end, own, probe) in enumerate(tests):
            place = None if None in (path, start, end) else (path, start, end)
            if content_hash and content_hash in kept.hashes:
                continue
            if (place and kept.covers(*place)) or kept.resembles(own, probe):
                continue
            kept.add(content_hash, place, own, probe)
            rows.append(at)
        found = group.drop_columns(["grams"]).take(pa.array(order[rows], type=pa.int64()))
        del judged, grams, probes, kept, tests
        give_back()  # a worker serves many groups, and would keep the most that any of them took
        return found

    return run


def greedy_dedup(candidates: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The surviving rows of ``candidates``, which needs ``project, query_id, id, score, content_hash,
    file_path, line_start, line_end`` and keeps every other column. ``grams`` (the texts'
    ``shingle_hashes``) is used up; it is formed from ``text`` where it is missing.
    """
    if "grams" not in candidates.columns:
        candidates = candidates.withColumn("grams", shingle_hashes(F.col("text")))
    kept = [f for f in candidates.schema if f.name != "grams"]
    return candidates.groupBy("project", "query_id").applyInArrow(_survivors(similarity), StructType(kept))
