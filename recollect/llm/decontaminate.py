"""Benchmark passages in training documents, also edited ones.

The words of the benchmark are counted in all documents. From these counts follows how often each
run of SEED words of an item is to be expected by chance; rare runs are seeds, and so is the rarest
run of every STRETCH of the item, so that no few edits can hit all of them. Where a document
holds a seed, the item is aligned with the words around it by Smith-Waterman over words, and a pair
is reported if the alignment is good and too long to be chance, or if the whole item stands there
word by word, however short or common it is.

Documents are read in place, twice, and never shuffled. The benchmark is the query set: it goes to
the tasks in slices of bounded size, and more benchmark means more slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.base import Scratch, fresh, row_hash
from recollect.llm.words import NOT_ALNUM, Words, gram_hashes, pieces, slices
from recollect.session import broadcast_if_small

#: Words to a seed; how often by chance one may be expected in all documents; runs of which the
#: rarest is a seed in any case.
SEED, EXPECTED, STRETCH = 3, 1.0, 5
#: Alignment scores of a match, another word, and a word too many or too few.
MATCH, OTHER, GAP = 2, -1, -1
#: What counts as contamination: this share of the aligned words equal, and this many of them, or
#: this share of a shorter item; and less likely by chance in all documents than 2^-BEYOND.
SIMILAR, ENOUGH, BEYOND = 0.8, 13, 10
#: Words to a piece of an item that is aligned at once; bytes of benchmark text to a slice.
PIECE, SLICE_BYTES = 400, 16 << 20
_TEXT_BYTES = 1 << 18
_FILTER_BITS = 20

RESULT = "doc_id long, row long, item_id long, score double, n_match long, n_item long, first_word long, last_word long"


def _bytes(text: str | None) -> bytes:
    """Lower case; words are runs of letters and digits, and of all that is not ASCII."""
    return (text or "").lower().encode()


@dataclass
class Passages:
    """A slice of the benchmark: pieces of items as words' numbers, and their seeds."""

    items: list[int | None] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    whole: list[bool] = field(default_factory=list)  # whether a piece is its item
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    bits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    total: int = 0
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    seed_piece: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    seed_at: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    filter: np.ndarray = field(default_factory=lambda: np.zeros(1 << _FILTER_BITS, dtype=bool))

    @classmethod
    def of(cls, rows: list) -> "Passages":
        self = cls()
        for row in rows:
            words = Words([_bytes(row["text"])], NOT_ALNUM).hashes()
            for k in range(0, len(words), PIECE):
                self.items.append(row["item_id"])
                self.words.append(words[k : k + PIECE])
                self.whole.append(len(words) <= PIECE)
        if self.words:
            self.vocabulary = np.unique(np.concatenate(self.words))
        return self

    def weigh(self, counts: np.ndarray, total: int) -> None:
        """Choose the seeds, given how often each word of the vocabulary occurs."""
        self.total = total
        self.bits = -np.log2((counts + 1) / (total + len(counts) + 1))
        needed = math.log2(max(total, 1) / EXPECTED)
        seeds, piece, at = [], [], []
        for k, words in enumerate(self.words):
            if len(words) < SEED:
                continue
            sums = np.convolve(self.information(words), np.ones(SEED), "valid")
            rarest = [j + int(np.argmax(sums[j : j + STRETCH])) for j in range(0, len(sums), STRETCH)]
            good = np.union1d(np.flatnonzero(sums >= needed), rarest).astype(np.int64)
            grams = gram_hashes(words, SEED)
            seeds.append(grams[good])
            piece.append(np.full(len(good), k))
            at.append(good)
        for n in range(1, SEED):  # items without a seed are looked for as they are
            own = [k for k, words in enumerate(self.words) if len(words) == n and self.whole[k]]
            if own:
                hashes = np.concatenate([gram_hashes(self.words[k], n) for k in own])
                order = np.argsort(hashes, kind="stable")
                self.short[n] = hashes[order], np.array(own)[order]
        if seeds:
            flat = np.concatenate(seeds)
            order = np.argsort(flat, kind="stable")
            self.seeds = flat[order]
            self.seed_piece, self.seed_at = np.concatenate(piece)[order], np.concatenate(at)[order]
            self.filter[(self.seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def information(self, words: np.ndarray) -> np.ndarray:
        return self.bits[np.searchsorted(self.vocabulary, words)]


def align(item: np.ndarray, words: np.ndarray, equal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The best local alignment: places of equal words in both, and its length with gaps.

    ``equal`` says which pairs of words may count as equal; by default all that are.
    """
    m, n = len(item), len(words)
    best = np.zeros((m + 1, n + 1), dtype=np.int32)
    slide = np.arange(n + 1, dtype=np.int32) * -GAP
    if equal is None:
        equal = item[:, None] == words[None, :]
    for i in range(1, m + 1):
        row = np.zeros(n + 1, dtype=np.int32)
        row[1:] = np.maximum(best[i - 1, :-1] + np.where(equal[i - 1], MATCH, OTHER), best[i - 1, 1:] + GAP)
        np.maximum(row, 0, out=row)
        best[i] = np.maximum.accumulate(row + slide) - slide
    i, j = np.unravel_index(int(best.argmax()), best.shape)
    ours, theirs, length = [], [], 0
    while best[i, j] > 0:
        length += 1
        if i and j and best[i, j] == best[i - 1, j - 1] + (MATCH if equal[i - 1, j - 1] else OTHER):
            i, j = i - 1, j - 1
            if equal[i, j]:
                ours.append(i)
                theirs.append(j)
        elif i and best[i, j] == best[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return np.array(ours[::-1], dtype=np.int64), np.array(theirs[::-1], dtype=np.int64), length


def similar_part(ours: np.ndarray, theirs: np.ndarray, bits: np.ndarray, enough: int, needed: float) -> tuple[int, int, int] | None:
    """The part of an alignment with the most equal words that is good enough: first, last, length.

    Between equal words an optimal alignment takes as many steps as the longer side has words. For
    each last word the earliest first word that leaves a share of SIMILAR is the best of its parts.
    """
    steps = np.concatenate([[0], np.cumsum(np.maximum(np.diff(ours), np.diff(theirs)))])
    level = np.arange(len(ours)) - SIMILAR * steps
    last = np.arange(len(ours))
    first = np.searchsorted(-np.minimum.accumulate(level), -(level + 1 - SIMILAR + 1e-9), "left")
    many, upto = last - first + 1, np.concatenate([[0.0], np.cumsum(bits)])
    good = np.flatnonzero((many >= enough) & (upto[last + 1] - upto[first] >= needed))
    if not len(good):
        return None
    b = int(good[np.argmax(many[good])])
    a = int(first[b])
    return a, b, int(steps[b] - steps[a]) + 1


def _windows(low: int, high: int, size: int) -> Iterator[tuple[int, int]]:
    """Parts of bounded width that overlap by what a good part of an alignment can span."""
    span = math.ceil(size / SIMILAR) + 2
    while high - low > 4 * span:
        yield low, low + 4 * span
        low += 3 * span
    yield low, high


def _judge(passages: Passages, piece: int, words: np.ndarray, places: np.ndarray, at: np.ndarray):
    """The longest good part of an alignment of a piece with the text around the seeds, if any.

    An alignment runs on beyond an exact part through words that are hardly alike, so every part of
    it is considered; and where it holds none that is longer than the best so far, so do further
    alignments that share no pair of words with it, as long as their scores allow for one.
    """
    item, best = passages.words[piece], None
    enough = min(ENOUGH, math.ceil(SIMILAR * len(item)))
    needed = math.log2(max(passages.total, 1)) + BEYOND
    worth = MATCH + OTHER * (1 / SIMILAR - 1)  # the least score of a good part to an equal word
    begins = places - at
    order = np.argsort(begins, kind="stable")
    cuts = np.flatnonzero(np.diff(begins[order]) > len(item)) + 1
    for group in np.split(order, cuts):
        low = max(0, int(begins[group[0]]) - len(item) // 4 - 2)
        high = min(len(words), int(begins[group[-1]]) + len(item) + len(item) // 4 + 2)
        for a, b in _windows(low, high, len(item)):
            if not ((places[group] >= a) & (places[group] < b)).any():
                continue
            equal = item[:, None] == words[None, a:b]
            while True:
                ours, theirs, length = align(item, words[a:b], equal)
                score = MATCH * len(ours) + OTHER * (length - len(ours))
                if not len(ours) or score < worth * max(enough, best[1] + 1 if best else 0):
                    break
                least = 0.0 if passages.whole[piece] and len(ours) == length == len(item) else needed
                part = similar_part(ours, theirs, passages.information(item[ours]), enough, least)
                if part and (best is None or part[1] - part[0] + 1 > best[1]):
                    first, last, span = part
                    n = last - first + 1
                    best = (n / span, n, a + int(theirs[first]), a + int(theirs[last]))
                equal[ours, theirs] = False
    return best


def _counted(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each word of the vocabulary occurs in all documents, and how many words these have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(vocabulary) + 1, dtype=np.int64), 0
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[(vocabulary >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        for batch in pieces(batches):
            texts = [_bytes(t) for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts], _TEXT_BYTES):
                words = Words(texts[a:b], NOT_ALNUM).hashes()
                total += len(words)
                words = words[seen[(words >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
                if len(vocabulary):
                    counts += np.bincount(at[vocabulary[at] == words], minlength=len(counts))
        counts[-1] = total
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    counts[rows["word"]] = rows["n"]
    return counts[:-1], int(counts[-1])


def _found(docs: DataFrame, passages: Passages) -> DataFrame:
    names = [c.split()[0] for c in RESULT.split(", ")]
    schema = pa.schema([(n, pa.float64() if n == "score" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [_bytes(t) for t in batch.column("text").to_pylist()]
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            out = [
                (ids[k], rows[k], *hit)
                for a, b in slices([len(t) for t in texts], _TEXT_BYTES)
                for k, hit in _hits(texts[a:b], a, passages)
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

    return docs.select("doc_id", "row", "text").mapInArrow(run, RESULT)


def _hits(texts: list[bytes], first: int, passages: Passages):
    """``k, (item_id, score, ...)`` for each text and item that it holds."""
    words = Words(texts, NOT_ALNUM)
    hashes = words.hashes()
    best: dict[tuple[int, int | None], tuple] = {}
    for size, (known, owner) in passages.short.items():
        grams = gram_hashes(hashes, size)
        left, right = (np.searchsorted(known, grams, side) for side in ("left", "right"))
        for at in np.flatnonzero(right > left):
            k = int(np.searchsorted(words.bounds, at, "right")) - 1
            if at + size <= words.bounds[k + 1]:
                for p in owner[left[at] : right[at]]:
                    best.setdefault((first + k, passages.items[p]), (1.0, size, size, int(at - words.bounds[k]), int(at - words.bounds[k]) + size - 1))
    grams = gram_hashes(hashes, SEED) if len(passages.seeds) else hashes[:0]
    at = np.flatnonzero(passages.filter[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    left = np.searchsorted(passages.seeds, grams[at], "left")
    many = np.searchsorted(passages.seeds, grams[at], "right") - left
    text = np.searchsorted(words.bounds, at, "right") - 1
    inside = (many > 0) & (at + SEED <= words.bounds[np.minimum(text + 1, len(words.bounds) - 1)])
    at, left, many, text = at[inside], left[inside], many[inside], text[inside]
    seed = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at, text = np.repeat(at, many), np.repeat(text, many)
    piece = passages.seed_piece[seed]
    order = np.lexsort((at, piece, text))
    at, text, piece, seed = at[order], text[order], piece[order], seed[order]
    cuts = np.flatnonzero(np.diff(text) | np.diff(piece)) + 1 if len(at) else []
    for group in np.split(np.arange(len(at)), cuts) if len(at) else []:
        k, p = int(text[group[0]]), int(piece[group[0]])
        low, high = words.bounds[k], words.bounds[k + 1]
        hit = _judge(passages, p, hashes[low:high], at[group] - low, passages.seed_at[seed[group]])
        key = (first + k, passages.items[p])
        if hit and (key not in best or hit[1] > best[key][1]):  # of equally long ones the first
            score, n, a, b = hit
            best[key] = (score, n, len(passages.words[p]), a, b)
    for (k, item), (score, *rest) in best.items():
        yield k, (item, score, *rest)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds, exactly or edited.

    ``score`` is the share of equal words in the alignment, ``n_match`` their number, ``n_item`` the
    words of the item (of the piece found, for items above PIECE words), ``first_word`` and
    ``last_word`` its place in the document. An item that stands whole and unchanged is always
    reported. Null and empty texts on either side give no row. Repeated documents are reported each,
    items of one id together by the place with the most equal words; of places that tie, one is
    told, always the same. Empty tables give an empty result.
    """
    named = docs.select("doc_id", row_hash(docs).alias("row"), "text")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // SLICE_BYTES + 1
    parts = []
    for k in range(n):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        passages = Passages.of(mine.select("item_id", "text").where("text is not null").collect())
        passages.weigh(*_counted(named, passages.vocabulary))
        parts.append(_found(named, passages))
    return reduce(DataFrame.union, parts)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that hold no benchmark passage, with their columns."""
    bad = broadcast_if_small(scratch.keep(contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id"), "row").distinct()))
    key = fresh(docs, "_row")
    named = docs.withColumn(key, row_hash(docs))
    return named.join(bad, (named[key] == bad["row"]) & named["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti").drop(key)
