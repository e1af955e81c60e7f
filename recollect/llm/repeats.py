"""Passages of WINDOW words that repeat across documents, located with Aho-Corasick automata.

1. Every document chooses phrases of PHRASE words such that each of its windows holds one, and
   equal windows hold the same one (the phrases with the smallest hash of each window). Phrases
   chosen by two documents or more recur; a grouped aggregation confirms them.
2. Documents that hold a recurring phrase are dealt to blocks of bounded size, and with them the
   recurring phrases of the block. The phrases of a block become one automaton, each word a
   letter, and the block's documents run through it: it locates every occurrence of every phrase.
3. The windows whose own phrase was located, the only ones that can recur, go out as 128-bit hashes. The
   smallest document of each hash decides which windows of the others are removed.

Automata are sharded along with the documents, so each document is read against one automaton
only, whatever the number of phrases. Wholly equal texts are settled before step 1: all words of
a later copy are covered by windows of the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.base import Scratch, row_hash
from recollect.llm.words import Words, gram_hashes, pieces, slices
from recollect.session import broadcast_if_small

WINDOW, PHRASE = 50, 8
#: Bytes of text to a block, and to a piece that is hashed at once.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 1 << 18
#: Removed stretches that may be broadcast.
BROADCAST_ROWS = 500_000
#: Order of documents without an id: after all others.
_LAST = (1 << 63) - 1


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``size`` consecutive values."""
    span = 1
    while span < size:
        step = min(span, size - span)
        x = best(x[:-step], x[step:])
        span += step
    return x


def chosen_phrases(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the phrases that one text's words choose; none below WINDOW words."""
    grams, size = gram_hashes(words, PHRASE), WINDOW - PHRASE + 1
    if len(words) < WINDOW:
        return np.zeros(0, dtype=np.int64), grams[:0]
    least = _sliding(grams, size, np.minimum)
    pad = np.zeros(size - 1, dtype=np.uint64)
    reach = _sliding(np.concatenate([pad, least, pad]), size, np.maximum)  # of all windows around a phrase
    at = np.flatnonzero(reach == grams)
    return at, grams[at]


def _texts(column) -> list[bytes]:
    return [(t or "").encode() for t in column]


def _each(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """The number and the words' hashes of every text."""
    for a, b in slices([len(t) for t in texts], PIECE_BYTES):
        words = Words(texts[a:b])
        hashes = words.hashes()
        for k in range(b - a):
            yield a + k, hashes[words.bounds[k] : words.bounds[k + 1]]


def phrases(docs: DataFrame) -> DataFrame:
    """``phrase, row, place`` for the phrases that every document chooses, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, places = batch.column("row").to_pylist(), batch.column("place").to_pylist()
            found, owner = [], []
            for k, words in _each(_texts(batch.column("text").to_pylist())):
                mine = np.unique(chosen_phrases(words)[1])
                found.append(mine)
                owner.append(np.full(len(mine), k))
            at = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
            phrase = np.concatenate(found).view(np.int64) if found else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(phrase), pa.array(np.array(rows, dtype=np.int64)[at]), pa.array(np.array(places, dtype=np.int64)[at])],
                ["phrase", "row", "place"],
            )

    return docs.select("row", "place", "text").mapInArrow(run, "phrase long, row long, place long")


def _letters(words: np.ndarray) -> str:
    """A letter for each word. Different words may share one, which later steps sort out."""
    return (words % np.uint64(1_000_000) + np.uint64(0x10000)).astype("<u4").tobytes().decode("utf-32-le")


def _located(docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """The windows of a block's documents that hold one of the wanted phrases."""
    import ahocorasick

    names = ["h1", "h2", "row", "place", "at", "more"]
    recurring = np.sort(wanted["phrase"].to_numpy(np.int64)).view(np.uint64)
    recurring.sort()
    texts = list(_each(_texts(docs["text"])))
    automaton, known = ahocorasick.Automaton(), set()
    for _, words in texts:
        at, hashes = chosen_phrases(words)
        if not len(at):
            continue
        place = np.minimum(np.searchsorted(recurring, hashes), max(len(recurring) - 1, 0))
        hit = recurring[place] == hashes if len(recurring) else np.zeros(len(at), dtype=bool)
        new = [(a, h) for a, h in zip(at[hit].tolist(), hashes[hit].tolist()) if h not in known]
        known.update(h for _, h in new)
        for a, _ in new:
            automaton.add_word(_letters(words[a : a + PHRASE]), True)
    none = pd.DataFrame({n: np.zeros(0, dtype=object if n == "more" else np.int64) for n in names})
    if not known:
        return none
    automaton.make_automaton()
    rows, places, out = docs["row"].to_numpy(np.int64), docs["place"].to_numpy(np.int64), []
    for k, words in texts:
        if len(words) < WINDOW:
            continue
        ends = np.fromiter((end for end, _ in automaton.iter(_letters(words))), dtype=np.int64)
        if not len(ends):
            continue
        # A window can only recur if the phrase that it chooses is among those located.
        grams = gram_hashes(words, PHRASE)
        least = _sliding(grams, WINDOW - PHRASE + 1, np.minimum)
        at = np.flatnonzero(np.isin(least, np.unique(grams[ends - PHRASE + 1])))
        h1, h2 = gram_hashes(words, WINDOW)[at], gram_hashes(words, WINDOW, 0xD6E8FEB86659FD93)[at]
        # Windows that a document repeats are one row, so that no hash has more rows than documents.
        order = np.lexsort((at, h2, h1))
        h1, h2, at = h1[order], h2[order], at[order]
        heads = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[: len(at)]
        sizes, more = np.diff(np.r_[heads, len(at)]), np.full(len(heads), None, dtype=object)
        for j in np.flatnonzero(sizes > 1):
            more[j] = at[heads[j] + 1 : heads[j] + sizes[j]]
        n = len(heads)
        out.append((h1[heads].view(np.int64), h2[heads].view(np.int64), np.full(n, rows[k]), np.full(n, places[k]), at[heads], more))
    if not out:
        return none
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*out))})


def removals(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``row, spans, whole``: what to remove from each document that loses any words.

    ``spans`` are stretches ``first, last`` of words, both included, by the words' numbers from 0.
    ``whole`` marks later copies of a whole text, which lose all words if these fill a window.
    ``docs`` has ``row, place, text``; documents of one place do not remove each other's words.
    """
    texts = scratch.keep(docs.select("row", "place", F.md5("text").alias("digest"), F.octet_length("text").alias("size")))
    # What is joined by a key that many rows may share is kept first: then both sides are plain
    # exchanges, of which Spark splits the large partitions.
    first = texts.groupBy(F.col("digest").alias("d")).agg(F.min("place").alias("p"), F.max("place").alias("q")).where("p < q")
    first = scratch.keep(first)
    copies = scratch.keep(
        texts.join(first, F.col("digest") == F.col("d")).where("place > p").select(F.col("row").alias("copy")).distinct()
    )
    once = docs.join(broadcast_if_small(copies), F.col("row") == F.col("copy"), "left_anti")

    held = scratch.keep(phrases(once))
    recurring = held.groupBy(F.col("phrase").alias("p")).agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b")
    recurring = scratch.keep(recurring)
    wanted = scratch.keep(held.join(recurring, F.col("phrase") == F.col("p")).select("phrase", "row"))
    total = texts.agg(F.sum("size")).first()[0] or 0
    block = F.pmod(F.col("row"), F.lit(total // BLOCK_BYTES + 1))
    holders = broadcast_if_small(scratch.keep(wanted.select(F.col("row").alias("holder")).distinct()))
    chosen = once.join(holders, F.col("row") == F.col("holder"), "left_semi").select("row", "place", "text", block.alias("block"))
    dealt = wanted.select("phrase", block.alias("block")).distinct()
    windows = scratch.keep(
        chosen.groupBy("block").cogroup(dealt.groupBy("block")).applyInPandas(
            _located, "h1 long, h2 long, row long, place long, at long, more array<long>"
        )
    )
    least = windows.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(
        F.min("place").alias("a"), F.max("place").alias("b")
    ).where("a < b")
    least = scratch.keep(least)
    hits = windows.join(least, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where("place > a")
    every = F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<bigint>")))
    starts = hits.select("row", F.explode(every).alias("at")).distinct()
    # Windows that touch or overlap make one stretch.
    order = Window.partitionBy("row").orderBy("at")
    apart = (F.col("at") - F.lag("at").over(order) > WINDOW).cast("int")
    stretch = F.sum(F.coalesce(apart, F.lit(0))).over(order)
    spans = starts.withColumn("stretch", stretch).groupBy("row", "stretch").agg(
        F.min("at").alias("first"), (F.max("at") + WINDOW - 1).alias("last")
    )
    merged = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"), F.lit(False).alias("whole"))
    return scratch.keep(merged.union(copies.select("copy", F.lit(None).cast(merged.schema["spans"].dataType), F.lit(True))))


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with its row's identity and the place of its id in the order of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", row_hash(docs).alias("row"), F.coalesce("doc_id", F.lit(_LAST)).alias("place"), text.alias("text"))


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row; ``kept`` are the words left, space-joined.

    A null text has no words. Texts below WINDOW words lose none. Documents without an id count as
    later than all others, and like repeated ids do not remove each other's words. Spans are judged
    on the input. An empty table gives an empty result.
    """
    rows = named(docs)
    removed = removals(rows, scratch)
    small = removed.agg(F.sum(F.coalesce(F.size("spans"), F.lit(1)))).first()[0] or 0
    removed = removed.withColumnRenamed("row", "removed_row")
    if small <= BROADCAST_ROWS:
        removed = F.broadcast(removed)
    joined = rows.join(removed, F.col("row") == F.col("removed_row"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n_words, n_removed, kept = [], [], []
            for text, spans, whole in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "whole"))):
                words = text.encode().split()
                n_words.append(len(words))
                if whole:
                    words = [] if len(words) >= WINDOW else words
                for span in sorted(spans or [], key=lambda s: -s["first"]):
                    del words[span["first"] : span["last"] + 1]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.select("doc_id", "text", "spans", "whole").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string"
    )
