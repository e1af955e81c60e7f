"""How filters interact: what each removes, loses and repeats in every order of applying them.

A document is the mask of the filters it fails. Equal masks are counted together, for each part of
the corpus, so that what is left are 2^k rows a part at most. An order is the vector of its filters'
positions, the inverse of the permutation. The step at which an order removes a mask is the min-plus
product of the mask matrix (0 where it fails, infinite elsewhere) with the position matrix: the
smallest position among the filters failed. Counts are scattered onto these steps.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.base import SPACE

WEIGHTS = ["n", "good", "toxic"]
_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def text_failures(text: Column) -> Column:
    """A number whose bits are the failures of the filters A to D over the whole text.

    A: under 50 words; B: distinct words under 65 % of the words; C: more than 5 % capitals A-Z;
    D: any of #$%&*|. Words are runs other than the six ASCII spaces; a null text is empty.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    bit = lambda failed, k: F.when(failed, 1 << k).otherwise(0)
    of_words = _let(
        words,
        lambda w: bit(F.size(w) < 50, 0) + bit(100 * F.size(F.array_distinct(w)) < 65 * F.size(w), 1),
    )
    upper = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return of_words + bit(100 * upper > 5 * F.length(text), 2) + bit(text.rlike(r"[#$%&*|]"), 3)


def audited(counts: DataFrame, names: str) -> DataFrame:
    """The audit of ``part, mask, n, good, toxic`` rows; bit k of a mask stands for ``names[k]``."""
    k = len(names)
    orders = ["".join(p) for p in permutations(names)]
    place = np.array([[o.index(c) + 1 for c in names] for o in orders])  # inverse permutations, from 1

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        masks = rows["mask"].to_numpy()
        fails = (masks[:, None] >> np.arange(k)) & 1 == 1
        # Min-plus product; a step beyond the last says that the mask is never removed.
        step = np.minimum((np.where(fails, 0, k + 1)[:, None, :] + place[None]).min(axis=2), k + 1)
        weights = [rows[w].to_numpy(np.int64) for w in WEIGHTS]
        order = np.broadcast_to(np.arange(len(orders)), step.shape)
        lost = []
        for w in weights:
            out = np.zeros((len(orders), k + 2), dtype=np.int64)
            np.add.at(out, (order, step), w[:, None])
            lost.append(out[:, 1 : k + 1])
        removed, good, toxic = lost
        redundant = np.zeros_like(removed)
        for f in range(k):
            late = fails[:, f][:, None] & (step < place[:, f][None])
            redundant[np.arange(len(orders)), place[:, f] - 1] = weights[0] @ late
        only = np.array([weights[0][masks == 1 << f].sum() for f in range(k)])
        shapley = np.array([removed[np.arange(len(orders)), place[:, f] - 1].sum() for f in range(k)])
        at = np.argsort(place, axis=1)  # the filter at each step
        return pd.DataFrame({
            "part": rows["part"].iloc[0], "filter_order": np.repeat(orders, k),
            "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
            "kept": (weights[0].sum() - removed.cumsum(axis=1)).ravel(), "removed": removed.ravel(),
            "redundant": redundant.ravel(), "unique_fails": only[at].ravel(), "good_lost": good.ravel(),
            "toxic_lost": toxic.ravel(), "shapley": shapley[at].ravel(),
        })

    total = counts.groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in WEIGHTS])
    return total.groupBy("part").applyInPandas(run, _SCHEMA)


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of each part fail just these filters.

    Bit 4 is E: the text equals that of any smaller doc_id of the whole table. Copies are counted
    before they meet: for each text, part and label one row with the smallest id and how often
    that id occurs is enough, so a text with a third of the rows is no large group.
    """
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), text_failures(F.col("text")).alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    once = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marked = once.join(marks, F.col("doc_id") == F.col("labelled"), "left").select(
        *once.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    )
    has_id = F.col("doc_id").isNotNull()
    grouped = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least"),
    )
    # A row for each part and label that has the text.
    first = grouped.groupBy(F.col("digest").alias("text")).agg(F.min("least.doc_id").alias("first"))
    known = grouped.join(first, F.col("digest") == F.col("text"))
    own = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    passing = F.col("nameless") + F.coalesce(own, F.lit(0))
    both = known.select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask").alias("mask"), passing.alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")),
        )).alias("x"),
    ).select("part", "x.mask", "x.n", *[F.when(F.col(c), F.col("x.n")).otherwise(0).alias(c) for c in ("good", "toxic")])
    return both.where("n > 0").groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in WEIGHTS])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over ``docs``: one row for each part, order and step.

    Null texts and sources count as empty. Rows without an id are no copies of any and have no
    labels. Repeated rows count as often as they occur; a row repeated with its id is no copy of
    itself. Labels that occur several times for an id count if any of them says 1; null labels say
    nothing. Tables without documents give an empty result.
    """
    return audited(masked(docs, labels), "ABCDE")
