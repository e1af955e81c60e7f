"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document gets a virtual finish time: the words of its source up to and including it, in
shuffled order, divided by the source's target. A second pass over the source goes on counting
where the first ended. All passes of all documents in order of finish time, cut where the words
taken would exceed the total budget, are the mix.

Running sums never put a source or the whole corpus into one task. Within a source they are a
radix tree over the shuffle key: sums of 256 groups, of 256 groups within each, and a window over
the rows of one of the 65,536. The cut is found the same way, by three histograms of the finish
time with 4,096 bins each and a sort of the few passes within the last bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.base import WORD, Scratch, fresh, quoted, row_hash

#: Weights dealt to the sources in code point order, again and again.
WEIGHTS = (5, 2, 1)
#: The budget as a share of all words, and how often a source may be read.
SHARE, EPOCHS = 1.5, 2
#: The cut is searched in levels of 2^12 bins.
_BITS, _LEVELS = 12, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source, source_size, target`` for ``source, size`` rows, one row per source.

    Targets share ``share`` of all words by weight; none exceeds EPOCHS times its source, and what
    is cut off goes to the others by weight. That is a water level: with the sources in order of
    cap over weight, the first sources stay at their caps and the rest share what is left.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = totals.withColumn("weight", weight).withColumn("cap", EPOCHS * F.col("source_size"))
    tight = Window.orderBy(
        (F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    )
    whole = tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(whole) * share
    level = (budget - before) / rest
    # The level falls due at the first source whose cap it does not exceed; earlier ones are full.
    leveled = capped.withColumn("level", level)
    due = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True)
    cap = F.col("cap").cast("double")
    target = F.coalesce(F.least(cap, due.over(whole) * F.col("weight")), cap)
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def virtual_times(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` of ``source, size, shuffle`` with ``before`` and its source's figures.

    ``reached`` counts the words of the source up to and including the row, in order of
    ``shuffle``, a hexadecimal string; equal keys go by document, then size.
    """
    keyed = rows.withColumn("b1", F.substring("shuffle", 1, 2)).withColumn("b2", F.substring("shuffle", 3, 2))
    order = [F.col("shuffle"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("row")]
    within = Window.partitionBy("source", "b1", "b2").orderBy(*order)
    running = keyed.withColumn("reached", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))

    leaves = keyed.groupBy("source", "b1", "b2").agg(F.sum("size").alias("n"))
    branches = keyed.groupBy("source", "b1").agg(F.sum("size").alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    leaf_start = F.coalesce(
        F.sum("n").over(Window.partitionBy("source", "b1").orderBy("b2").rowsBetween(*earlier)), F.lit(0)
    )
    branch_start = F.coalesce(
        F.sum("n").over(Window.partitionBy("source").orderBy("b1").rowsBetween(*earlier)), F.lit(0)
    )
    starts = (
        leaves.select(F.col("source").alias("s"), F.col("b1").alias("c1"), F.col("b2").alias("c2"), leaf_start.alias("p2"))
        .join(
            branches.select(F.col("source").alias("t"), F.col("b1").alias("d1"), branch_start.alias("p1")),
            F.col("s").eqNullSafe(F.col("t")) & (F.col("c1") == F.col("d1")),
        )
        .join(
            wanted.select(F.col("source").alias("u"), "source_size", "target"), F.col("s").eqNullSafe(F.col("u"))
        )
        .select("s", "c1", "c2", (F.col("p1") + F.col("p2")).alias("start"), "source_size", "target")
    )
    return running.join(
        starts,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2")),
    ).select(
        "doc_id", "row", "source", "shuffle", "size", "source_size", "target",
        (F.col("reached") + F.col("start")).alias("reached"),
    )


def _finish(epoch: Column) -> Column:
    return (F.col("reached") + epoch * F.col("source_size")) / F.col("target")


def _tick(finish: Column) -> Column:
    """The finish time as a whole number of 36 bits; what lies beyond shares the last."""
    return F.least(F.ceil(finish * F.lit(float(1 << 23))), F.lit((1 << _BITS * _LEVELS) - 1)).cast("long")


def _passes(timed: DataFrame) -> DataFrame:
    """A row for each document and pass over its source, with the finish time."""
    return (
        timed.where(F.col("size") > 0)
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
        .withColumn("finish", _finish(F.col("epoch")))
        .withColumn("tick", _tick(F.col("finish")))
    )


def _cut(passes: DataFrame, budget: float) -> tuple[int | None, int]:
    """The tick in which the budget ends, and the words taken before it.

    Three numbers reach the driver for each level, whatever the input. No tick: all is taken.
    """
    prefix, taken = 0, 0
    for level in range(_LEVELS - 1, -1, -1):
        mine = passes.where(F.shiftright("tick", _BITS * (level + 1)) == prefix)
        bins = mine.groupBy(F.shiftright("tick", _BITS * level).alias("bin")).agg(F.sum("size").alias("n"))
        running = bins.withColumn("upto", F.sum("n").over(Window.orderBy("bin")) + taken)
        over = running.where(F.col("upto") > budget).agg(F.min(F.struct("bin", "upto", "n")).alias("m")).first()["m"]
        if over is None:
            return None, taken
        prefix, taken = over["bin"], over["upto"] - over["n"]
    return prefix, taken


def mix(timed: DataFrame, budget: float) -> DataFrame:
    """``timed`` rows with ``copies``, how often the mix takes the document: 0, 1 or 2."""
    passes = _passes(timed)
    tick, taken = _cut(passes, budget)
    earlier = F.lit(0)
    for epoch in range(EPOCHS):
        inside = F.lit(True) if tick is None else _tick(_finish(F.lit(epoch))) < tick
        earlier = earlier + F.when((F.col("size") > 0) & inside, 1).otherwise(0)
    if tick is None:
        return timed.withColumn("copies", earlier)
    # The passes that end within the last tick, a few out of 2^23, are sorted.
    order = Window.orderBy(
        "finish", F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "epoch", "size", "row", "reached"
    )
    last = (
        passes.where(F.col("tick") == tick)
        .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + taken)
        .where(F.col("upto") <= budget)
        .groupBy(F.col("row").alias("last_row"), F.col("reached").alias("last_reached"))
        .agg(F.count("*").alias("more"))
    )
    same = (F.col("row") == F.col("last_row")) & (F.col("reached") == F.col("last_reached"))
    copies = (earlier + F.coalesce("more", F.lit(0))).cast("int")
    return timed.join(last, same, "left").withColumn("copies", copies).drop("last_row", "last_reached", "more")


def mixed(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 17) -> DataFrame:
    """``doc_id, row, source, size, source_size, target, copies`` of every row of ``docs``.

    ``row`` is the hash of the whole row. Null texts have no words; documents without words are
    never taken. A null source is a source of its own, last in order. Wholly equal rows take their
    turns one after another. An empty table gives an empty result.
    """
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = scratch.keep(
        docs.select(
            "doc_id", row_hash(docs).alias("row"), "source", word_count(F.col("text")).alias("size"), shuffle.alias("shuffle")
        )
    )
    wanted = targets(rows, weights, share)
    timed = scratch.keep(virtual_times(rows, wanted))
    total = rows.agg(F.sum("size")).first()[0] or 0
    return mix(timed, total * share)


def mix_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents of the mix with their columns, each as often as it is taken."""
    named = docs.withColumn(key := fresh(docs, "_row"), row_hash(docs))
    decided = mixed(docs, scratch, **options).where("copies > 0").groupBy(F.col("row").alias("mix_row")).agg(
        F.sum("copies").cast("int").alias("mix_copies")
    )
    names = [quoted(c) for c in docs.columns]
    return (
        named.dropDuplicates([key])
        .select(F.struct(*names).alias("kept"), F.col(key).alias("kept_row"))
        .join(decided, F.col("kept_row") == F.col("mix_row"))
        .select("kept", F.explode(F.sequence(F.lit(1), "mix_copies")))
        .select("kept.*")
    )
