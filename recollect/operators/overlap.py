"""How many other chunks of the same file each chunk's line range overlaps.

Two inclusive ranges overlap unless one starts after the other ends, so the count
is (ranges that start by my end) - (ranges that end before my start) - 1. Both are
running counts over positions: nothing is paired, and equal positions are summed
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions summed together, so that one large file is not one window.
POSITIONS_PER_BLOCK = 1024


def overlap_counts(chunks: DataFrame) -> DataFrame:
    """``chunks(id, file_path, line_start, line_end)`` plus ``overlaps``.

    Rows without a path or a complete range overlap nothing and count 0.
    """
    placed = F.col("file_path").isNotNull() & F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
    ranges = chunks.where(placed)
    # A range opens at its start and has closed just after its end.
    points = ranges.select(
        "file_path",
        F.inline(
            F.array(
                F.struct(F.col("line_start").alias("at"), F.lit(1).alias("opened"), F.lit(0).alias("closed")),
                F.struct((F.col("line_end") + 1).alias("at"), F.lit(0).alias("opened"), F.lit(1).alias("closed")),
                F.struct(F.col("line_end").alias("at"), F.lit(0).alias("opened"), F.lit(0).alias("closed")),
            )
        ),
    )
    summed = (
        points.groupBy("file_path", "at")
        .agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
        .withColumn("block", F.floor(F.col("at") / POSITIONS_PER_BLOCK))
    )
    by_block = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        summed.groupBy("file_path", "block")
        .agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
        .select(
            "file_path",
            "block",
            F.coalesce(F.sum("opened").over(by_block), F.lit(0)).alias("opened_before"),
            F.coalesce(F.sum("closed").over(by_block), F.lit(0)).alias("closed_before"),
        )
    )
    within = (
        Window.partitionBy("file_path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = summed.join(blocks, ["file_path", "block"]).select(
        "file_path",
        "at",
        (F.col("opened_before") + F.sum("opened").over(within)).alias("opened"),
        (F.col("closed_before") + F.sum("closed").over(within)).alias("closed"),
    )
    at_end = running.select("file_path", F.col("at").alias("line_end"), "opened")
    at_start = running.select("file_path", F.col("at").alias("line_start"), "closed")
    counted = (
        ranges.join(at_end, ["file_path", "line_end"])
        .join(at_start, ["file_path", "line_start"])
        .select(*chunks.columns, (F.col("opened") - F.col("closed") - 1).alias("overlaps"))
    )
    return counted.unionByName(chunks.where(~placed).withColumn("overlaps", F.lit(0).cast("long")))


def overlap_pairs(ranges: DataFrame, id_column: str, keys: list[str], width: int | None = None) -> DataFrame:
    """``a, b``: ids of rows with equal ``keys`` whose ranges ``line_start .. line_end`` overlap, ``a < b``.

    Ranges are dealt into bins of ``width`` lines, by default the average length. Two ranges that
    overlap share the bin in which the later one starts, and are a pair there alone. Rows without a
    complete range, or with an end before the start, overlap nothing.
    """
    placed = ranges.where((F.col("line_start") <= F.col("line_end")) & F.col(id_column).isNotNull())
    if width is None:
        mean = placed.agg(F.avg(F.col("line_end").cast("long") - F.col("line_start") + 1)).first()[0]
        width = max(1, round(mean or 1))
    start, end = (F.floor(F.col(c) / width) for c in ("line_start", "line_end"))
    binned = placed.select(
        F.col(id_column).alias("id"), *keys, "line_start", "line_end", start.alias("first"), F.explode(F.sequence(start, end)).alias("bin")
    )
    # Each pair where the later range starts: one side is in its first bin.
    later = binned.where(F.col("bin") == F.col("first")).select(*[F.col(c).alias(f"l_{c}") for c in ("id", *keys, "line_start", "bin")])
    same = [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys] + [F.col("bin") == F.col("l_bin")]
    earlier = (F.col("line_start") < F.col("l_line_start")) | ((F.col("line_start") == F.col("l_line_start")) & (F.col("id") < F.col("l_id")))
    met = binned.join(later, [*same, earlier, F.col("line_end") >= F.col("l_line_start")])
    return met.select(F.least("id", "l_id").alias("a"), F.greatest("id", "l_id").alias("b"))
