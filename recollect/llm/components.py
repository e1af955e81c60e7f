"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.base import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = both.where("b > a")
    return larger.join(least, larger["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = down.join(least, down["a"] == least["n"])
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    )


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``), ``root`` the smallest node it reaches.

    Steps repeat until the stars no longer change; each is two joins and a distinct over the links,
    and two numbers reach the driver to tell. Links from a node to itself are ignored.
    """
    tidy = lambda df: df.where("a <> b").distinct()
    now, seen = scratch.keep(tidy(links)), None
    while True:
        stars = scratch.keep(tidy(_small_star(_large_star(now))))
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, seen = stars, mark
