"""Keyed and ordered reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_first(
    rows: DataFrame, limit: int, tag: str | None = None, kind: str | None = None, after: tuple[dt.datetime, int] | None = None
) -> DataFrame:
    """The ``limit`` newest rows by ``created_at, id``; filters apply before the limit.

    The tag is compared without regard to case. ``after`` is the key ``created_at, id`` of the last
    row of a page: the next page begins there, however many come before. The bound on the time
    reaches the Parquet scan, so files and row groups that are all newer are not read.
    """
    if after is not None:
        at, id = F.lit(after[0]), after[1]
        rows = rows.where((F.col("created_at") <= at) & ((F.col("created_at") < at) | (F.col("id") < id)))
    if tag:
        rows = rows.where(F.exists("tags", lambda t: F.lower(t) == tag.strip().lower()))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def by_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows for ``wanted(pos, id)`` in the caller's order; ids that do not exist are left out."""
    return rows.join(wanted, "id").orderBy("pos")
