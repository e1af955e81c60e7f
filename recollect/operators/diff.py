"""Comparing new chunks with stored ones by file and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import broadcast_if_small

UNCHANGED, MOVED, CREATED, STALE = "unchanged", "moved", "created", "stale"


def classify(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per new or stored chunk with its ``status``; no texts.

    ``chunks``: ``rel_path, ordinal, content_hash, start_line, end_line, unit, unit_kind, lang``.
    ``stored``: ``id, file_path, content_hash, line_start, line_end``. Equal texts within a
    file are paired one to one, in order; what is left over on either side is created or
    stale. Texts are only compared by hash and never exchanged.
    """
    place = Window.partitionBy("rel_path", "content_hash")
    fresh = chunks.select(
        "rel_path", "content_hash", "ordinal", "start_line", "end_line", "unit", "unit_kind", "lang"
    ).withColumn("n", F.row_number().over(place.orderBy("ordinal")))
    known = stored.select(
        F.col("file_path").alias("rel_path"), "content_hash", "id", "line_start", "line_end"
    ).withColumn("n", F.row_number().over(place.orderBy("id")))
    both = fresh.join(known, ["rel_path", "content_hash", "n"], "full_outer")
    same_place = (F.col("start_line") == F.col("line_start")) & (F.col("end_line") == F.col("line_end"))
    status = (
        F.when(F.col("id").isNull(), CREATED)
        .when(F.col("ordinal").isNull(), STALE)
        .when(F.coalesce(same_place, F.lit(False)), UNCHANGED)
        .otherwise(MOVED)
    )
    return both.select(
        "rel_path", "content_hash", status.alias("status"), "id", "ordinal", "start_line", "end_line", "unit", "unit_kind", "lang"
    )


def with_texts(created: DataFrame, chunks: DataFrame) -> DataFrame:
    """``created`` rows with their ``content`` from ``chunks``; no other text is looked at again."""
    wanted = broadcast_if_small(created)
    return chunks.select("rel_path", "ordinal", "content").join(wanted, ["rel_path", "ordinal"])


def file_changes(diff: DataFrame) -> DataFrame:
    """Per file: chunk counts by status and whether the file was seen in this run."""

    def of(status: str):
        return F.count_if(F.col("status") == status).alias(status)

    return diff.groupBy("rel_path").agg(
        *[of(s) for s in (CREATED, MOVED, UNCHANGED, STALE)], F.count_if(F.col("status") != STALE).alias("chunks")
    )


def totals(changes: DataFrame) -> DataFrame:
    """The counters of a run in one row."""
    seen = F.col("chunks") > 0
    touched = F.col(CREATED) + F.col(MOVED) + F.col(STALE) > 0

    def total(name: str, alias: str):
        return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(alias)

    return changes.agg(
        F.count_if(seen).alias("filesScanned"),
        F.count_if(seen & touched).alias("filesChanged"),
        F.count_if(~seen).alias("filesDeleted"),
        total(CREATED, "chunksCreated"),
        total(MOVED, "chunksUpdated"),
        total(UNCHANGED, "chunksUnchanged"),
        total(STALE, "chunksDeleted"),
        total("chunks", "totalChunks"),
    )


def stale_chunks(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored chunks whose text their file no longer has."""
    fresh = chunks.select(F.col("rel_path").alias("file_path"), "content_hash")
    return stored.join(fresh, ["file_path", "content_hash"], "left_anti")


def vanished_files(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored file paths that the new run has not seen."""
    fresh = chunks.select(F.col("rel_path").alias("file_path"))
    return stored.select("file_path").where(F.col("file_path").isNotNull()).distinct().join(fresh, "file_path", "left_anti")


def by_language(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("lang").agg(F.count("*").alias("chunks"))
