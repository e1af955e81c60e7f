"""Incremental ingestion: chunk, compare with what is stored, embed what is new."""

from __future__ import annotations

import os
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.embedding import Embedder
from recollect.functions.text import content_hash, embed_text
from recollect.operators.diff import CREATED, MOVED, STALE, by_language, classify, file_changes, totals, with_texts
from recollect.schema import KIND_CODE
from recollect.session import Scratch
from recollect.sources.chunker import ChunkOptions, chunk_code_files, chunk_files, chunk_text_files, is_code
from recollect.sources.state import FileState, stored_chunks
from recollect.sources.store import MemoryStore
from recollect.operators.numbering import first_rows
from recollect.sources.walk import listing, read_contents, walk


def hashed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_hash", content_hash(F.col("content")))


def new_rows(diff: DataFrame, chunks: DataFrame) -> DataFrame:
    """Table rows, still without id and vector, for the created chunks."""
    unit = F.col("unit")
    return with_texts(diff.where(F.col("status") == CREATED), chunks).select(
        F.lit(KIND_CODE).alias("kind"),
        F.col("content").alias("text"),
        F.when(unit != "", F.array("unit_kind", "unit")).otherwise(F.array("unit_kind")).alias("tags"),
        F.col("rel_path").alias("file_path"),
        F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"),
        "content_hash",
        "ordinal",
        embed_text(
            F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("unit_kind"), unit, F.col("content")
        ).alias("embed_text"),
    )


def stored_rows(diff: DataFrame, status: str) -> DataFrame:
    """Ids of stored chunks with this status, and where they are now."""
    return diff.where(F.col("status") == status).select(
        "id",
        F.col("rel_path").alias("file_path"),
        F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"),
    )


def ingest_files(
    store: MemoryStore,
    project: str,
    files: DataFrame,
    embedder: Embedder,
    options: ChunkOptions = ChunkOptions(),
    dry_run: bool = False,
    path_prefix: str | None = None,
) -> dict:
    """Bring ``project`` in line with ``files(rel_path, content)``, the whole of its source.

    Stored files that ``files`` lacks are deleted; ``path_prefix`` limits that to
    paths below it. Unchanged text keeps its row, vector and id wherever it moves.
    """
    twice = files.groupBy("rel_path").count().where("count > 1").select("rel_path").first()
    if twice is not None:  # which content counts can't be told
        raise ValueError(f"several files of one path: {twice.rel_path}")
    return ingest_chunks(store, project, chunk_files(files, options), embedder, dry_run, path_prefix)


def ingest_chunks(
    store: MemoryStore,
    project: str,
    chunks: DataFrame,
    embedder: Embedder,
    dry_run: bool = False,
    path_prefix: str | None = None,
    only_files: DataFrame | None = None,
    unread: DataFrame | None = None,
) -> dict:
    """As ``ingest_files`` for ready chunks. With ``only_files(rel_path)`` stored files
    outside it are left alone; so are the files of ``unread(rel_path)``, of which is only
    known that they exist."""
    stored = stored_chunks(store.rows(project), path_prefix)
    if only_files is not None:
        stored = stored.join(only_files.select(F.col("rel_path").alias("file_path")), "file_path", "left_semi")
    if unread is not None:
        stored = stored.join(unread.select(F.col("rel_path").alias("file_path")), "file_path", "left_anti")
    with Scratch(store.spark) as scratch:
        known = scratch.keep(hashed(chunks))
        diff = scratch.keep(classify(known, stored))
        summary = totals(file_changes(diff)).first().asDict()
        languages = by_language(diff.where(F.col("status") != STALE)).orderBy("lang").collect()
        summary["byLanguage"] = {r.lang: r.chunks for r in languages}
        summary["chunksEmbedded"] = 0
        spent = store.spark.sparkContext.accumulator(0.0)
        if not dry_run:
            summary["chunksEmbedded"] = store.apply(
                project,
                inserts=new_rows(diff, known) if summary["chunksCreated"] else None,
                updates=stored_rows(diff, MOVED) if summary["chunksUpdated"] else None,
                deletes=stored_rows(diff, STALE) if summary["chunksDeleted"] else None,
                embedder=embedder,
                scratch=scratch,
                spent=spent,
            )
        summary["embedMs"] = round(spent.value)
        return summary


def ingest_tree(
    store: MemoryStore,
    project: str,
    root: str,
    embedder: Embedder,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    respect_gitignore: bool = True,
    max_file_bytes: int | None = None,
    max_files: int | None = None,
    options: ChunkOptions = ChunkOptions(),
    dry_run: bool = False,
    path_prefix: str | None = None,
) -> dict:
    """``ingest_files`` for a directory. A file that is now binary or filtered out counts as gone.
    A file that a limit of the caller's keeps from being read (``max_file_bytes``, ``max_files``)
    is unknown: what is stored of it stays. A file whose size and times are those of the last run,
    and whose stored chunks are what that run left, is not read again."""
    started, listed_at = time.monotonic(), time.time_ns()
    found = walk(store.spark, root, respect_gitignore, include, exclude)
    with Scratch(store.spark) as scratch:
        found, unread = scratch.keep(found), None
        if max_files is not None or max_file_bytes is not None:
            every = found
            found = every if max_files is None else scratch.keep(first_rows(every, [F.col("rel_path")], max_files))
            fitting = found if max_file_bytes is None else found.where(F.col("size") <= max_file_bytes)
            unread = scratch.keep(every.join(fitting.select("rel_path"), "rel_path", "left_anti").select("rel_path"))
        state = FileState(store, project, root, options)
        known = state.unchanged(found, scratch)
        rest = found
        for settled in (known, unread):
            rest = rest if settled is None else rest.join(settled, "rel_path", "left_anti")
        listed, n_rest = listing(rest, scratch)
        same = unchanged_totals(known)
        if known is not None and not n_rest and not state.vanished(found, unread, path_prefix):
            counted = same
        else:
            # Paths are parted before contents are read, so each file is read once.
            in_code = is_code(F.col("rel_path"))
            code, text = (read_contents(listed.where(c), root, max_file_bytes) for c in (in_code, ~in_code))
            chunks = chunk_text_files(text, options).unionByName(chunk_code_files(code, options))
            left = [t.select("rel_path") for t in (unread, known) if t is not None]
            alone = reduce(DataFrame.unionAll, left).distinct() if left else None
            counted = together(same, ingest_chunks(store, project, chunks, embedder, dry_run, path_prefix, unread=alone))
            if not dry_run:
                state.save(found if max_file_bytes is None else found.where(F.col("size") <= max_file_bytes), listed_at, scratch)
        n_listed = found.count()
    return {
        "root": os.path.abspath(root),
        "project": project,
        "dryRun": dry_run,
        "filesSkipped": n_listed - counted["filesScanned"],
        **counted,
        "elapsedMs": round(1000 * (time.monotonic() - started)),
    }


#: The counters of a run that finds nothing to do, in the order in which they are told.
_COUNTERS = [
    "filesScanned", "filesChanged", "filesDeleted", "chunksCreated", "chunksUpdated", "chunksUnchanged", "chunksDeleted",
    "totalChunks",
]


def unchanged_totals(known: DataFrame | None) -> dict:
    """The counters of files that were not read: ``chunks`` are what is stored of each."""
    rows = [] if known is None else known.groupBy("lang").agg(
        F.count_if(F.col("chunks") > 0).alias("files"), F.sum("chunks").alias("chunks")
    ).where("chunks > 0").orderBy("lang").collect()
    chunks = sum(r.chunks for r in rows)
    counted = dict.fromkeys(_COUNTERS, 0) | {"filesScanned": sum(r.files for r in rows), "chunksUnchanged": chunks, "totalChunks": chunks}
    return {**counted, "byLanguage": {r.lang: r.chunks for r in rows}, "chunksEmbedded": 0, "embedMs": 0}


def together(a: dict, b: dict) -> dict:
    """Two sets of counters added up."""
    languages = {lang: a["byLanguage"].get(lang, 0) + b["byLanguage"].get(lang, 0) for lang in sorted({*a["byLanguage"], *b["byLanguage"]})}
    return {k: languages if k == "byLanguage" else a[k] + v for k, v in b.items()}
