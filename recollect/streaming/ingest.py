"""Incremental ingestion as a stream: each micro-batch holds files that changed.

A batch is compared with the stored chunks of its own files only, by the same diff as a
full run. A batch that is run again after a failure finds its chunks stored and changes
nothing, so every file is applied once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.functions.embedding import Embedder
from recollect.plans.ingest import ingest_chunks
from recollect.session import Scratch
from recollect.sources.chunker import ChunkOptions, chunk_files
from recollect.sources.store import MemoryStore


def apply_changes(
    store: MemoryStore, project: str, changed: DataFrame, embedder: Embedder, options: ChunkOptions = ChunkOptions()
) -> dict:
    """Bring the files in ``changed(rel_path, content, seq)`` up to date; a file is removed by
    a null or blank ``content``. Of several versions in one batch the highest ``seq`` counts."""
    newest = changed.groupBy("rel_path").agg(F.max_by("content", "seq").alias("content"))
    with Scratch(store.spark) as scratch:
        files = scratch.keep(newest)
        chunks = chunk_files(files.where(F.col("content").isNotNull()), options)
        return ingest_chunks(store, project, chunks, embedder, only_files=files)


def stream_files(
    store: MemoryStore,
    project: str,
    changes: DataFrame,
    embedder: Embedder,
    checkpoint: str,
    options: ChunkOptions = ChunkOptions(),
    **trigger,
) -> StreamingQuery:
    """Start following a streaming DataFrame of changes; ``trigger`` as in ``writeStream``."""

    def batch(changed: DataFrame, _: int) -> None:
        apply_changes(store, project, changed, embedder, options)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
