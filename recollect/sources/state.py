"""What the last ingestion of a folder saw: size and times of every file, and what was stored of it.

A file of the same size and times, whose stored chunks are the same rows, needs no reading. Times
are of modification and of change of the entry; the latter moves even where a tool sets the former
back. A file that was modified just before it was listed may be modified again without a visible
trace, so it is not noted and is read once more next time.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import detect_language
from recollect.schema import KIND_CODE
from recollect.session import Scratch
from recollect.sources.chunker import ChunkOptions
from recollect.sources.store import MemoryStore, project_slug

#: Nanoseconds within which a file may change twice under one time: where times are whole seconds,
#: and elsewhere.
COARSE, FINE = 2_000_000_000, 100_000_000
_SAME = ["rel_path", "size", "modified", "changed"]


def stored_chunks(memories: DataFrame, path_prefix: str | None = None) -> DataFrame:
    rows = memories.where((F.col("kind") == KIND_CODE) & F.col("file_path").isNotNull())
    if path_prefix:  # a folder or a file, not the first half of a name
        whole = path_prefix.rstrip("/")
        rows = rows.where((F.col("file_path") == whole) | F.startswith(F.col("file_path"), F.lit(whole + "/")))
    return rows.select("id", "file_path", "content_hash", "line_start", "line_end")


def digests(stored: DataFrame) -> DataFrame:
    """``file_path, n, digest``: how many chunks of each file are stored, and a number for just these rows."""
    own = F.xxhash64("id", "content_hash", "line_start", "line_end")
    return stored.groupBy("file_path").agg(F.count("*").alias("n"), F.bit_xor(own).alias("digest"))


class FileState:
    """The state table of one project, root and choice of chunk sizes; its folder is noted in the store."""

    def __init__(self, store: MemoryStore, project: str, root: str, options: ChunkOptions):
        self._store, self._project = store, project
        told = repr((os.path.abspath(root), options))
        self._key = f"file_state/{project}/{hashlib.sha256(told.encode()).hexdigest()[:32]}"
        self._stored: DataFrame | None = None

    def _folder(self) -> str | None:
        return self._store.get_meta(self._key)

    def unchanged(self, listed: DataFrame, scratch: Scratch) -> DataFrame | None:
        """``rel_path, chunks, lang`` of the listed files that need no reading; None without a state."""
        folder = self._folder()
        if folder is None:
            return None
        noted = self._store.spark.read.parquet(f"{self._store.home}/{folder}")
        self._stored = scratch.keep(digests(stored_chunks(self._store.rows(self._project))))
        both = listed.join(noted, _SAME).join(self._stored, F.col("rel_path") == F.col("file_path"), "left")
        same = (F.coalesce("n", F.lit(0)) == F.col("chunks")) & F.col("digest").eqNullSafe(F.col("noted_digest"))
        return scratch.keep(both.where(same).select("rel_path", "chunks", detect_language(F.col("rel_path")).alias("lang")))

    def vanished(self, listed: DataFrame, unread: DataFrame | None, path_prefix: str | None) -> bool:
        """Whether files below ``path_prefix`` are stored that are neither listed nor known to be there."""
        stored = self._stored.select("file_path")
        if path_prefix:
            whole = path_prefix.rstrip("/")
            stored = stored.where((F.col("file_path") == whole) | F.startswith("file_path", F.lit(whole + "/")))
        for there in [listed] if unread is None else [listed, unread]:
            stored = stored.join(there.select(F.col("rel_path").alias("file_path")), "file_path", "left_anti")
        return not stored.isEmpty()

    def save(self, listed: DataFrame, listed_at: int, scratch: Scratch) -> None:
        """Note ``listed`` with what is stored now. Written after the store's commit: a run that ends
        between the two reads files again that it need not."""
        now = digests(stored_chunks(self._store.rows(self._project)))
        latest = F.greatest("modified", "changed")
        settled = latest + F.when(latest % 1_000_000_000 == 0, COARSE).otherwise(FINE) < listed_at
        rows = listed.where(settled).join(now, F.col("rel_path") == F.col("file_path"), "left").select(
            *_SAME, F.coalesce("n", F.lit(0)).alias("chunks"), F.col("digest").alias("noted_digest")
        )
        old, folder = self._folder(), f"state/{project_slug(self._project)}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self._store.home}/{folder}")
        self._store._retried(lambda: self._store.set_meta(self._key, folder))
        if old is not None:
            self._store.files.drop(old)
