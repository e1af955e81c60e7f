"""Reading a source tree: a distributed directory walk, then a distributed read.

The walk is a Spark data source. The planner lists the upper directories until
there are enough subtrees to go round; each task then walks its subtrees, with the
ignore rules of the directories above. Paths come back as rows; contents are read
by later tasks, spread by path. The tree must be reachable from every executor.
"""

from __future__ import annotations

import os
from collections import deque
from dataclasses import dataclass, field
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from recollect.functions.patterns import path_filter
from recollect.operators.numbering import first_rows
from recollect.session import Scratch
from recollect.sources.ignore import ignored, parse_rules

# Version-control and package folders that are never entered.
SKIPPED_DIRECTORIES = [".git", ".hg", ".svn", "node_modules"]
#: Contents that a reading task holds at once; a larger file is held alone.
BATCH_BYTES = 64 << 20

_SCHEMA = "rel_path string, size long, modified long, changed long"


@dataclass(frozen=True)
class _Branch:
    """A directory still to be walked and the ignore files that apply to it."""

    rel: str
    depth: int
    ignore_files: tuple[tuple[str, str], ...] = ()


@dataclass
class _Subtrees(InputPartition):
    branches: list[_Branch] = field(default_factory=list)
    files: list[tuple[str, int, int, int]] = field(default_factory=list)


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.respect = options.get("respect_gitignore", "true").lower() == "true"
        self.skipped = set(options.get("skip_dirs", "/".join(SKIPPED_DIRECTORIES)).split("/"))
        self.max_depth = int(options.get("max_depth", str(2**31)))
        self.wanted = int(options.get("subtrees", "64"))

    def _enter(self, branch: _Branch) -> tuple[list[_Branch], list[tuple[str, int, int, int]]]:
        """The subdirectories and files of one directory, sorted, without the ignored ones."""
        folder = os.path.join(self.root, branch.rel) if branch.rel else self.root
        own = branch.ignore_files
        if self.respect:
            try:
                with open(os.path.join(folder, ".gitignore"), "rb") as handle:
                    own += ((branch.rel, handle.read().decode("utf-8", "replace")),)
            except OSError:
                pass
        rules = [parse_rules(text, base) for base, text in own]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return [], []
        branches, files = [], []
        for entry in entries:
            rel = f"{branch.rel}/{entry.name}" if branch.rel else entry.name
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in self.skipped and branch.depth < self.max_depth and not ignored(rel, True, rules):
                    branches.append(_Branch(rel, branch.depth + 1, own))
            elif entry.is_file(follow_symlinks=False) and not ignored(rel, False, rules):
                try:
                    stat = entry.stat()
                except OSError:
                    continue
                files.append((rel, stat.st_size, stat.st_mtime_ns, stat.st_ctime_ns))
        return branches, files

    def partitions(self) -> list[_Subtrees]:
        """Go down breadth first until there are enough subtrees, then deal them out."""
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"not a directory: {self.root}")
        open_branches, files = deque([_Branch("", 0)]), []
        while open_branches and len(open_branches) < self.wanted and len(files) < 100 * self.wanted:
            branches, found = self._enter(open_branches.popleft())
            open_branches.extend(branches)
            files.extend(found)
        dealt = list(open_branches)
        parts = [_Subtrees(branches=dealt[i :: self.wanted]) for i in range(min(self.wanted, len(dealt)))]
        return [*parts, _Subtrees(files=files)]

    def read(self, partition: _Subtrees) -> Iterator[tuple[str, int, int, int]]:
        yield from partition.files
        stack = list(reversed(partition.branches))
        while stack:
            branches, files = self._enter(stack.pop())
            yield from files
            stack.extend(reversed(branches))


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("path", ...)``: rows of ``rel_path, size``, and when the
    contents were ``modified`` and the entry ``changed`` (nanoseconds)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


def walk(
    spark: SparkSession,
    root: str,
    respect_gitignore: bool = True,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    max_files: int | None = None,
    max_depth: int | None = None,
    skip_dirs: list[str] | None = None,
) -> DataFrame:
    """The files under ``root`` as ``rel_path, size, modified, changed``; with ``max_files`` the first by path."""
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a directory: {os.path.abspath(root)}")
    spark.dataSource.register(SourceTree)
    options = {"path": root, "respect_gitignore": str(respect_gitignore).lower()}
    options["subtrees"] = str(max(64, 2 * spark.sparkContext.defaultParallelism))
    if max_depth is not None:
        options["max_depth"] = str(max_depth)
    if skip_dirs is not None:
        options["skip_dirs"] = "/".join(skip_dirs)
    found = spark.read.format("source_tree").options(**options).load()
    found = found.where(path_filter(F.col("rel_path"), include, exclude))
    return first_rows(found, [F.col("rel_path")], max_files) if max_files is not None else found


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = batch.column("rel_path").to_pylist(), batch.column("size").to_pylist()
            for some in _by_bytes(paths, sizes):
                texts = [_read_text(os.path.join(root, p)) for p in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.string()), pa.array(texts, pa.string())], names=["rel_path", "content"]
                )

    return run


def _by_bytes(paths: list[str], sizes: list[int]) -> Iterator[list[str]]:
    """Paths in runs of BATCH_BYTES together, one path at least."""
    some, total = [], 0
    for path, size in zip(paths, sizes):
        if some and total + size > BATCH_BYTES:
            yield some
            some, total = [], 0
        some.append(path)
        total += size
    if some:
        yield some


def _read_text(path: str) -> str | None:
    """A text file's content, or None where it is binary or cannot be read."""
    try:
        with open(path, "rb") as handle:
            raw = handle.read()
    except OSError:
        return None
    return None if b"\0" in raw else raw.decode("utf-8", "replace")


def read_contents(listed: DataFrame, root: str, max_file_bytes: int | None = None) -> DataFrame:
    """``rel_path, content`` of the listed files that are text, and small enough if a size is given."""
    fitting = listed if max_file_bytes is None else listed.where(F.col("size") <= max_file_bytes)
    return (
        fitting.select("rel_path", "size").mapInArrow(_reader(os.path.abspath(root)), "rel_path string, content string")
        .where(F.col("content").isNotNull())
    )


def listing(found: DataFrame, scratch: Scratch, bytes_per_task: int = 64 << 20) -> tuple[DataFrame, int]:
    """The walk's result kept, spread for reading, with its row count."""
    kept = scratch.keep(found)
    n, total = kept.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cores = kept.sparkSession.sparkContext.defaultParallelism
    return kept.repartition(max(cores, total // bytes_per_task + 1), "rel_path"), n


def looks_binary(content):
    """A NUL anywhere in a binary column."""
    return F.contains(content, F.lit(b"\0"))
