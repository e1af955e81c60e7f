"""Token ids of whole texts in binary files, in order of the documents, and back.

Texts are tokenized where they lie; only ids are shuffled. The codes come from the counts of all
ids. A file begins with its codebook, then come independent blocks of whole documents, then the
table of its blocks, which says where each lies and what it holds, so that any block is read by
itself, by any later application.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.batches import give_back
from recollect.llm import codec
from recollect.llm.base import Scratch
from recollect.llm.files import Written, read, shared_folder
from recollect.llm.tokens import encoder, tokenizer_path
from recollect.llm.words import pieces

#: The id that ends a document, ids and documents to a block (a longer document is one block).
END_ID, BLOCK_IDS, BLOCK_DOCS = 2, 1 << 19, 20_000

#: Blocks that one task reads.
BLOCKS_A_TASK = 16

_BLOCKS = "file string, part int, block int, at long, size long, n_docs long, n_ids long"
#: The end of a file: for each block its place, size, documents and ids; then part, blocks and a mark.
_ROW, _TAIL, _MARK = "<QQQQ", "<II4s", b"IDT1"


def tokenized(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """``doc_id, n, ids`` for every row; ``ids`` are packed. A null text is an empty one.

    Packed ids begin with the number of bytes that each has, two wherever the vocabulary allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        head, size = known.kind[-1].encode(), int(known.kind[-1])
        end = b"" if end_id is None else int(end_id).to_bytes(size, "little")
        for batch in pieces(batches):
            ids = [head + x + end for x in known.packed(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary")


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[:1].decode()}", offset=1)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; as many numbers as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in pieces(batches):
            flat = np.concatenate([np.zeros(0, dtype="<u2"), *map(_unpacked, batch.column("ids").to_pylist())])
            found = np.bincount(flat, minlength=len(total))
            found[: len(total)] += total
            total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    counts[rows["id"]] = rows["n"]
    return counts


def write_files(
    tokens: DataFrame, folder: str, scratch: Scratch, block_ids: int = BLOCK_IDS, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """Write ``doc_id, n, ids`` rows to files in ascending order of ``doc_id``, nulls last.

    Returns the table of all files' blocks, with ``start``, the ids in all blocks before. A file is one range
    of documents. Equal doc_ids stand together, in order of their ids.
    """
    dumped = codec.Codebook(codec.code_lengths(id_counts(tokens))).dump()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        blocks = _blocks(batches, block_ids, block_docs)
        first = next(blocks, None)
        if first is None:
            return
        book, url, rows = codec.Codebook.load(dumped), f"{folder}/ids-{part:06d}.bin", []
        with Written(url) as out:
            out.write(len(dumped).to_bytes(4, "little") + dumped)
            for docs, ids in _chain(first, blocks):
                data = codec.pack_block(book, docs, ids)
                rows.append((out.write(data), len(data), len(docs), sum(map(len, ids))))
            out.write(b"".join(struct.pack(_ROW, *r) for r in rows) + struct.pack(_TAIL, part, len(rows), _MARK))
        yield _block_rows(url, part, rows)

    order = [F.col("doc_id").asc_nulls_last(), F.col("ids")]
    placed = tokens.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(*order)
    return _started(scratch.keep(placed.select("doc_id", "ids").mapInArrow(run, _BLOCKS)))


def _block_rows(url: str, part: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = [[url] * len(rows), [part] * len(rows), list(range(len(rows))), *zip(*rows)]
    types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _BLOCKS.split(", ")])


def _started(blocks: DataFrame) -> DataFrame:
    """The table of blocks with ``start``, the ids in all blocks before; a row a file reaches the driver."""
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts = list(accumulate((n for _, n in parts), initial=0))
    table = blocks.sparkSession.createDataFrame(
        [(p, s) for (p, _), s in zip(parts, starts)], "in_part int, part_start long"
    )
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .join(F.broadcast(table), F.col("part") == F.col("in_part"))  # a row for each file
        .withColumn("start", F.col("part_start") + F.col("before"))
        .drop("before", "in_part", "part_start")
    )


def find_blocks(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """The table of blocks of the files in ``folder``, from the files' own ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                part, n, mark = struct.unpack(_TAIL, read(url, size - struct.calcsize(_TAIL)))
                if mark != _MARK:
                    raise ValueError(f"{url} has no table of blocks")
                rows = n * struct.calcsize(_ROW)
                table = read(url, size - struct.calcsize(_TAIL) - rows, rows)
                yield _block_rows(url, part, list(struct.iter_unpack(_ROW, table)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder).select("path", "length")
    return _started(scratch.keep(files.mapInArrow(run, _BLOCKS)))


def _chain(first, rest):
    yield first
    yield from rest


def _blocks(batches: Iterator[pa.RecordBatch], block_ids: int, block_docs: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    docs, ids, n = [], [], 0
    for batch in pieces(batches):
        for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            docs.append(doc)
            ids.append(_unpacked(packed))
            n += len(ids[-1])
            if n >= block_ids or len(docs) >= block_docs:
                yield docs, ids
                docs, ids, n = [], [], 0
    if docs:
        yield docs, ids


def read_files(blocks: DataFrame, blocks_a_task: int = BLOCKS_A_TASK) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files; ids are 32-bit."""
    return _read(blocks, blocks_a_task, "ids binary", lambda ids: pa.array(ids, pa.binary()))


def read_crcs(blocks: DataFrame, blocks_a_task: int = BLOCKS_A_TASK) -> DataFrame:
    """As ``read_files``, with the CRC-32 of the bytes of the ids, which do not leave the worker that reads them."""
    return _read(blocks, blocks_a_task, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x) for x in ids], pa.int64()))


def _read(blocks: DataFrame, blocks_a_task: int, column: str, values: Callable[[list[bytes]], pa.Array]) -> DataFrame:
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[str, codec.Codebook] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] not in books:
                    size = int.from_bytes(read(r["file"], 0, 4), "little")
                    books = {r["file"]: codec.Codebook.load(read(r["file"], 4, size))}
                docs, lens, ids = codec.unpack_block(books[r["file"]], read(r["file"], r["at"], r["size"]))
                ends = np.cumsum(lens, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(ends - lens + r["start"], pa.int64()),
                        pa.array(lens.astype(np.int64)),
                        values([ids[e - n : e].tobytes() for e, n in zip(ends, lens)]),
                    ],
                    ["doc_id", "start", "n_tokens", name],
                )
        give_back()

    # A number of its own: by size alone, Spark would join these few bytes to one task.
    tasks = max(1, -(-blocks.count() // blocks_a_task))
    spread = blocks.repartitionByRange(tasks, "start", "file", "block").sortWithinPartitions("start", "file", "block")
    return spread.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def token_files(docs: DataFrame, scratch: Scratch, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Tokenize ``docs``, write the files and return what is read back, with CRCs.

    Empty and null texts consist of the end id alone. Repeated rows are written as often as they
    occur. An empty table writes no file and gives an empty result.
    """
    path = path or tokenizer_path()
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    tokens = scratch.keep(tokenized(docs, path), compression="zstd")
    return read_crcs(scratch.keep(write_files(tokens, folder, scratch)))
