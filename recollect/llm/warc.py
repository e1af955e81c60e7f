"""WARC archives: written as one gzip stream a file, normalised to a member a record, and indexed.

An archive that was compressed as a whole can only be read from its beginning. The normaliser
inflates such a stream once, from front to back with bounded memory, compresses every record as a
member of its own and notes where each member begins in a sidecar index, so that any record can be
read by itself.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.base import Scratch, row_hash
from recollect.llm.files import Written, read, reading, shared_folder

#: Payloads below this size are never replaced by a reference.
REVISIT_FROM = 100
#: Bytes of records to an archive, bytes inflated at a time, zlib's level.
ARCHIVE_BYTES, CHUNK, LEVEL = 64 << 20, 1 << 20, 1
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"1970-01-01T00:00:00Z"


def _name(page_id: int | None, row: int) -> bytes:
    return b"<urn:page:%s:%016x>" % (b"null" if page_id is None else b"%d" % page_id, row % (1 << 64))


def record(
    page_id: int | None, row: int, url: str | None, payload: bytes | None, digest: str, size: int,
    refers_to: tuple[int, int] | None,
) -> bytes:
    """One record. ``payload`` is None for a revisit, whose HTTP header still tells the full size.

    ``refers_to`` is the page id and row of a record, whose own id the revisit names.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if payload is not None else b"revisit"),
        b"WARC-Record-ID: " + _name(page_id, row),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + _header(url),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if payload is None:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _name(*refers_to)]
    block = http + (payload or b"")
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(value: str | None) -> bytes:
    """A header's value on one line: what ends a line is percent-encoded."""
    text = value or ""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text).encode()


def parse(data: bytes) -> dict:
    """The headers of one record, its page id, and the block's HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in lines[1:])
    block = rest[: int(headers[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])
    page = headers[b"WARC-Record-ID"].split(b":")[2]
    refers = headers.get(b"WARC-Refers-To")
    return {
        "page_id": None if page == b"null" else int(page),
        "type": headers[b"WARC-Type"].decode(),
        "digest": headers[b"WARC-Payload-Digest"].partition(b":")[2].decode(),
        "size": int(fields[b"Content-Length"]),
        "refers_to": int(refers.split(b":")[2]) if refers else None,
        "record_id": headers[b"WARC-Record-ID"].decode(),
        "refers_to_record": refers.decode() if refers else None,
        "url": headers[b"WARC-Target-URI"].decode(),
        "payload": payload,
    }


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of bytes, by the length that each states."""
    held, at = bytearray(), 0
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        """Whether ``n`` bytes are held from ``at``; what has been given out is dropped only then."""
        nonlocal at
        while len(held) - at < n:
            more = next(chunks, None)
            if more is None:
                return False
            if at:
                del held[:at]
                at = 0
            held.extend(more)
        return True

    while fill(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not fill(len(held) - at + 1):
                raise ValueError("a record has no end of headers")
        end -= at
        # Header lines only: a payload may hold anything.
        head = bytes(held[at : at + end])
        length = next(int(x[16:]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))
        size = end + 4 + length + 4
        if not fill(size):
            raise ValueError("a record is cut off")
        yield bytes(held[at : at + size])
        at += size


def inflated(stream) -> Iterator[bytes]:
    """What a gzip file holds, whether of one member or many, CHUNK by CHUNK.

    Raises ValueError where the last member has no end.
    """
    unzip, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            out = unzip.decompress(data, CHUNK)
            if out:
                yield out
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip, begun = unzip.unused_data, zlib.decompressobj(31), False
    if begun:
        if out := unzip.flush():
            yield out
        if not unzip.eof:
            raise ValueError("a gzip stream is cut off")


def page_of(data: bytes) -> int | None:
    """The page id in a record's headers."""
    at = data.index(b"WARC-Record-ID: <urn:page:") + 26
    page = data[at : data.index(b":", at)]
    return None if page == b"null" else int(page)


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# -- tables ---------------------------------------------------------------------


def with_records(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """What each page's record says: ``page_id, row, url, payload, digest, size, refers_to, refers_row``.

    Of equal payloads of REVISIT_FROM bytes or more, the smallest page_id is stored and the others
    refer to it, without their payload. Pages are joined to first pages by digest; these are kept
    first, so that Spark can split the key of a payload that many pages share.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select(
        "page_id", row_hash(pages).alias("row"), "url", body.alias("html"), F.sha2(body, 256).alias("digest"),
        F.octet_length(body).cast("long").alias("size"),
    )
    shared = known.where(F.col("size") >= REVISIT_FROM).groupBy(F.col("digest").alias("shared")).agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("least"), F.count("*").alias("n")
    )
    shared = scratch.keep(
        shared.where("n > 1").select("shared", F.col("least.page_id").alias("first"), F.col("least.row").alias("first_row"))
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.join(shared, F.col("digest") == F.col("shared"), "left").select(
        "page_id", "row", "url", F.when(~revisit, F.col("html")).alias("payload"), "digest", "size",
        F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_row")).alias("refers_row"),
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records as archives of one gzip stream each; returns their ``file`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, out, size = TaskContext.get().partitionId(), [], None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    url = f"{folder}/pages-{part:06d}-{len(files):04d}.warc.gz"
                    out, packer, size = Written(url), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                    files.append(url)
                payload = r["payload"].encode() if r["payload"] is not None else None
                first = (r["refers_to"], r["refers_row"]) if payload is None else None
                data = record(r["page_id"], r["row"], r["url"], payload, r["digest"], r["size"], first)
                out.write(packer.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(packer.flush())
                    out.finish()
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.finish()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], ["file"])

    return records.mapInArrow(run, "file string")


#: An entry of the index: offset, size, whether there is a page id, and that id.
_ENTRY = "<QI?q"


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each archive as ``*.members.warc.gz`` with an index ``*.members.idx`` beside it.

    The index is one line of JSON (format, records), then for every record its offset, the size of
    its member and its page id, 21 bytes each. Returns ``file, index, n``. A file is one task's work: the gzip
    stream can't be entered in the middle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column("file").to_pylist():
                stem = url.removesuffix(".warc.gz")
                target, index, entries = f"{stem}.members.warc.gz", f"{stem}.members.idx", []
                with Written(target) as out, reading(url) as stream:
                    for data in split_records(inflated(stream)):
                        packed, page = member(data), page_of(data)
                        entries.append(struct.pack(_ENTRY, out.write(packed), len(packed), page is not None, page or 0))
                with Written(index) as side:
                    side.write(json.dumps({"format": "warc-members-2", "records": len(entries)}).encode() + b"\n")
                    side.write(b"".join(entries))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([target]), pa.array([index]), pa.array([len(entries)], pa.int64())], ["file", "index", "n"]
                )

    # One archive to a task: each is a single stream.
    return a_task_each(archives).mapInArrow(run, "file string, index string, n long")


def a_task_each(files: DataFrame) -> DataFrame:
    """The kept table ``files`` with a partition for each row, which Spark would join by their few bytes."""
    return files.repartitionByRange(max(1, files.count()), "file")


def _index(data: bytes) -> list[tuple[int, int, bool, int]]:
    head, _, body = data.partition(b"\n")
    assert json.loads(head)["records"] * struct.calcsize(_ENTRY) == len(body)
    return list(struct.iter_unpack(_ENTRY, body))


def read_index(data: bytes) -> list[tuple[int, int]]:
    """Offset and size of every member."""
    return [(at, size) for at, size, _, _ in _index(data)]


def indexed_pages(data: bytes) -> list[int | None]:
    """The page id of every member."""
    return [page if known else None for _, _, known, page in _index(data)]


def read_archives(members: DataFrame) -> DataFrame:
    """Every record, member by member at the places that the index tells.

    The digest of a response is computed from the payload read back; that of a revisit is what its
    record says.
    """
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                entries, out = read_index(read(r["index"])), []
                with reading(r["file"]) as stream:
                    for at, size in entries:
                        stream.seek(at)
                        x = parse(zlib.decompress(stream.read(size), 31))
                        response = x["type"] == "response"
                        digest = hashlib.sha256(x["payload"]).hexdigest() if response else x["digest"]
                        n = len(x["payload"]) if response else x["size"]
                        out.append((x["page_id"], x["url"], n, digest, x["type"], x["refers_to"]))
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], columns)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], columns)

    return a_task_each(members).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archived(pages: DataFrame, scratch: Scratch, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, normalise these and return what they hold.

    A null html is an empty payload. Rows of the smallest page_id among equal payloads are all
    responses if that id is repeated; rows without an id refer to the smallest id there is, and are
    responses if there is none. An empty table writes no archive and gives an empty result.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    archives = scratch.keep(write_archives(with_records(pages, scratch), folder))
    return read_archives(scratch.keep(normalise(archives)))
