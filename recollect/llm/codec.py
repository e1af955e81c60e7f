"""Canonical length-limited Huffman coding of ids, in independent blocks.

Codes follow from their lengths alone: shorter ones first, equal lengths by id. A block notes the
bit at which every CHECKPOINT-th id begins, so that a reader decodes all stretches side by side,
one id of each at a time, by one look into a table of the next LIMIT bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Longest code, ids between two checkpoints.
LIMIT, CHECKPOINT = 20, 128
MAGIC = b"IDH1"
_CHUNK = 128 * CHECKPOINT


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The length of each id's code, 0 where the count is 0, by package-merge.

    No code is longer than ``limit``, or than the ids need if they are more than 2^limit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, rows = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        at = np.argsort(merged, kind="stable")
        row = merged[at]
        rows.append(at < n)
    take, found = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(rows):
        own = int(is_leaf[:take].sum())
        found[:own] += 1
        take = 2 * (take - own)
    lengths[order] = found
    return lengths


class Codebook:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        sizes = self.lengths[order].astype(np.int64)
        self.width = int(sizes[-1]) if len(sizes) else 1
        # Left-aligned, each code begins where the one before it ends.
        spans = np.left_shift(np.int64(1), self.width - sizes)
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(self.lengths), dtype=np.uint64)
        self.codes[order] = (starts >> (self.width - sizes)).astype(np.uint64)
        self._order, self._spans = order, spans
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """For any next ``width`` bits: the id, shifted by 8, and the length of its code."""
        if self._table is None:
            entries = (self._order.astype(np.uint32) << np.uint32(8)) | self.lengths[self._order].astype(np.uint32)
            table = np.repeat(entries, self._spans)
            self._table = np.concatenate([table, np.zeros((1 << self.width) - len(table), dtype=np.uint32)])
        return self._table

    def dump(self) -> bytes:
        return zlib.compress(self.lengths.tobytes())

    @classmethod
    def load(cls, data: bytes) -> "Codebook":
        return cls(np.frombuffer(zlib.decompress(data), dtype=np.uint8))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids`` and the bit at which every CHECKPOINT-th begins."""
        words, marks, total = np.zeros(len(ids) * self.width // 32 + 4, dtype=np.uint64), [], 0
        for k in range(0, len(ids), _CHUNK):  # pieces that stay in the cache
            some = ids[k : k + _CHUNK]
            sizes = self.lengths[some].astype(np.int64)
            ends = np.cumsum(sizes) + total
            starts = ends - sizes
            marks.append(starts[::CHECKPOINT])
            value = self.codes[some] << (64 - (starts & 31) - sizes).astype(np.uint64)
            first = int(starts[0]) >> 5
            at = (starts >> 5) - first
            width = int(at[-1]) + 2
            # Codes do not overlap: adding is setting bits, and sums below 2^32 are exact.
            high = np.bincount(at, (value >> np.uint64(32)).astype(np.float64), minlength=width)
            low = np.bincount(at + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=width)
            words[first : first + width] += (high + low).astype(np.uint64)
            total = int(ends[-1])
        found = np.concatenate(marks) if marks else np.zeros(0)
        return words.astype(">u4").tobytes()[: (total + 7) // 8], found.astype(np.uint64)

    def decode(self, data: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids back; all stretches between checkpoints at once."""
        if n == 0:
            return np.zeros(0, dtype=np.uint32)
        raw = np.frombuffer(data + bytes(12), dtype=np.uint8)
        # A 64-bit window from every fourth byte.
        cut = raw[: len(raw) // 4 * 4].view(">u4").astype(np.uint64)
        windows = (cut[:-1] << np.uint64(32)) | cut[1:]
        at = marks.astype(np.int64)
        out = np.zeros((CHECKPOINT, len(at)), dtype=np.uint32)
        last = n - (len(at) - 1) * CHECKPOINT
        down, mask, table = np.uint64(64 - self.width), np.uint64((1 << self.width) - 1), self.table
        for k in range(CHECKPOINT):
            if k == last:  # the last stretch may be shorter
                at = at[:-1]
                if not len(at):
                    break
            bits = (windows[at >> 5] >> (down - (at & 31).astype(np.uint64))) & mask
            entry = table[bits]
            out[k, : len(at)] = entry >> np.uint32(8)
            at = at + (entry & np.uint32(0xFF))
        return out.T.reshape(-1)[:n]


# -- blocks ---------------------------------------------------------------------

_BLOCK = struct.Struct("<4sIIIIII")


def pack_block(book: Codebook, doc_ids: list[int | None], ids: list[bytes | np.ndarray]) -> bytes:
    """Documents as one block: their ids (arrays, or little-endian 32-bit numbers) and doc_ids, null or not."""
    ids = [np.frombuffer(x, dtype="<u4") if isinstance(x, bytes) else x for x in ids]
    lens = np.array([len(x) for x in ids], dtype="<u4")
    flat = np.concatenate([np.zeros(0, dtype="<u2"), *ids])
    bits, marks = book.encode(flat)
    steps = np.diff(marks, prepend=np.uint64(0)).astype("<u4")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    parts = [zlib.compress(x.tobytes(), 1) for x in (known, names, lens, steps)]
    head = _BLOCK.pack(MAGIC, len(lens), len(flat), *map(len, parts))
    return b"".join([head, struct.pack("<I", zlib.crc32(bits)), *parts, bits])


def unpack_block(book: Codebook, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The doc_ids, the number of ids of each, and all ids one after another."""
    magic, n_docs, n, *sizes = _BLOCK.unpack_from(data)
    at = _BLOCK.size
    (check,) = struct.unpack_from("<I", data, at)
    at += 4
    parts = []
    for size in sizes:
        parts.append(zlib.decompress(data[at : at + size]))
        at += size
    bits = bytes(data[at:])
    if magic != MAGIC or zlib.crc32(bits) != check:
        raise ValueError("damaged block")
    known, names, lens, steps = (np.frombuffer(p, dtype=t) for p, t in zip(parts, ("u1", "<i8", "<u4", "<u4")))
    marks = np.cumsum(steps, dtype=np.uint64)
    ids = [int(d) if k else None for d, k in zip(names, known)]
    assert len(ids) == n_docs
    return ids, lens, book.decode(bits, marks, n)
