"""Words of many texts at once, as 64-bit hashes in one array."""

from __future__ import annotations

import numpy as np

from recollect.functions.batches import give_back

_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``base^i`` and ``base^-i`` modulo 2^64 for i below ``size`` at least; kept until more are asked for."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(1 << max(10, int(size - 1).bit_length()), b, dtype=np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no bit alone."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


#: Bytes that are no part of a word, by rule.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but digits, lower-case letters and what is not ASCII.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Words:
    """The words of some texts: ``starts`` and ``ends`` in ``data``, ``bounds`` of each text's words.

    The bytes of the texts stand one after another with a space between; a null text is empty.
    """

    def __init__(self, texts: list[bytes | None], outside: np.ndarray = SPACES):
        self.data = b" ".join([t or b"" for t in texts])
        sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
        self.text_starts = np.cumsum(sizes) - sizes
        self.raw = np.frombuffer(self.data, dtype=np.uint8)
        self.gaps = outside[self.raw]
        gap = np.ones(len(self.raw) + 2, dtype=bool)
        gap[1:-1] = self.gaps
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.bounds = np.append(np.searchsorted(self.starts, self.text_starts), len(self.starts))

    def hashes(self) -> np.ndarray:
        """One number for each word, equal for equal words."""
        sums = _sums(self.raw.astype(np.uint64) + np.uint64(1), _P)
        inverse = powers(_P, len(self.raw) + 1)[1]
        return mixed((sums[self.ends] - sums[self.starts]) * inverse[self.starts])


def gram_hashes(words: np.ndarray, n: int, base: int = _Q) -> np.ndarray:
    """A number for each ``n`` consecutive words, from the words' numbers."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    sums = _sums(words, base)
    return mixed((sums[n:] - sums[:-n]) * powers(base, len(words) + 1)[1][: len(words) - n + 1])


def slices(sizes: list[int], most: int):
    """Ranges of consecutive texts of about ``most`` bytes together, one text at least."""
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if k > first and total + size > most:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def pieces(batches, rows: int = 500):
    """Record batches of few rows, so that little is held beside what Arrow has sent.

    A worker serves one task after the other, so what a task no longer needs goes back at its end.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()
