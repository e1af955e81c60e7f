"""Exact token ids and counts of whole texts, word by word.

The tokenizer drops white space and never joins what stands on both sides of it, so the ids of a
text are those of its words one after another. Words are split at the six ASCII spaces only;
whatever else the tokenizer takes for white space stays within a word and is left to it. Many texts
are split at once, each distinct word among them is looked up once, and its ids are remembered.

Whole-token shortcut: for every vocabulary string it is proved once, by encoding it, whether it
comes out as its own single id when it stands alone. A word of letters, perhaps with a capital,
followed by plain punctuation is taken apart into these two pre-tokens, and a part that is proved
counts as one id without merging. All other parts are merged by the library, and words of other
kinds are left to it whole. ASCII words are taken apart all at once, as bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from recollect.llm.words import Words, slices

#: Letters that are one code point in every normal form and whose lower case is one code point.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)?([.,!?;:*#$%&()\"\-]+)?")
_LETTER, _MARK, _LOWER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.arange(256, dtype=np.uint8)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[list(b'.,!?;:*#$%&()"-')] = True
_LOWER[0x41:0x5B] += 0x20
#: Bytes of one generation of words or parts that a worker remembers, ENTRY of them for each besides the text; two
#: generations are kept.
REMEMBERED, ENTRY = 48 << 20, 160
#: Bytes of text that are split at once; a longer text is cut between two words.
AT_ONCE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memory:
    """Values of keys seen lately, in two generations of bounded size, however long the keys are."""

    def __init__(self):
        self.now: dict = {}
        self.older: dict = {}
        self.size = 0

    def missing(self, keys: list) -> list:
        """Those of ``keys`` without a value; after that, the others are all in ``now``."""
        if self.size > REMEMBERED:  # forget what has not been asked for since it was last full
            self.older, self.now, self.size = self.now, {}, 0
        now, older = self.now, self.older
        out = []
        for key in keys:
            if key not in now:
                self.size += ENTRY + 3 * len(key)  # an id has two bytes mostly, and stands for a byte at least
                value = older.get(key)
                if value is None:
                    out.append(key)
                else:
                    now[key] = value
        return out


class WordEncoder:
    """Ids of words by way of their pre-tokens.

    Within, ids are little-endian numbers of two bytes if the vocabulary fits them (``kind``).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self._suffix = model["end_of_word_suffix"]
        self._merge = self._tokenizer.model.tokenize
        most = max(self._tokenizer.get_vocab(with_added_tokens=True).values())
        self.kind, self._form = ("<u2", "H") if most <= 0xFFFF else ("<u4", "I")
        self.whole = self._prove(model["vocab"])
        self._whole = {b"": b""} | {t.encode(): self._narrow(struct.unpack("<I", ids)) for t, ids in self.whole.items()}
        self._words, self._parts = _Memory(), _Memory()

    def _prove(self, vocabulary: dict[str, int]) -> dict[str, bytes]:
        """The plain strings that encode alone as one id, with that id."""
        shown = [t[: -len(self._suffix)] for t in vocabulary if t.endswith(self._suffix)]
        tried = [t for t in shown if t and (m := _PLAIN.fullmatch(t)) and not (m[1] and m[2])]
        found = self._tokenizer.encode_batch_fast(tried, add_special_tokens=False)
        return {t: _ids(e.ids) for t, e in zip(tried, found) if len(e.ids) == 1}

    def _narrow(self, ids: Sequence[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self._form}", *ids)

    def _part_ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens: proved whole, or merged by the library's model."""
        new, whole, merge, narrow = self._parts.missing(parts), self._whole, self._merge, self._narrow
        known = self._parts.now
        for part in new:
            ids = whole.get(part)
            if ids is None:
                shown = part.decode() if part.isascii() else "".join([_BYTES[b] for b in part])
                ids = narrow([t.id for t in merge(shown)])
            known[part] = ids
        return list(map(known.__getitem__, parts))

    def _word_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of any kind."""
        odd, plain, heads, tails = [], [], [], []
        for word in self._words.missing(words):
            text = word.decode()
            if (m := _PLAIN.fullmatch(text)) is None:
                odd.append((word, text))
            else:
                plain.append(word)
                heads.append((m[1] or "").lower().encode())
                tails.append((m[2] or "").encode())
        known = self._words.now
        for word, head, tail in zip(plain, self._part_ids(heads), self._part_ids(tails)):
            known[word] = head + tail
        found = self._tokenizer.encode_batch_fast([t for _, t in odd], add_special_tokens=False)
        for (word, _), e in zip(odd, found):
            known[word] = self._narrow(e.ids)
        return list(map(known.__getitem__, words))

    def _split(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
        """Pieces of some texts: the text of each piece, where each one's parts begin among all parts,
        the ids of the distinct parts, and which of these each part is. A word is two parts."""
        pieces = [(k, piece) for k, t in enumerate(texts) for piece in _cut((t or "").encode())]
        for a, b in slices([len(x) for _, x in pieces], AT_ONCE):
            words = Words([x for _, x in pieces[a:b]])
            data, sizes = words.raw[~words.gaps], words.ends - words.starts
            starts = _summed(sizes)[:-1]
            letter = _LETTER[data]
            count = np.int32 if len(data) < 1 << 31 else np.int64
            letters, marks = _summed(letter, count), _summed(_MARK[data], count)
            heads = letters[starts + sizes] - letters[starts]
            tails = sizes - heads
            plain = (letters[starts + heads] - letters[starts] == heads) & (
                marks[starts + sizes] - marks[starts + heads] == tails
            )
            inside = np.repeat(plain, sizes)
            head, head_at = _distinct(_LOWER[data[inside & letter]], heads[plain])
            tail, tail_at = _distinct(data[inside & ~letter], tails[plain])
            whole, whole_at = _distinct(data[~inside], sizes[~plain])
            which = np.full((len(sizes), 2), len(head), dtype=np.int64)  # after the heads stands an empty part
            which[plain, 0], which[plain, 1] = head_at, tail_at + len(head) + 1
            which[~plain, 0] = whole_at + len(head) + 1 + len(tail)
            ids = [*self._part_ids(head), b"", *self._part_ids(tail), *self._word_ids(whole)]
            yield np.array([k for k, _ in pieces[a:b]]), 2 * words.bounds, ids, which.ravel()

    def packed(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each whole text, as numbers of ``kind``; a null text has none."""
        begun, now = [], 0
        for owner, bounds, ids, which in self._split(texts):
            flat = np.frombuffer(b"".join(ids), dtype=self.kind)
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // flat.itemsize
            first, own = (np.cumsum(sizes) - sizes)[which], sizes[which]
            ends = np.concatenate([[0], np.cumsum(own)])
            taken = flat[np.repeat(first - ends[:-1], own) + np.arange(ends[-1])]
            at = ends[bounds]
            for text, a, b in zip(owner.tolist(), at[:-1].tolist(), at[1:].tolist()):
                if text != now:
                    yield b"".join(begun)
                    begun, now = [], text
                begun.append(taken[a:b].tobytes())
        if texts:
            yield b"".join(begun)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as 32-bit numbers."""
        return [np.frombuffer(x, dtype=self.kind).astype("<u4").tobytes() for x in self.packed(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        """How many ids each whole text has."""
        out = np.zeros(len(texts), dtype=np.int64)
        for owner, bounds, ids, which in self._split(texts):
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // np.dtype(self.kind).itemsize
            ends = np.concatenate([[0], np.cumsum(sizes[which])])
            np.add.at(out, owner, np.diff(ends[bounds]))
        return out.tolist()


def _ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_names() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable Latin-1 as it is, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_BYTES = _byte_names()


def _summed(values: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """What stands before each value, added up, and the sum of all."""
    out = np.zeros(len(values) + 1, dtype=kind)
    np.cumsum(values, out=out[1:])
    return out


def _distinct(data: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct strings among those of these sizes that stand in ``data``, and which one each is."""
    buffers = [None, pa.py_buffer(_summed(sizes)), pa.py_buffer(np.ascontiguousarray(data))]
    found = pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()


def _cut(text: bytes) -> list[bytes]:
    """A text in pieces of about AT_ONCE bytes that end between two words; one piece at least."""
    out, at = [], 0
    while len(text) - at > AT_ONCE and (space := _SPACE.search(text, at + AT_ONCE)):
        out.append(text[at : space.start()])
        at = space.start()
    return [*out, text[at:]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each tokenizer and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
