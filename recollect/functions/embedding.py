"""Turning text into unit vectors inside Arrow batches.

``HashingEmbedder`` needs no model files and is deterministic on every worker.
``OnnxEmbedder`` runs a sentence-transformer that the user supplies.
"""

from __future__ import annotations

import hashlib
import os
import time
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from typing import Iterator, Protocol

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.batches import give_back, text_shares
from recollect.functions.vectors import matrix_list
from recollect.schema import EMBEDDING_DIM, VECTOR

# Window of the sentence model's input in characters, and its batch size.
MODEL_INPUT_UNITS = 1200
MODEL_BATCH = 32

# Where str.split() and the ECMAScript white-space class differ: it splits at the first
# five of these, which are not in the class, and not at the last, which is.
_DIFFERENT = re.compile("[\x1c-\x1f\x85\ufeff]")
_SPACES = re.compile(f"[{''.join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))}]+")


def _words(text: str) -> list[str]:
    lowered = text.lower()
    if _DIFFERENT.search(lowered):
        return [w for w in _SPACES.split(lowered) if w]
    return lowered.split()


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """An (n, dim) float32 matrix of unit (or, for empty input, zero) rows."""


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed hashed counts of the lower-cased words of the whole text."""

    dim: int = EMBEDDING_DIM

    def encode(self, texts: list[str]) -> np.ndarray:
        split = [_words(t) for t in texts]
        lengths = [len(w) for w in split]
        # Number the batch's vocabulary, hash each word of it once, then only add up.
        vocabulary: defaultdict[str, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        ids = np.fromiter((vocabulary[w] for words in split for w in words), dtype=np.int64, count=sum(lengths))
        vocabulary.default_factory = None  # it refers to itself by this, and would outlive the call with all its words
        hashed = b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest() for w in vocabulary)
        digests = np.frombuffer(hashed, dtype=np.uint8).reshape(-1, 16)
        slots = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) % self.dim
        signs = 1.0 - 2.0 * ((digests[:, 4] >> 4) & 1)
        cells = np.repeat(np.arange(len(texts)) * self.dim, lengths) + slots[ids]
        counts = np.bincount(cells, weights=signs[ids], minlength=len(texts) * self.dim)
        counts = counts.astype(np.float64).reshape(len(texts), self.dim)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0).astype(np.float32)


@dataclass(frozen=True)
class OnnxEmbedder:
    """Masked mean pooling over a local ONNX sentence model, then L2 normalisation.

    ``folder`` holds ``tokenizer.json`` and the model file on every executor.
    """

    folder: str
    model_file: str = "onnx/model_quantized.onnx"
    dim: int = EMBEDDING_DIM
    batch_size: int = MODEL_BATCH
    max_units: int = MODEL_INPUT_UNITS

    def encode(self, texts: list[str]) -> np.ndarray:
        """Whole texts: windows of ``max_units`` characters, cut again at the model's 512 tokens,
        pooled over all their tokens."""
        tokenizer, session = _load_model(self.folder, self.model_file)
        wanted = {i.name for i in session.get_inputs()}
        parts = [(k, w) for k, t in enumerate(texts) for w in text_windows(t, self.max_units)]
        sums, weights = np.zeros((len(texts), self.dim), dtype=np.float64), np.zeros(len(texts), dtype=np.int64)
        for rows in length_batches([w for _, w in parts], self.batch_size):
            encoded = tokenizer.encode_batch([parts[i][1] for i in rows])
            owners = np.array([parts[i][0] for i, e in zip(rows, encoded) for _ in range(1 + len(e.overflowing))])
            encoded = [piece for e in encoded for piece in (e, *e.overflowing)]
            mask = np.array([e.attention_mask for e in encoded], dtype=np.int64)
            feed = {
                "input_ids": np.array([e.ids for e in encoded], dtype=np.int64),
                "attention_mask": mask,
                "token_type_ids": np.zeros_like(mask),
            }
            hidden = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
            np.add.at(sums, owners, (hidden * mask[:, :, None]).sum(axis=1, dtype=np.float64))
            np.add.at(weights, owners, mask.sum(axis=1))
        return unit_rows(sums / np.maximum(weights, 1)[:, None])


def text_windows(text: str, size: int) -> list[str]:
    """``text`` in consecutive pieces of ``size`` characters; an empty text is one empty piece."""
    return [text[k : k + size] for k in range(0, max(len(text), 1), size)]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def length_batches(texts: list[str], size: int) -> Iterator[list[int]]:
    """Row numbers in batches of similar length, so padding neither costs time nor shifts vectors."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for at in range(0, len(order), max(1, size)):
        yield order[at : at + max(1, size)]


@lru_cache(maxsize=2)
def _load_model(folder: str, model_file: str):
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
    tokenizer.enable_padding()
    tokenizer.enable_truncation(512)
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # one task, one core
    return tokenizer, onnxruntime.InferenceSession(os.path.join(folder, model_file), options)


def embed(text: Column, embedder: Embedder, spent: Accumulator | None = None) -> Column:
    """The vector column for a text column; the model is loaded once per worker. ``spent`` adds up the
    milliseconds of all tasks. A batch's texts are encoded a bounded share at a time, so that what a
    worker holds of words and counts does not grow with the batch."""

    @F.arrow_udf(VECTOR)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            started = time.perf_counter()
            parts = [matrix_list(embedder.encode([t or "" for t in part.to_pylist()])) for part in text_shares(batch)]
            vectors = pa.concat_arrays(parts) if parts else matrix_list(embedder.encode([]))
            if spent is not None:
                spent.add(1000 * (time.perf_counter() - started))
            yield vectors
        give_back()

    return run(text)
