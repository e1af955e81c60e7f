"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.tokens import encoder, tokenizer_path
from recollect.llm.words import pieces

#: Documents of more tokens than this are marked.
LIMIT = 2048


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; no shuffle.

    Words that are proved to be whole tokens count as one; only the rest is merged. Null texts are
    empty: no bytes, no tokens. Repeated rows are counted each. An empty table gives none.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in pieces(batches):
            texts = batch.column("text")
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            n = pa.array(known.count(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
