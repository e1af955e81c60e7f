"""Work on batches in bounded shares."""

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.functions import batches
from recollect.functions.embedding import HashingEmbedder, embed
from recollect.session import Scratch


def test_shares_are_bounded_and_leave_out_nothing():
    sizes = [3, 0, 9, 1, 1, 1, 20, 2]
    got = list(batches.shares(sizes, 10, 3))
    assert got == [(0, 2), (2, 4), (4, 6), (6, 7), (7, 8)]
    assert list(batches.shares([], 10, 3)) == []
    texts = pa.array(["a" * 700_000, None, "b" * 700_000, "", "c"])
    parts = list(batches.text_shares(texts))
    assert [len(p) for p in parts] == [2, 3] and pa.concat_arrays(parts).equals(texts)


def test_embedding_takes_a_batch_in_shares(spark):
    class Watching:
        """Refuses more than a share; known to the workers by value."""

        dim = 384

        def encode(self, texts):
            if len(texts) > batches.ROWS or sum(map(len, texts[:-1])) > batches.SIZE:
                raise AssertionError(f"{len(texts)} texts at once")
            return HashingEmbedder().encode(texts)

    df = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("word "), F.col("id").cast("string")).alias("t"))
    got = df.select("t", embed(F.col("t"), Watching()).alias("v")).collect()
    assert np.array_equal(np.array([r.v for r in got], np.float32), HashingEmbedder().encode([r.t for r in got]))


def test_encoding_leaves_nothing_to_the_collector():
    """A vocabulary that refers to itself stays, share by share, until the collector happens to run."""
    texts = [f"word{k} and word{k + 1}" for k in range(2000)]
    HashingEmbedder().encode(texts)
    gc.collect()
    gc.disable()
    try:
        HashingEmbedder().encode(texts)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_kept_results_are_computed_with_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with Scratch(spark) as scratch:
        sizes = scratch.keep(spark.range(0, 3000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long"))
        assert [r.n for r in sizes.collect()] == [1000] * 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
