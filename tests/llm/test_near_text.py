"""The near-duplicate stage: recall on edited copies, clean documents, and every odd row."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_fixtures import DOCS, words
from recollect.llm import near_text


def alike(a, b):
    x, y = set(near_text.shingles(a).tolist()), set(near_text.shingles(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, text, n):
    out = text.split()
    for p in rng.sample(range(len(out)), n):
        out[p] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def classes(docs, scratch):
    return {r["doc_id"]: r["first"]["doc_id"] for r in near_text.classified(docs, scratch).collect()}


def test_recall_of_edited_copies_and_clean_documents(spark, scratch):
    rng, rows, pairs = random.Random(4), [], []
    for i in range(120):
        text = " ".join(words(rng, rng.randrange(100, 800), 3000))
        rows.append((100 * i, text, "en", "s", 0))
        for k, n in enumerate((1, 2, 4, 8), 1):
            copy = edited(rng, text, n)
            if alike(text, copy) >= near_text.SIMILAR:
                rows.append((100 * i + k, copy, "en", "s", 0))
                pairs.append((100 * i, 100 * i + k))
    found = classes(spark.createDataFrame(rows, DOCS).repartition(6), scratch)
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert all(a // 100 == b // 100 for a, b in found.items())


def test_fingerprints_alike_but_texts_not(spark, scratch, monkeypatch):
    """Everything is a candidate of everything; only the shingles decide."""
    monkeypatch.setattr(near_text, "candidates", lambda texts, s: _chain(texts, s))
    rng = random.Random(2)
    texts = [" ".join(words(rng, 50)) for _ in range(9)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts + [texts[3] + " end", texts[5]])]
    found = classes(spark.createDataFrame(rows, DOCS), scratch)
    assert found == {**{i: i for i in range(9)}, 9: 3, 10: 5}


def _chain(texts, scratch):
    from pyspark.sql import functions as F

    first = texts.agg(F.min("unit").alias("a"))
    return scratch.keep(texts.select(F.col("unit").alias("b")).crossJoin(first).where("a <> b").select("a", "b"))


def test_odd_rows(spark, docs, widened, empty, scratch):
    found = near_text.classified(docs, scratch).collect()
    assert len(found) == docs.count()
    of = {r["doc_id"]: r["first"]["doc_id"] for r in found if r["doc_id"] is not None}
    assert of[1002] == of[1003] == of[1001] and of[1004] == 1004
    kept = near_text.keep_first(docs, scratch).collect()
    assert len(kept) == len({(r["first"]["doc_id"], r["first"]["row"]) for r in found})
    wide = near_text.keep_first(widened, scratch)
    assert wide.columns == widened.columns and wide.count() == len(kept)
    assert near_text.keep_first(empty, scratch).count() == 0


def test_blocks_of_one_cluster(spark, scratch, monkeypatch):
    rng = random.Random(6)
    text = " ".join(words(rng, 300, 3000))
    rows = [(i, edited(rng, text, 1), "en", "s", 0) for i in range(60)]
    monkeypatch.setattr(near_text, "BLOCK", 16)
    assert set(classes(spark.createDataFrame(rows, DOCS), scratch).values()) == {0}


@pytest.mark.parametrize("width, radius", [(5, 0), (5, 2), (9, 1)])
def test_words_within_the_threshold_meet(width, radius):
    """Balls of half the threshold, rounded up and down, meet for all words that near."""
    for t in (2 * radius, 2 * radius + 1):
        outer, inner = near_text.ball(width, (t + 1) // 2), near_text.ball(width, t // 2)
        assert len(set(outer.tolist())) == len(outer) and set(outer[: len(inner)].tolist()) == set(inner.tolist())
        met = {int(a ^ b) for a in outer for b in inner}
        assert met == {x for x in range(1 << width) if bin(x).count("1") <= t}


def test_verified_finds_all_chains():
    sets = [np.arange(k, k + 40) for k in (0, 2, 4, 6, 500)] + [np.zeros(0, np.int64)] * 2
    root = near_text.verified(0, 0, np.zeros(7, dtype=np.int64), sets)
    assert root.tolist() == [0, 0, 0, 0, 4, 5, 5]


def _texts(spark, n, bits):
    rng = random.Random(3)
    rows = [(k, rng.getrandbits(bits), rng.getrandbits(60)) for k in range(n)]
    return spark.createDataFrame(rows, "unit long, fp long, fp2 long")


def test_rows_are_sent_to_a_key_once(spark, scratch):
    """Also to a key that has as many as texts that are not alike make."""
    texts, parts = _texts(spark, 4000, 50), [(list(range(10)), 0), (list(range(10, 64)), 0)]
    sent = near_text.dealt(texts, parts, scratch)
    assert sent.groupBy("key").count().agg({"count": "max"}).first()[0] >= 4000
    assert sent.count() == near_text.probes(texts, parts).count() == 8000


def test_blocks_of_a_key_find_all(spark, scratch, monkeypatch):
    texts = _texts(spark, 200, 14)
    rows = [(r["unit"], r["fp"], r["fp2"]) for r in texts.collect()]
    near = [(a, b) for a, x, u in rows for b, y, v in rows if a < b and (x ^ y).bit_count() <= near_text.TAU and (x ^ y).bit_count() + (u ^ v).bit_count() <= near_text.TAU_BOTH]
    found = []
    for block in (8192, 40):
        monkeypatch.setattr(near_text, "KEY_BLOCK", block)
        cells = near_text.dealt(texts, [(list(range(24)), 0)], scratch)
        assert (cells.count() > 200) == (block == 40)
        links = cells.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(near_text._meet, "a long, b long").collect()
        found.append(near_text.forest(200, *(np.array([r[k] for r in links], dtype=np.int64) for k in (0, 1))).tolist())
    expected = near_text.forest(200, *(np.array(c, dtype=np.int64) for c in zip(*near)))
    assert found == [expected.tolist()] * 2


def test_pairs_of_a_key_of_copies_are_not_held(monkeypatch):
    """All of 600 rows are near one another: 360,000 pairs, of which a strip at a time is there."""
    held, whole = [], near_text.forest

    def watched(n, i, *rest):
        held.append(len(i))
        return whole(n, i, *rest)

    monkeypatch.setattr(near_text, "forest", watched)
    monkeypatch.setattr(near_text, "_PAIRS", 1 << 13)
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in ([5] * 600, [0] * 600, [4 * k + 3 for k in range(600)], [9] * 600, [9] * 600)], ["key", "cell", "tag", "fp", "fp2"])
    (links,) = near_text._meet(iter([rows]))
    assert sorted(links["a"].to_pylist()) == list(range(1, 600)) and set(links["b"].to_pylist()) == {0}
    assert max(held) <= 1 << 13


@pytest.mark.parametrize("pairs", [1, 64, 700, 1 << 18])
def test_strips_connect_what_all_pairs_connect(monkeypatch, pairs):
    monkeypatch.setattr(near_text, "_PAIRS", pairs)
    rng = np.random.default_rng(7)
    of = rng.integers(0, 12, 90)
    fp, fp2 = (rng.integers(0, 1 << 60, 12)[of] ^ np.bitwise_xor.reduce(1 << rng.integers(0, 60, (7, 90))) for _ in range(2))
    for left, right in ((np.arange(90), np.arange(90)), (np.arange(40), np.arange(40, 90))):
        for inner in (np.ones(90, dtype=bool), rng.random(90) < 0.5):
            near = [
                (a, b) for a in left for b in right
                if (x := int(fp[a] ^ fp[b]).bit_count()) <= near_text.TAU and x + int(fp2[a] ^ fp2[b]).bit_count() <= near_text.TAU_BOTH and (inner[a] or inner[b])
            ]
            expected = near_text.forest(90, *(np.array([p[k] for p in near], dtype=np.int64) for k in (0, 1)))
            assert near_text.near_rows(fp, fp2, inner, left, right).tolist() == expected.tolist()
            assert 2 < len(set(expected.tolist())) < 90


def test_texts_of_all_documents_are_not_exchanged(spark, docs, scratch):
    """Also where Spark would broadcast nothing by itself."""
    rows = scratch.keep(near_text.measured(docs))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("own")
    members = scratch.keep(rows.limit(20).select(F.monotonically_increasing_id().alias("unit"), F.lit(0).cast("long").alias("cluster"), own))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = near_text.texts_of(docs, members)
        assert "hashpartitioning" not in texts._jdf.queryExecution().toString()
        assert {r["unit"] for r in texts.collect()} == {r["unit"] for r in members.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
