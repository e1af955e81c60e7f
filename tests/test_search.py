import random

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions.embedding import HashingEmbedder, OnnxEmbedder, embed, length_batches, text_windows, unit_rows
from recollect.functions.vectors import decode_float32, dot, encode_float32
from recollect.operators import knn
from recollect.operators import dedup
from recollect.operators.dedup import greedy_dedup
from recollect.operators.packing import pack, pack_long, recall_stats


def _vectors(spark, n, dim=8, projects=("a", "b")):
    rng = np.random.default_rng(5)
    # Coarse values, so that equal scores occur.
    m = rng.integers(-2, 3, (n, dim)).astype(float)
    m[np.abs(m).sum(axis=1) == 0, 0] = 1
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, projects[i % 5 % len(projects)], [float(x) for x in m[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, project string, embedding array<float>"), rows


def _brute(rows, project, vector, k):
    q = np.array(vector, dtype=np.float64)
    scored = [(round(float(np.array(v, dtype=np.float64) @ q), 9) + 0.0, i) for i, p, v in rows if p == project]
    return [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


def _asked(df, condition, k):
    return df.where(condition).select(F.col("id").alias("query_id"), "project", "embedding", F.expr(k).cast("int").alias("fetch_k"))


@pytest.mark.parametrize(("broadcast", "query_block", "vector_block"), [(4096, 1, 1), (3, 4, 37), (0, 1000, 1000)])
def test_top_k_is_exact_with_ties_and_stays_in_its_project(spark, monkeypatch, broadcast, query_block, vector_block):
    monkeypatch.setattr(knn, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(knn, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(knn, "VECTOR_BLOCK", vector_block)
    df, rows = _vectors(spark, 300)
    found = knn.top_k(df.repartition(5), _asked(df, "id < 12", "id * 7 % 40")).collect()
    for i, project, vector in rows[:12]:
        k = i * 7 % 40
        got = [(r.id, r.score) for r in sorted((r for r in found if r.query_id == i), key=lambda r: r["rank"])]
        want = _brute(rows, project, vector, k)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-8)
        assert all(r.candidates == len(want) for r in found if r.query_id == i)


@pytest.mark.parametrize("broadcast", [4096, 0])
def test_equal_texts_take_one_place_and_equal_query_ids_do_not_mix(spark, monkeypatch, broadcast):
    monkeypatch.setattr(knn, "BROADCAST_QUERIES", broadcast)
    df, rows = _vectors(spark, 300)
    df = df.withColumn("content_hash", F.expr("CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN '' ELSE concat('h', id % 17) END"))
    name = lambda i: f"h{i % 17}" if i % 10 > 1 else i
    vector = spark.createDataFrame([(1, p, rows[k][2], 30) for p, k in (("a", 0), ("b", 4))], "query_id long, project string, embedding array<float>, fetch_k int")
    found = knn.top_k(df.repartition(7), vector.union(vector)).collect()
    for project, k in (("a", 0), ("b", 4)):
        want = []
        for i, _ in _brute(rows, project, rows[k][2], 300):
            if name(i) not in [name(w) for w in want]:
                want.append(i)
        got = sorted((r for r in found if r.project == project), key=lambda r: r["rank"])
        assert [r.id for r in got] == want[:30]


def test_lanes_of_many_tasks_merge_to_the_same_answer(spark):
    df, rows = _vectors(spark, 300)
    asked = _asked(df, "id < 6", "9")
    assert {tuple(r) for r in knn.top_k(df.repartition(1), asked).collect()} == {tuple(r) for r in knn.top_k(df.repartition(26), asked).collect()}
    assert knn.nearest(df.repartition(200), "a", rows[0][2], 30) == knn.nearest(df, "a", rows[0][2], 30)


def test_nearest_and_edge_cases(spark):
    df, rows = _vectors(spark, 100)
    assert [i for i, _ in knn.nearest(df, "a", rows[0][2], 7)] == [i for i, _ in _brute(rows, "a", rows[0][2], 7)]
    assert knn.nearest(df, "nowhere", rows[0][2], 5) == []
    assert len(knn.nearest(df, "a", rows[0][2], 4000)) == sum(p == "a" for _, p, _ in rows)
    assert knn.top_k(df, _asked(df, "id < 0", "5")).count() == 0
    with pytest.raises(Exception, match="dimension"):
        knn.nearest(df, "a", [1.0, 0.0], 5)


def test_fetch_counts():
    assert [knn.fetch_count(n, False) for n in (1, 2, 3, 5, 66, 67, 200)] == [12, 12, 18, 30, 396, 400, 400]
    assert knn.fetch_count(1, True) == 400


def test_one_hot_namespace_is_split_over_tasks(spark):
    df, rows = _vectors(spark, 400, projects=("hot",))
    plan = knn.search(df.repartition(8), {"hot": (np.array([0]), [3], np.array([rows[0][2]], dtype=float))})
    per_task = plan.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_task) == 8 and all(r["count"] == 3 for r in per_task)


def _candidates(n, seed):
    rng = random.Random(seed)
    base = ["alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3 + f"tail{v}" for v in range(4)]
    rows = []
    for i in range(n):
        start = rng.randrange(30)
        text = rng.choice([rng.choice(base), f"unique text number {rng.randrange(40)} here", "", " \t", " ".join(rng.choices("abcde", k=12))])
        code = rng.random() < 0.6
        rows.append(
            dict(
                project="p", query_id=rng.randrange(3), id=i, score=rng.choice([0.1, 0.5, 0.9]), text=text,
                content_hash=rng.choice([None, "", f"h{rng.randrange(25)}"]), file_path=rng.choice(["f1", "f2", "f3"]) if code else None,
                line_start=start if code else None, line_end=start + rng.randrange(4) if rng.random() < 0.9 and code else None,
            )
        )
    return rows


_SCHEMA = "project string, query_id long, id long, score double, text string, content_hash string, file_path string, line_start int, line_end int"


#: Outlives whatever it has given out.
_COUNTED = pa.proxy_memory_pool(pa.default_memory_pool())


def test_greedy_dedup_copies_the_texts_of_survivors_alone():
    n, text = 100, "x" * 50_000
    rows = {"id": range(n), "score": [0.5] * n, "content_hash": ["same"] * n, "text": [text] * n, "grams": [[1, 2, 3]] * n}
    empty = {"file_path": pa.nulls(n, pa.string()), "line_start": pa.nulls(n, pa.int32()), "line_end": pa.nulls(n, pa.int32())}
    group, before = pa.table(rows | empty), pa.default_memory_pool()
    pa.set_memory_pool(_COUNTED)
    try:
        found = dedup._survivors(0.85)(group)
    finally:
        pa.set_memory_pool(before)
    assert found.num_rows == 1 and found["text"].to_pylist() == [text]
    assert _COUNTED.max_memory() < n * len(text) / 5


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dedup_is_the_first_maximal_independent_set(spark, seed):
    rows = _candidates(150, seed)
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in _SCHEMA.split(", ")) for r in rows], _SCHEMA)
    got = greedy_dedup(df).collect()
    for q in range(3):
        assert {r.id for r in got if r.query_id == q} == set(oracle.survivors([r for r in rows if r["query_id"] == q]))


def test_near_duplicates_at_the_threshold(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    near = words[:-8] + ["x"] * 8  # shares 92 of them
    far = words[:-10] + ["y"] * 10  # shares 90
    rows = [(0, 1, 0.9, words), (0, 2, 0.8, near), (0, 3, 0.7, far)]
    df = spark.createDataFrame([("p", q, i, s, " ".join(w), None, None, None, None) for q, i, s, w in rows], _SCHEMA)
    kept = {r.id for r in greedy_dedup(df).collect()}
    texts = [dict(id=i, score=s, text=" ".join(w), content_hash=None, file_path=None, line_start=None, line_end=None) for _, i, s, w in rows]
    assert kept == set(oracle.survivors(texts))


@pytest.mark.parametrize("packer", [pack, pack_long])
def test_packing_takes_the_longest_prefix_that_fits(spark, packer):
    rng = random.Random(1)
    rows = [("p", q, i, 1.0 - i / 100, rng.randrange(1, 60), 4, [None, 0, 50, 200, 10_000][q], 20) for q in range(5) for i in range(20)]
    rows += [("other", 3, i, 1.0 - i / 100, 7, 4, 21, 20) for i in range(20)]
    df = spark.createDataFrame(rows, "project string, query_id long, id long, score double, cost long, limit int, max_tokens long, candidates long")
    packed = packer(df)
    chosen = packed.where("chosen").collect()
    asked = df.select("project", "query_id", "candidates").distinct().union(spark.createDataFrame([("p", 9, 0)], "a string, b long, c long"))
    stats = {(r.project, r.query_id): r for r in recall_stats(packed, asked).collect()}
    assert len(stats) == 7 and tuple(stats["p", 9])[2:] == (0, 0, 0, 0, 0) and stats["other", 3].returned == 3
    for q, budget in enumerate([None, 0, 50, 200, 10_000]):
        costs = [r[4] for r in rows if r[:2] == ("p", q)]
        got = sorted(r["rank"] for r in chosen if (r.project, r.query_id) == ("p", q))
        want, used = len(got), sum(costs[: len(got)])
        assert got == list(range(1, want + 1))
        assert oracle.longest_prefix(costs, want, budget) if budget else want == 4
        s = stats["p", q]
        assert (s.returned, s.tokens_used, s.survivors, s.candidates) == (want, used, 20, 20)
        assert s.truncated == (20 - want if budget else 0)


def test_a_long_list_is_spread(spark):
    rows = spark.range(4000).select(F.lit("p").alias("project"), F.lit(1).alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(2).alias("cost"), F.lit(1).alias("limit"), F.lit(5001).alias("max_tokens"))
    packed = pack_long(rows.repartition(4))
    assert packed.where("chosen").agg(F.count("*"), F.max("rank"), F.max("running_tokens")).first() == (2500, 2500, 5000)


def test_hashing_embedder_is_stable_unit_and_whole_text(spark):
    e = HashingEmbedder()
    texts = ["Payment refund", "payment  REFUND", "", "x " * 5000 + "tail", "x " * 5000]
    m = e.encode(texts)
    assert m.shape == (5, 384) and m.dtype == np.float32
    assert np.allclose(m[0], m[1]) and not m[2].any()
    assert np.allclose(np.linalg.norm(m[[0, 3, 4]], axis=1), 1, atol=1e-6)
    assert not np.array_equal(m[3], m[4])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.v for r in df.select("i", embed(F.col("t"), e).alias("v")).collect()}
    for i, row in enumerate(m):
        assert np.array_equal(np.array(got[i], dtype=np.float32), row)


def test_vector_codec_and_dot(spark):
    df = spark.createDataFrame([([0.5, -1.25, 3.0],), ([],)], "v array<float>")
    for v, blob, back in df.select("v", encode_float32("v"), decode_float32(encode_float32("v"))).collect():
        assert bytes(blob) == np.array(v, dtype="<f4").tobytes() and back == v
    assert df.select(dot(F.col("v"), F.col("v"))).first()[0] == 0.25 + 1.5625 + 9
    with pytest.raises(Exception, match="dimension mismatch"):
        df.select(dot(F.col("v"), F.array(F.lit(1.0)))).collect()


def test_vector_columns_with_nulls_and_unequal_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0]), (2, None, [1.0]), (3, [], []), (4, [2.0] * 5, [0.5] * 5)], "i int, a array<float>, b array<float>")
    assert [r[0] for r in df.orderBy("i").select(dot(F.col("a"), F.col("b"))).collect()] == [11.0, None, 0.0, 5.0]
    back = df.orderBy("i").select(encode_float32("a").alias("e"), decode_float32(encode_float32("a")).alias("d")).collect()
    assert [r.d for r in back] == [[1.0, 2.0], [], [], [2.0] * 5] and back[1].e is None
    assert df.where("false").select(decode_float32(encode_float32("a"))).count() == 0
    with pytest.raises(Exception, match="whole number"):
        spark.createDataFrame([(bytearray(b"12345"),)], "b binary").select(decode_float32("b")).collect()


class _Piece:
    def __init__(self, ids):
        self.ids, self.attention_mask, self.overflowing = ids + [0] * (4 - len(ids)), [1] * len(ids) + [0] * (4 - len(ids)), []


class _Tokenizer:
    """A token for each character, four to a window."""

    def encode_batch(self, texts):
        out = []
        for t in texts:
            pieces = [_Piece([ord(c) for c in t[k : k + 4]]) for k in range(0, max(len(t), 1), 4)]
            pieces[0].overflowing = pieces[1:]
            out.append(pieces[0])
        return out


def test_the_model_reads_whole_texts(monkeypatch):
    from recollect.functions import embedding

    class Input:
        name = "input_ids"

    class Session:
        def get_inputs(self):
            return [Input]

        def run(self, _, feed):
            return [np.eye(128)[feed["input_ids"]]]

    monkeypatch.setattr(embedding, "_load_model", lambda *_: (_Tokenizer(), Session()))
    texts = ["ab", "", "a" * 11 + "z", "abcdefghi" * 3]
    got = OnnxEmbedder("nowhere", dim=128, max_units=6, batch_size=2).encode(texts)
    for text, row in zip(texts, got):
        counts = np.bincount([ord(c) for c in text], minlength=128) / max(len(text), 1)
        assert np.allclose(row, unit_rows(counts[None, :])[0], atol=1e-6)


def test_model_helpers(tmp_path):
    assert list(length_batches(["aaa", "a", "aaaa", "aa"], 2)) == [[1, 3], [0, 2]]
    assert text_windows("abcde", 2) == ["ab", "cd", "e"] and text_windows("", 2) == [""]
    with pytest.raises(Exception):
        OnnxEmbedder(str(tmp_path)).encode(["x"])


# -- cells ---------------------------------------------------------------------------


def _clustered(n=600, dim=24, seed=11):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, dim))
    rows = centres[rng.integers(0, 30, n)] + 0.12 * rng.standard_normal((n, dim))
    rows[0] = 0
    rows[1:4] = rows[5]
    return rows.astype(np.float32)


@pytest.mark.parametrize("least", [None, 0.2, 0.9])
def test_cells_give_what_a_scan_gives_and_read_less(spark, least):
    from recollect.operators import cells
    from recollect.session import Scratch

    rows = _clustered()
    data = [("a" if i % 3 else "b", i, v.tolist()) for i, v in enumerate(rows)]
    vectors = spark.createDataFrame(data, "project string, id long, embedding array<float>")
    asked = vectors.where("id % 7 = 0").select(F.col("id").alias("query_id"), "project", "embedding", F.lit(6).alias("fetch_k"))
    with Scratch(spark) as scratch:
        index = cells.build(vectors, scratch)
        found = cells.search(index, asked.withColumn("min_score", F.lit(least).cast("double")), scratch)
        got = sorted((r.project, r.query_id, r["rank"], r.id) for r in found.hits.collect())
        work = {(r.project, r.query_id): r.compared for r in found.work.collect()}
    scores = np.round(rows.astype(np.float64) @ rows.astype(np.float64).T, 9)
    want = []
    for project, q, _ in data:
        if q % 7 == 0:
            own = [i for p, i, _ in data if p == project and (least is None or scores[q, i] >= least)]
            want += [(project, q, k + 1, i) for k, i in enumerate(sorted(own, key=lambda i: (-scores[q, i], i))[:6])]
    assert got == sorted(want)
    sizes = {p: sum(1 for x in data if x[0] == p) for p in "ab"}
    assert len(work) == len({(p, q) for p, q, _ in data if q % 7 == 0})
    if least != 0.2:
        assert sum(work.values()) < 0.6 * sum(sizes[p] for p, q, _ in data if q % 7 == 0)


def test_cells_of_nothing(spark):
    from recollect.operators import cells
    from recollect.session import Scratch

    none = spark.createDataFrame([], "project string, id long, embedding array<float>")
    asked = spark.createDataFrame([("a", 1, [1.0], 3, None)], "project string, query_id long, embedding array<float>, fetch_k int, min_score double")
    with Scratch(spark) as scratch:
        found = cells.search(cells.build(none, scratch), asked, scratch)
        assert found.hits.count() == 0 and [r.compared for r in found.work.collect()] == [0]


def test_long_lists_give_the_same_answers(spark, monkeypatch):
    """All rounds spread over tasks: rows, ranks and what is chosen stay the same."""
    from recollect.plans import recall as plan

    rng = random.Random(12)
    vocabulary = [f"t{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40]))) for _ in range(90)]
    texts += [texts[k] + " tail" for k in range(0, 90, 4)] + texts[:20]
    rows = []
    for i, text in enumerate(texts):
        place = (f"f{i % 7}", 3 * (i // 7), 3 * (i // 7) + rng.choice([1, 4])) if i % 3 else (None, None, None)
        rows.append((i, "p" if i % 4 else "q", "code", text, [], *place, str(hash(text))))
    memories = spark.createDataFrame(
        rows, "id long, project string, kind string, text string, tags array<string>, file_path string, line_start int, line_end int, content_hash string"
    ).withColumn("embedding", embed(F.col("text"), HashingEmbedder()))
    asked = spark.createDataFrame(
        [(k, p, texts[k * 7], 5, b) for k, (p, b) in enumerate([("p", None), ("q", None), ("p", 300), ("q", 100_000)])],
        "query_id long, project string, query string, limit int, max_tokens long",
    )

    def answer():
        found = plan.recall(memories, asked, HashingEmbedder()).collect()
        return sorted((r.project, r.query_id, r["rank"], r.id, r.chosen, r.running_tokens, r.survivors) for r in found)

    usual = answer()
    monkeypatch.setattr(plan, "LONG_LIST", 0)
    assert answer() == usual and len(usual) > 100
