import hashlib
import math
import random
from collections import Counter

import oracle
from pyspark.sql import functions as F

from recollect.operators import aggregates, diff, listing
from recollect.operators.numbering import first_rows, number_rows
from recollect.operators.overlap import overlap_counts
from recollect.session import broadcast_if_small


def test_numbers_are_consecutive_in_order(spark):
    values = list(range(1000))
    random.Random(2).shuffle(values)
    df = spark.createDataFrame([(v // 10, v % 10) for v in values], "a int, b int").repartition(7)
    numbered, n = number_rows(df, [F.col("a"), F.col("b")], "id", 50)
    assert n == 1000 and [(r.id, r.a * 10 + r.b) for r in numbered.orderBy("id").collect()] == [(50 + i, i) for i in range(1000)]
    assert sorted(r.a * 10 + r.b for r in first_rows(df, [F.col("a"), F.col("b")], 123).collect()) == list(range(123))
    empty, n = number_rows(df.where("a < 0"), [F.col("a")], "id")
    assert n == 0 and empty.count() == 0


def test_overlap_counts_equal_pairwise_counting(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        path = rng.choice(["hot", "hot", "hot", "a", None])
        start = rng.randrange(3000)
        end = rng.choice([start, start + rng.randrange(200), None])
        rows.append(dict(id=i, file_path=path, line_start=start, line_end=end))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, file_path string, line_start int, line_end int")
    got = {r.id: r.overlaps for r in overlap_counts(df).collect()}
    for r in rows:
        assert got[r["id"]] == sum(oracle.overlap(r, o) for o in rows if o["id"] != r["id"])


def _chunk_rows(rng, n):
    return [(f"f{rng.randrange(6)}", i, f"text {rng.randrange(12)}", rng.randrange(50)) for i in range(n)]


def test_diff_pairs_equal_texts_one_to_one(spark):
    rng = random.Random(9)
    new, old = _chunk_rows(rng, 120), _chunk_rows(rng, 100)
    chunks = spark.createDataFrame(
        [(p, i, t, hashlib.sha256(t.encode()).hexdigest(), s, s + 3, "", "lines", "text") for p, i, t, s in new],
        "rel_path string, ordinal int, content string, content_hash string, start_line int, end_line int, unit string, unit_kind string, lang string",
    )
    stored = spark.createDataFrame(
        [(i, p, hashlib.sha256(t.encode()).hexdigest(), s, s + 3) for p, i, t, s in old],
        "id long, file_path string, content_hash string, line_start int, line_end int",
    )
    rows = diff.classify(chunks, stored).collect()
    want = Counter()
    for key in {(p, t) for p, _, t, _ in new + old}:
        fresh = [s for p, _, t, s in new if (p, t) == key]
        known = [s for p, _, t, s in old if (p, t) == key]
        for a, b in zip(fresh, known):
            want["unchanged" if a == b else "moved"] += 1
        want["created"] += max(0, len(fresh) - len(known))
        want["stale"] += max(0, len(known) - len(fresh))
    assert Counter(r.status for r in rows) == want
    created = diff.with_texts(diff.classify(chunks, stored).where("status = 'created'"), chunks).collect()
    texts = {(r.rel_path, r.ordinal): r.content for r in chunks.collect()}
    assert sorted((r.rel_path, r.ordinal) for r in created) == sorted((r.rel_path, r.ordinal) for r in rows if r.status == "created")
    assert all(r.content == texts[r.rel_path, r.ordinal] for r in created) and "content" not in rows[0]
    assert sorted(r.id for r in rows if r.id is not None) == list(range(100))
    assert sorted(r.ordinal for r in rows if r.ordinal is not None) == list(range(120))
    totals = diff.totals(diff.file_changes(diff.classify(chunks, stored))).first()
    assert totals.totalChunks == 120 and totals.chunksDeleted == want["stale"]
    nothing = diff.totals(diff.file_changes(diff.classify(chunks.where("false"), stored))).first()
    assert (nothing.filesDeleted, nothing.chunksDeleted, nothing.filesScanned) == (len({p for p, *_ in old}), 100, 0)


def test_digest_depends_on_the_set_alone(spark):
    def tree(blocks):
        """Digests of blocks, of these (all in one block of blocks here), and of that."""
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return sha(sha(",".join(map(sha, blocks)).encode()).encode())[:16]

    def digest(ids):
        df = spark.createDataFrame([("p", i) for i in ids], "project string, id long").repartition(3)
        return aggregates.id_digest(df).first().digest

    assert digest([1, 2, 3]) == digest([3, 1, 2]) == tree([b"1,2,3"])
    assert digest([1, 23]) != digest([12, 3])
    many = list(range(0, 30_000, 3))
    assert digest(many) == digest(many[::-1]) != digest(many[:-1])
    assert aggregates.id_digest(spark.createDataFrame([], "project string, id long")).count() == 0


def test_percentiles_by_nearest_rank(spark):
    rng = random.Random(6)
    values = {"hot": [rng.random() for _ in range(301)], "few": [3.0, 1.0], "one": [5.0], "tied": [1.0] * 10}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("hot", None)], "k string, v double")
    got = {(r.k, r.percent): r.v for r in aggregates.nearest_rank(df, "k", "v", [0, 1, 50, 95, 99, 100]).collect()}
    for k, vs in values.items():
        for p in (0, 1, 50, 95, 99, 100):
            assert got[k, p] == sorted(vs)[max(0, math.ceil(p / 100 * len(vs)) - 1)]


def test_listing(spark):
    rows = [(i, f"2024-01-0{1 + i % 3}", ["Work", "b"] if i % 2 else ["c"], "code" if i > 6 else "manual") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, created_at string, tags array<string>, kind string")
    ids = [r.id for r in listing.newest_first(df, 4).collect()]
    assert ids == [8, 5, 2, 7]
    assert [r.id for r in listing.newest_first(df, 2, tag=" WORK ").collect()] == [5, 7]
    assert [r.id for r in listing.newest_first(df, 9, tag="c", kind="code").collect()] == [8]
    wanted = spark.createDataFrame([(0, 7), (1, 99), (2, 3)], "pos int, id int")
    assert [r.id for r in listing.by_ids(df, wanted).collect()] == [7, 3]


def test_pages_joined_equal_the_whole_list(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 5, 1)
    rows = [(i, start + dt.timedelta(minutes=(i * 37) % 50)) for i in range(230)]  # times that tie
    spark.createDataFrame(rows, "id long, created_at timestamp").repartitionByRange(6, "created_at").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    whole = [r.id for r in listing.newest_first(table, 1000).collect()]
    pages, after = [], None
    while page := listing.newest_first(table, 60, after=after).collect():
        pages += [r.id for r in page]
        after = (page[-1].created_at, page[-1].id)
    assert pages == whole and len(whole) == 230
    plan = listing.newest_first(table, 60, after=after)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(created_at" in plan


def test_duplicates_and_counts(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", ""), (4, "a", None), (5, "a", "")], "id int, project string, content_hash string")
    assert [tuple(r) for r in aggregates.exact_duplicates(df).collect()] == [("x", 2, 1)]
    assert [tuple(r) for r in aggregates.project_counts(df).collect()] == [("a", 4), ("b", 1)]


def test_broadcast_only_what_was_counted(spark):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    df = spark.range(100)
    assert hinted(broadcast_if_small(df, 100)) and not hinted(broadcast_if_small(df, 99))
