"""Embedding near-duplicates and whitening against plain numpy; the filter audit against brute force."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import filter_audit, neighbours, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def clusters(seed=5, dim=24):
    """Unit vectors: strays, clusters of near ones of several sizes, chains, and copies."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dim) for _ in range(150)]
    for size in (2, 3, 40):
        centre = rng.standard_normal(dim)
        out += [centre + 0.05 * rng.standard_normal(dim) for _ in range(size)]
    step, side = rng.standard_normal(dim), rng.standard_normal(dim)
    out += [np.cos(0.35 * k) * step + np.sin(0.35 * k) * side for k in range(6)]  # neighbours in a chain
    out += [out[3]] * 4 + [2.5 * out[4], -out[5]]
    return [v.astype(np.float32) for v in out]


def brute_links(rows, cosine=0.9):
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ids, n, links = [r[0] for r in rows], [0] * len(rows), []
    unit = [np.array(r[1], dtype=np.float64) / np.linalg.norm(np.array(r[1], dtype=np.float64)) if fine(r[1]) else None for r in rows]
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                n[i] += 1
                links.append((i, j))
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if root[j] < root[i]:
                root[i], changed = root[j], True
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return sorted(((ids[i], n[i], least.get(r), ids[i] == least.get(r)) for i, r in enumerate(root)), key=repr)


def near(spark, scratch, rows, **options):
    found = neighbours.near_vectors(spark.createDataFrame(rows, VECTORS), scratch, **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_near_vectors_equal_brute_force(spark, scratch):
    rows = [(900 - 3 * i, [float(x) for x in v], i % 4) for i, v in enumerate(clusters())]
    assert near(spark, scratch, rows) == brute_links(rows)


def test_unsound_vectors_ties_and_repeats(spark, scratch):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, -0.0], 0), (4, [1.0, nan], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0),
        (7, [1.0, 0.0], 0), (8, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (9, [1.0, 0.1, 0.0], 0), (10, [3e38, 3e37], 0),
        (None, [1e-38, 0.0], 0), (None, None, 0), (11, [0.0, 1.0], 0), (11, [0.0, 1.0], 0), (12, [-1.0, 0.0], 0),
    ]
    assert near(spark, scratch, rows) == brute_links(rows)
    assert near(spark, scratch, []) == []


def test_large_buckets_are_split_and_counted_once(spark, scratch, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)  # nine blocks, met in several tables
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(12)
    rows = [(i, [float(x) for x in centre + 0.02 * rng.standard_normal(12)], 0) for i in range(140)]
    assert near(spark, scratch, rows) == brute_links(rows)


def test_recall_at_the_threshold(spark, scratch):
    """Pairs whose cosine is just above the threshold are the hardest to meet."""
    rng, rows = np.random.default_rng(2), []
    for i in range(400):
        a, b = np.linalg.qr(rng.standard_normal((48, 2)))[0].T
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (0.901 * a + math.sqrt(1 - 0.901**2) * b).tolist(), 0)]
    found = sum(r[1] for r in near(spark, scratch, rows))
    assert found >= 0.9 * sum(r[1] for r in brute_links(rows))


def test_design_holds_recall_at_every_size():
    for n in (2, 100, 10**4, 10**6, 10**10):
        width, k, tables = neighbours.design(n)
        p = neighbours.collision(math.sqrt(2 - 2 * neighbours.COSINE), width)
        assert 1 - (1 - p**k) ** tables >= neighbours.RECALL


def test_keep_first_vectors(spark, scratch):
    rows = [(i, [1.0, 0.001 * i], i) for i in range(5)] + [(9, [0.0, 1.0], 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit(1)).withColumn("kept", F.lit(2))
    kept = neighbours.keep_first(docs, scratch)
    assert kept.columns == docs.columns and sorted(map(repr, (r["vec_id"] for r in kept.collect()))) == ["0", "9", "None"]


# -- whitening --------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["wide", "flat", "equal rows", "diagonal", "close"])
def test_rank_one_updates_equal_a_decomposition(kind):
    rng = np.random.default_rng(4)
    x = {
        "wide": rng.standard_normal((300, 20)) * np.logspace(0, 3, 20),
        "flat": rng.standard_normal((7, 20)) * 100,
        "equal rows": np.repeat(rng.standard_normal((3, 20)) * 100, 40, axis=0),
        "diagonal": np.vstack([np.eye(20), 2 * np.eye(20)]) * 1000,
        "close": 500 + np.round(rng.standard_normal((200, 20))),
    }[kind].astype(np.int64)
    own, other = whitening.Spectrum.empty(20), whitening.Spectrum.empty(20)
    own.add(x[:5])
    own.add(x[5:6])
    other.add(x[6:])
    own.merge(other)
    apart = x - x.mean(axis=0)
    want = apart.T @ apart
    assert own.n == len(x) and (own.total == x.sum(axis=0)).all()
    assert np.allclose(own.basis @ np.diag(own.values) @ own.basis.T, want, atol=1e-11 * np.abs(want).max())
    assert np.allclose(own.basis.T @ own.basis, np.eye(20), atol=1e-11)
    assert np.allclose(own.values, np.linalg.eigvalsh(want), atol=1e-11 * np.abs(want).max())


def test_whitening_equals_numpy(spark, scratch):
    rng = np.random.default_rng(6)
    c = (rng.standard_normal((700, 16)) * np.linspace(0.05, 0.4, 16)).astype(np.float32)
    bad = [(1000, None, 0), (1001, [None] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0], 0), (1004, [], 0)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(c)] + bad + [(None, c[0].tolist(), 1)]
    docs = spark.createDataFrame(rows, VECTORS).repartition(40).withColumn("component", F.lit(1)).withColumn("dim", F.lit("x"))
    got = whitening.whitened(docs, scratch).toPandas()
    x = np.floor(1024 * np.vstack([c, c[:1]]).astype(np.float64)).astype(np.int64) + 100000
    n, total = len(x), x.sum(axis=0)
    apart = x - total / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    white = apart @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    exact = [sum((n * a - s) ** 2 for a, s in zip(r, total.tolist())) for r in x.tolist()]
    for k in range(8):
        part = got[(got["component"] == k + 1) & got["vec_id"].notna()].sort_values("vec_id")
        assert part["deviation"].tolist() == exact[:-1]
        assert np.allclose(part["explained"], values[::-1][k] / values.sum(), rtol=1e-9)
        sign = np.sign(part["whitened"].to_numpy() @ white[:-1, k])
        assert np.allclose(part["whitened"], sign * white[:-1, k], atol=1e-8)
    assert got["vec_id"].isna().sum() == 8


def test_whitening_without_variance_or_rows(spark, scratch):
    assert whitening.whitened(spark.createDataFrame([], VECTORS), scratch).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0)], VECTORS), scratch).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 5, VECTORS), scratch).count() == 0
    line = spark.createDataFrame([(i, [0.1 * i, 0.2], 0) for i in range(9)], VECTORS)
    rows = whitening.whitened(line, scratch).collect()
    assert {r["component"] for r in rows} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in rows)


def test_deviation_beyond_64_bits():
    x, total = np.array([[5, 7], [10**15, -(10**15)]]), np.array([12, 13])
    assert whitening.deviations(x, 2, total) == [(10 - 12) ** 2 + (14 - 13) ** 2, None]


# -- filter audit --------------------------------------------------------------------


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t],
        }
        rows.append((source or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, lines = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                only = sum(r[1] == {f} for r in own)
                lines.append((part, order, step, len(left), len(gone), redundant, only, sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*line, shapley[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "short", "Many CAPITALS HERE", "a # b " * 30, "same words " * 40, " ".join(f"w{i}" for i in range(60)),
             " ".join(f"W{i}" for i in range(90)), " ".join(f"long{i}" for i in range(20_000))]
    docs = [(i if i % 9 else None, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(140)]
    docs += [docs[1], docs[1], (docs[2][0], "w1 w2", "t"), (500, None, "alone")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for name in ("mask", "n", "part", "digest", "labelled"):
        frame = frame.withColumn(name, F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(7))
    got = filter_audit.filter_audit(frame, marks)
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    assert filter_audit.filter_audit(frame.limit(0), marks).count() == 0
    assert filter_audit.filter_audit(frame, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
