"""Quality rules and mixing against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import plain
from recollect.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "  ", "a b c d e a b c d e", "x\nx\n \n\ny x", "# one * two $%&|<>", "é ü\x0bß\x0cç", "a " * 40, "a b c d",
    "one two three four five six one two three four five seven",
]


def test_counts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select("i", quality.statistics(F.col("text")).alias("s"))
    for r in rows.collect():
        s = r["s"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == counted(TEXTS[r["i"]])


def test_scores(docs, scratch):
    rows = quality.scored(docs, scratch).collect()
    assert len(rows) == docs.count()
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], []).append(r["text"])
    for r in rows:
        assert any((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(t) for t in text[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_outlier_goes_and_clean_stays(spark, scratch):
    clean = [(i, " ".join(f"word{(i * 31 + k * 17) % 997}" for k in range(60 + i % 50)), "en", "s", 0) for i in range(200)]
    junk = [(1000 + i, " ".join(f"x{(i * 7 + k) % 499}$$%%&&" for k in range(90)), "en", "s", 0) for i in range(10)]
    rows = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality.keep_good(rows, scratch).collect()}
    assert kept == {r[0] for r in clean}


def test_moderate_junk_goes_as_surely_as_clean_stays(spark, scratch):
    """Some four to nine of a hundred characters are symbols, in texts of 40 to 90 words."""
    say = lambda i, k: f"word{(i * 31 + k * 17) % 997}"
    rest = [(i, " ".join(say(i, k) for k in range(40 + i % 50)), "en", "s", 0) for i in range(300)]
    clean = [(1000 + i, " ".join(say(i, k + 5) + ("," if k % 9 == i % 9 else "") for k in range(40 + i)), "en", "s", 0) for i in range(50)]
    junk = [
        (2000 + i, " ".join(say(i, k + 3) + ("" if k % 3 else " |" if i % 2 else " #$") for k in range(40 + i)), "en", "s", 0)
        for i in range(50)
    ]
    rows = spark.createDataFrame(rest + clean + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality.keep_good(rows, scratch).collect()}
    assert kept == {r[0] for r in rest + clean}


def test_distances_of_clean_normal_rows_are_chi_squared(spark, scratch):
    """The cut is a quantile only if the estimates and the distances mean the same scatter."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = rng.integers(20, 400, 6000)
    own = rng.normal(size=(6000, 5)) * np.sqrt(1 + quality.SIZE / n)[:, None] * 3
    names = ["n_words", *quality.VECTOR]
    rows = spark.createDataFrame([(*quality.GROUP, int(a), *map(float, b)) for a, b in zip(n, own)], "lang_key string, source_key string, n_words long, " + ", ".join(f"{v} double" for v in quality.VECTOR))
    groups = rows.select(*quality.GROUP).distinct()
    estimate = quality._pooled(quality._moments(rows.select(*quality.GROUP, *names)), groups, 1.0)
    got = np.array([r["distance"] for r in quality._with_distance(rows, estimate).select("distance").collect()])
    assert abs(np.median(got) - 4.35) < 0.3 and np.mean(got > quality.CUT) < 0.001


def test_group_of_equal_rows_has_no_scatter(spark, scratch):
    rows = spark.createDataFrame(
        [(i, "the very same words stand here in each of all these documents today", "en", "s", 0) for i in range(30)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    assert quality.scored(rows, scratch).where("kept").count() == 30


@pytest.mark.parametrize("operator", [quality.keep_good, mixing.mix_documents])
def test_columns_and_empty(operator, docs, widened, empty, scratch):
    few, wide = operator(docs, scratch), operator(widened, scratch)
    assert wide.columns == widened.columns and few.columns == docs.columns
    assert plain(few, "doc_id", "text") == plain(wide, "doc_id", "text")
    assert operator(empty, scratch).collect() == []


def water_level(sizes, weights, budget):
    """Shares by weight; whoever is above its cap stays there and the rest is shared anew."""
    out, free = {}, set(sizes)
    while free:
        left = budget - sum(out.values())
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
        free -= set(over)
    return out


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 7, None: 90}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = water_level(sizes, weights, 1.5 * sum(sizes.values()))
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in sizes)


def test_mix(docs, scratch):
    rows = mixing.mixed(docs, scratch).collect()
    assert len(rows) == docs.count()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r["copies"] in (0, 1, 2) and (r["size"] > 0 or r["copies"] == 0)
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    total = sum(r["size"] for r in rows)
    assert sum(taken.values()) <= 1.5 * total
    for s in target:
        assert abs(taken[s] - target[s]) <= sum(largest.values())
    again = mixing.mixed(docs, scratch).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mix_is_a_prefix_of_the_finish_times(docs, scratch):
    """The mix takes what an ordinary sort by finish time takes up to the budget."""
    rows = mixing.mixed(docs, scratch)
    timed = mixing.virtual_times(
        docs.select(
            "doc_id", mixing.row_hash(docs).alias("row"), "source", mixing.word_count(F.col("text")).alias("size"),
            F.md5(F.concat_ws(":", F.lit("17"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("shuffle"),
        ),
        mixing.targets(docs.select("source", mixing.word_count(F.col("text")).alias("size"))),
    ).collect()
    passes = sorted(
        (((r["reached"] + e * r["source_size"]) / r["target"], r["source"] is None, r["source"] or "", r["doc_id"] is None, r["doc_id"] or 0, e, r["size"], r["row"], r["reached"]))
        for r in timed for e in (0, 1) if r["size"]
    )
    budget, want = 1.5 * sum(r["size"] for r in timed), Counter()
    for p in passes:
        budget -= p[6]
        if budget < 0:
            break
        want[p[7]] += 1
    got = Counter()
    for r in rows.collect():
        got[r["row"]] += r["copies"]
    assert +got == want


# -- the estimates against numpy ------------------------------------------------------


def reference_scores(rows):
    """The verdict of ``scored`` over measured rows, in numpy: starting values, steps, reweighting."""
    import numpy as np

    names, floors = list(quality.VECTOR), np.array(list(quality.VECTOR.values()))
    key = [(r["lang_key"], r["source_key"]) for r in rows]
    x = np.array([[r[v] for v in names] for r in rows], dtype=float)
    n = np.array([r["n_words"] for r in rows], dtype=float)
    w, good = n / (n + quality.SIZE), np.array([not r["base_failed"] for r in rows])
    groups = sorted(set(key))
    member = {g: np.array([k == g for k in key]) for g in groups}

    def distances(estimate):
        out = np.full(len(rows), np.nan)
        for g in groups:
            if estimate[g] is not None:
                mean, scatter = estimate[g]
                apart = x[member[g]] - mean
                out[member[g]] = np.einsum("ij,jk,ik->i", apart, np.linalg.inv(scatter), apart) * w[member[g]]
        return out

    def pooled(chosen, consistent):
        def sums(rows_):
            s = rows_ & chosen
            return np.concatenate([[s.sum(), w[s].sum()], w[s] @ x[s], (x[s].T @ (x[s] * w[s][:, None])).ravel()])

        every, out = sums(np.ones(len(rows), dtype=bool)), {}
        for g in groups:
            lang = sums(np.array([k[0] == g[0] for k in key]))
            own = sums(member[g])
            up = (lang + quality.PULL * every / every[0]) / (lang[0] + quality.PULL)
            mixed = (own + quality.PULL * up) / (own[0] + quality.PULL)
            total, first, second = mixed[1], mixed[2:7], mixed[7:].reshape(5, 5)
            out[g] = first / total, (second - np.outer(first, first) / total) * consistent + np.diag(total * floors**2)
        return out

    estimate = {}
    for g in groups:
        own = x[member[g] & good]
        if len(own):
            q = np.quantile(own, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
            estimate[g] = q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, floors) ** 2)
        else:
            estimate[g] = None
    for _ in range(quality.STEPS):
        d = distances(estimate)
        bins = np.floor(np.clip(np.log(d + 1e-12), -20, 40) * 16)
        chosen = np.zeros(len(rows), dtype=bool)
        for g in groups:
            own = np.flatnonzero(member[g] & good & ~np.isnan(d))
            if len(own):
                last = np.sort(bins[own])[max(0, int(np.ceil(len(own) * quality.KEEP)) - 1)]
                chosen[own[bins[own] <= last]] = True
        estimate = pooled(chosen, quality.CONSISTENT)
    with np.errstate(invalid="ignore"):
        within = good & (distances(estimate) <= quality.WITHIN)
    return distances(pooled(within, quality.WITHIN_CONSISTENT))


def test_distances_equal_numpy(spark, scratch):
    import numpy as np

    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        n = int(rng.integers(3, 120))
        kinds = [f"word{rng.integers(500)}", f"Word{rng.integers(500)},", f"#{rng.integers(90)}", "again"]
        text = " ".join(rng.choice(kinds, p=[0.7, 0.2, 0.02, 0.08]) for _ in range(n))
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "a", "b", "c"][i % 4] if i < 890 else "tiny", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    measured = scratch.keep(quality.measured(docs)).collect()
    want = dict(zip([r["doc_id"] for r in measured], reference_scores(measured)))
    got = {r["doc_id"]: r for r in quality.scored(docs, scratch).collect()}
    assert len(got) == len(want)
    for i, d in want.items():
        r = got[i]
        assert math.isclose(r["distance"], d, rel_tol=1e-6, abs_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and d <= quality.CUT)


@pytest.mark.parametrize("texts", [[None, "few words"], [None], ["a b c " * 60] * 3])
def test_no_sound_document(spark, scratch, texts):
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = quality.scored(docs, scratch).collect()
    assert len(rows) == len(texts) and all(r["base_failed"] and not r["kept"] and r["distance"] is None for r in rows)
    assert quality.keep_good(docs, scratch).count() == 0


def test_single_group_of_equal_rows(spark, scratch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)), None, None, 0)] * 4, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["kept"] for r in quality.scored(docs, scratch).collect()] == [True] * 4


def test_no_window_over_everything(docs, scratch):
    moments = scratch.keep(quality._moments(quality.measured(docs)))
    groups = moments.select(*quality.GROUP)
    plan = quality._pooled(moments, groups, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
