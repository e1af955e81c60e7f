"""Near-duplicates, repeated passages and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import plain
from recollect.llm import decontaminate, repeats, simhash
from recollect.llm.components import components
from recollect.llm.words import NOT_ALNUM, Words, gram_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def bits_of(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \x0b", "One", "one TWO", "é É ÀB", "a b c a b c a b c", "x\x1cy z\x85w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == bits_of(text)


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("über word")).alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest("über word".encode(), 42)


def classes_of(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash_classes(docs, scratch):
    rows = simhash.near_duplicates(docs, scratch).collect()
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], set()).add(bits_of(r["text"]))
    for r in rows:
        assert r["fp"] % (1 << 64) in text[r["doc_id"]]
    prints = {r["fp"] % (1 << 64) for r in rows}
    root, least = classes_of(prints), {}
    for r in rows:
        if r["doc_id"] is not None:
            k = root[r["fp"] % (1 << 64)]
            least[k] = min(least.get(k, 1 << 60), r["doc_id"])
    assert len(rows) == docs.count()
    assert all(r["first"]["doc_id"] == least.get(root[r["fp"] % (1 << 64)]) for r in rows)


@pytest.mark.parametrize("compared", [2, simhash.COMPARED])
def test_links_join_all_near_fingerprints(spark, scratch, monkeypatch, compared):
    """Also where a key has more fingerprints than are compared one by one."""
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in sorted(values)[:20]:
        for _ in range(12):
            values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    rows = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(rows, scratch).collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in found)
    want, root = classes_of(values), {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    groups = lambda of: sorted(sorted(v for v in values if of(v) == r) for r in {of(v) for v in values})
    assert groups(find) == groups(want.get)


def test_thresholds_add_up_and_are_the_cheapest():
    costs = [[0, 5, 50], [0, 7, 9], [0, 100, 101]]
    total, chosen = simhash.allocate(costs)
    assert sum(t + 1 for t in chosen) == simhash.TAU + 1
    every = [
        sum(costs[i][t] for i, t in enumerate(x))
        for x in np.ndindex(3, 3, 3) if sum(x) == simhash.TAU + 1
    ]
    assert total == min(every)


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, size=(2000, 64))
    bits[:, 40:48] = bits[:, [0]]
    together = (bits.T @ bits).astype(float)
    group = next(g for g in simhash.correlated_groups(2000, together, 4) if 0 in g)
    assert set(range(40, 48)) <= set(group)
    assert sorted(b for g in simhash.correlated_groups(2000, together, 4) for b in g) == list(range(64))


def test_components(spark, scratch):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + k) for k in range(1, 30)]
    rows = spark.createDataFrame(chain + star + [(7, 7), (500, 501), (501, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(rows, scratch).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[1000 + k] == 1000 for k in range(1, 30)) and got[501] == 500


def test_one_of_each_class_stays(docs, widened, empty, scratch):
    kept = simhash.keep_first(docs, scratch)
    rows = simhash.near_duplicates(docs, scratch).collect()
    assert kept.count() == len({r["first"] for r in rows})
    assert kept.columns == docs.columns
    wide = simhash.keep_first(widened, scratch)
    assert wide.columns == widened.columns and plain(wide, "doc_id") == plain(kept, "doc_id")
    assert simhash.keep_first(empty, scratch).count() == 0


# -- repeated passages ------------------------------------------------------------


def without_repeats(rows, size=50):
    place = lambda i: i if i is not None else 1 << 62
    least = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, 1 << 63), place(i))
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < place(i):
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("rows_at_once", [repeats.BROADCAST_ROWS, 0])
def test_repeats(docs, scratch, monkeypatch, rows_at_once):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", rows_at_once)
    got = plain(repeats.without_repeats(docs, scratch), "doc_id", "n_words", "n_removed", "kept")
    assert got == sorted(map(repr, without_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])))


def test_repeats_where_phrases_repeat_within(spark, scratch):
    same = "tick " * 120
    rows = [(1, same), (2, "tock " * 60 + same), (3, "x " + same + " y"), (4, "tick " * 49), (5, same[:-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = plain(repeats.without_repeats(df, scratch), "doc_id", "n_words", "n_removed", "kept")
    assert got == sorted(map(repr, without_repeats(rows)))


def test_repeats_wide_and_empty(docs, widened, empty, scratch):
    columns = ("doc_id", "n_removed", "kept")
    assert plain(repeats.without_repeats(widened, scratch), *columns) == plain(repeats.without_repeats(docs, scratch), *columns)
    assert repeats.without_repeats(empty, scratch).count() == 0


def test_equal_windows_choose_equal_phrases():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 50, size=3000).astype(np.uint64)
    at, hashes = repeats.chosen_phrases(words)
    assert np.all(hashes == gram_hashes(words, repeats.PHRASE)[at])
    inside = np.zeros(len(words), dtype=bool)
    inside[at] = True
    for k in range(len(words) - repeats.WINDOW + 1):
        assert inside[k : k + repeats.WINDOW - repeats.PHRASE + 1].any()


def test_word_hashes_by_place():
    texts = [b"one two", None, b"", b" two\tone\n", "é x".encode()]
    w = Words(texts)
    h = w.hashes()
    assert [w.data[a:b] for a, b in zip(w.starts, w.ends)] == [b"one", b"two", b"two", b"one", "é".encode(), b"x"]
    assert list(w.bounds) == [0, 2, 2, 2, 4, 6] and h[0] == h[3] and h[1] == h[2] and len(set(h)) == 4
    assert len(Words([], NOT_ALNUM).hashes()) == 0


# -- decontamination ----------------------------------------------------------------


def smith_waterman(a, b):
    """Best score by the textbook recursion."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.OTHER
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
    return max(map(max, h))


def test_alignment_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))], dtype=np.uint64)
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 20))], dtype=np.uint64)
        ours, theirs, length = decontaminate.align(a, b)
        assert np.all(a[ours] == b[theirs]) and np.all(np.diff(ours) > 0) and np.all(np.diff(theirs) > 0)
        if len(ours):
            m, n = ours[-1] - ours[0] + 1, theirs[-1] - theirs[0] + 1
            assert max(m, n) <= length <= m + n
        best = smith_waterman(list(a), list(b))
        assert best >= decontaminate.MATCH * len(ours) - (length - len(ours)) == best


def passage(rng, n):
    return [f"term{rng.randrange(3000)}" for _ in range(n)]


def test_contaminated(spark, scratch):
    rng = random.Random(9)
    items = [(k, passage(rng, n)) for k, n in enumerate([30, 60, 12, 5, 1000])]
    noise = lambda n: passage(rng, n)
    edited = list(items[1][1])
    for k in range(5, 60, 9):
        edited[k] = "changed"
    del edited[20]
    docs = [
        (1, noise(50) + items[0][1] + noise(20)),
        (2, noise(10) + edited),
        (3, noise(400)),
        (4, items[2][1]),
        (5, noise(5) + items[4][1][450:700]),
        (6, noise(3) + items[0][1] + noise(200) + items[0][1]),
        (7, [w.upper() + "," for w in items[3][1]]),
        (8, items[1][1][:6] + noise(80)),
    ]
    rows = [(i, " ".join(w)) for i, w in docs] + [(9, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(50, None), (51, ""), (52, "a b")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (4, 2), (5, 4), (6, 0), (7, 3)}
    assert (got[1, 0]["score"], got[1, 0]["n_match"], got[1, 0]["first_word"], got[1, 0]["last_word"]) == (1.0, 30, 50, 79)
    assert 0.8 <= got[2, 1]["score"] < 1.0
    assert {r["doc_id"] for r in decontaminate.keep_uncontaminated(df, bench, scratch).collect()} == {3, 8, 9, 10}


def found_places(item, text):
    """What is found of one item in one text, in a corpus of a million words."""
    passages = decontaminate.Passages.of([{"item_id": 1, "text": " ".join(item)}])
    passages.weigh(np.zeros(len(passages.vocabulary), dtype=np.int64), 1_000_000)
    return [hit[1:] for _, hit in decontaminate._hits([" ".join(text).encode()], 0, passages)]


@pytest.mark.parametrize("inserted", [0, 3, 12, 20, 39, 45, 400])
def test_split_copy(inserted):
    rng = random.Random(inserted)
    item, other = [f"i{k}" for k in range(40)], lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    (score, n, _, first, last), = found_places(item, other(30) + item[:20] + other(inserted) + item[20:] + other(30))
    assert n == (20 if inserted >= 12 else 40) and score == n / (40 + inserted if n == 40 else 20)
    assert last - first + 1 == (40 + inserted if n == 40 else 20)


def test_half_edited_copies():
    item = [f"i{k}" for k in range(40)]
    worse = [w if k % 2 else f"o{k}" for k, w in enumerate(item)]
    for text in (item[:20] + worse[20:], worse[:20] + item[20:], worse[:12] + item[12:28] + worse[28:]):
        (score, n, *_), = found_places(item, ["x"] * 9 + text + ["y"] * 9)
        assert score >= 0.8 and n >= 16
    assert found_places(item, worse) == []


def test_exact_core_beside_a_better_alignment():
    item = [f"i{k}" for k in range(80)]
    weak = [w for k, w in enumerate(item[20:]) for w in ([w] if k % 3 else [w, f"o{k}", f"p{k}"])]
    text = item[:14] + [f"q{k}" for k in range(40)] + [w if k % 5 < 3 else f"r{k}" for k, w in enumerate(weak)]
    (score, n, _, first, _), = found_places(item, text)
    assert score >= 0.8 and n >= 13


def test_copy_in_a_long_text_of_seeds():
    """Every second word run is a seed; windows are bounded and the copy lies across two of them."""
    item = [f"i{k}" for k in range(40)]
    span = 52
    for shift in range(3 * span - 20, 4 * span + 20, 7):
        filler = [w for k in range(shift // 5 + 1) for w in (*item[5:8], f"o{k}", f"p{k}")][:shift]
        (score, n, *_), = found_places(item, filler + item + [w for k in range(200) for w in (*item[30:33], f"s{k}", f"t{k}")])
        assert score >= 0.8 and n >= 40
    assert max(b - a for a, b in decontaminate._windows(0, 10**6, 400)) < 2100


def test_contaminated_in_slices_and_empty(spark, docs, widened, empty, scratch, monkeypatch):
    bench = spark.createDataFrame(
        [(k, r["text"][:400]) for k, r in enumerate(docs.where("length(text) > 500").orderBy("doc_id", "text").limit(4).collect())],
        "item_id long, text string",
    )
    whole = plain(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "n_match")
    assert len(whole) >= 4
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 500)
    assert plain(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "n_match") == whole
    assert plain(decontaminate.contaminated(widened, bench.withColumn("row", F.lit(1))), "doc_id", "item_id", "n_match") == whole
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.keep_uncontaminated(widened, bench, scratch).columns == widened.columns


@pytest.mark.parametrize("total", [10**4, 10**6, 10**9, 10**12])
@pytest.mark.parametrize("often", [1 / 3000, 1 / 30])
@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_whole_items_are_found_at_every_size(total, often, size):
    """Short items of common words: nothing but the whole item tells."""
    item = [f"c{k}" for k in range(size)]
    passages = decontaminate.Passages.of([{"item_id": 7, "text": " ".join(item)}])
    passages.weigh(np.full(len(passages.vocabulary), int(total * often)), total)
    text = " ".join([f"x{k}" for k in range(30)] + item + ["y"])
    hits = [hit for _, hit in decontaminate._hits([text.encode()], 0, passages)]
    assert hits == [(7, 1.0, size, size, 30, 30 + size - 1)]
    if size < 5:  # four of five words are enough where they are rare
        assert not list(decontaminate._hits([" ".join(["a", *item[:-1], "b"]).encode()], 0, passages))


def test_no_edit_hits_all_seeds():
    """One rare word holds all runs that chance would not give; without it the copy is still found."""
    words = [f"common{k}" for k in range(30)]
    item = words[:15] + ["rare"] + words[15:]
    passages = decontaminate.Passages.of([{"item_id": 1, "text": " ".join(item)}])
    total = 10**9
    counts = np.where(passages.vocabulary == decontaminate.Words([b"rare"], decontaminate.NOT_ALNUM).hashes()[0], 1, total // 3000)
    passages.weigh(counts, total)
    hits = [hit for _, hit in decontaminate._hits([" ".join(words[:15] + ["other"] + words[15:]).encode()], 0, passages)]
    assert len(hits) == 1 and hits[0][2] == 30
