"""Sets that are alike, found in groups that batches cut anyhow."""

import random

import pyarrow as pa
import pytest

from recollect.functions import batches
from recollect.operators import similarity
from recollect.session import Scratch


def test_prefixes_are_sent_on_in_shares():
    """A share of a batch of many sets, not all of it, is held and sent at once."""
    rows = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([[k] for k in range(2000)], pa.list_(pa.int64()))], ["node", "grams"])
    assert [s.num_rows for s in batches.list_shares(rows, "grams")] == [500] * 4
    assert [s.num_rows for s in batches.list_shares(rows.slice(700, 600), "grams")] == [500, 100]


def test_a_gram_of_a_prefix_is_sent_once(spark):
    """Bands are for crowded grams alone."""
    sets = {k: list(range(100 * k, 100 * k + 10 + k)) for k in range(1, 30)}
    with Scratch(spark) as scratch:
        df = scratch.keep(spark.createDataFrame(list(sets.items()), "node long, grams array<long>"))
        entries = scratch.keep(similarity.prefixes(df, similarity.gram_counts(df), 0.85))
        assert entries.count() == sum(similarity.prefix_length(len(x), 0.85) for x in sets.values())
        assert [tuple(r) for r in similarity._dealt(entries, scratch).select("band", "c1", "c2").distinct().collect()] == [(-1, 0, 0)]


@pytest.mark.parametrize("block, at_once", [(512, 1 << 17), (3, 7)])
@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_are_all_pairs(spark, monkeypatch, block, at_once, seed):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "_PAIRS", at_once)
    rng = random.Random(seed)
    bases = [rng.sample(range(1, 300), rng.choice([4, 12, 30, 60])) for _ in range(8)]
    sets = [[]]
    for _ in range(120):
        own = [g for g in rng.choice(bases) if rng.random() > rng.choice([0, 0.04, 0.1])]
        sets.append(sorted({*own, *rng.sample(range(1, 300), rng.choice([0, 1, 3]))}))
    sets = [list(x) for x in dict.fromkeys(map(tuple, sets))]
    expected = {
        (i, j): len({*a} & {*b}) / len({*a} | {*b})
        for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (a or b)
    }
    expected = {k: v for k, v in expected.items() if v >= 0.85}
    with Scratch(spark) as scratch:
        df = scratch.keep(spark.createDataFrame(list(enumerate(sets)), "node long, grams array<long>"))
        got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, scratch, 0.85).collect()}
    assert len(expected) > 20 and got == pytest.approx(expected)


def test_small_batches_are_joined():
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000))], ["k"])
    uses = []
    list(similarity.whole_groups(["k"], lambda whole: iter(uses.append(sum(b.num_rows for b in whole)) or ()))(rows.slice(k, 10) for k in range(0, 3000, 10)))
    assert uses == [3000]


@pytest.mark.parametrize("together", [1, 5, 1 << 15])
@pytest.mark.parametrize("cuts", [[], [1], [4, 5, 9], list(range(1, 12))])
def test_groups_are_whole_however_batches_cut_them_and_join_them(monkeypatch, cuts, together):
    monkeypatch.setattr(similarity, "_TOGETHER", together)
    test_groups_are_whole_however_batches_cut_them(cuts)


@pytest.mark.parametrize("cuts", [[], [1], [4, 5, 9], list(range(1, 12))])
def test_groups_are_whole_however_batches_cut_them(cuts):
    keys = [1, 1, 2, 3, 3, 3, 3, 4, 4, 5, 6, 6]
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(12))], ["k", "v"])
    ends = [0, *cuts, 12]
    seen = []

    def use(whole):
        for batch in whole:
            seen.append(batch.to_pydict())
        return iter(())

    list(similarity.whole_groups(["k"], use)(rows.slice(a, b - a) for a, b in zip(ends, ends[1:])))
    assert sum((x["v"] for x in seen), []) == list(range(12))
    assert all({*x["k"]}.isdisjoint(y["k"]) for n, x in enumerate(seen) for y in seen[:n])
