import math

import oracle
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import text as X

SAMPLES = [
    "", " ", "\t﻿　", "hello world", "a\U0001f600b c", "x" * 400, "x" * 100, "one two three four five six seven eight nine",
    "\u0085 not a space in ECMAScript", "ÉCOLE à Paris", "a b c d e f g h", "same same same same same same same same",
]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")


def test_lengths_tokens_shingles_follow_the_definition(spark):
    t = F.col("t")
    rows = _frame(spark, SAMPLES).select("t", X.estimate_tokens(t), X.word_count(t), X.shingles(t), X.utf16_length(t), X.words(t)).collect()
    for text, tokens, n_words, grams, units, words in rows:
        assert tokens == oracle.tokens(text)
        assert n_words == len(oracle.words(text))
        assert words == oracle.words(text)
        assert set(grams) == oracle.shingles(text) and len(grams) == len(set(grams))
        assert units == len(text.encode("utf-16-le")) // 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), min_size=20, max_size=20))
def test_any_text(spark, texts):
    t = F.col("t")
    rows = _frame(spark, texts).select("t", X.estimate_tokens(t), X.words(t), X.trim(t), X.is_blank(t)).collect()
    for text, tokens, words, trimmed, blank in rows:
        assert tokens == oracle.tokens(text)
        assert words == oracle.words(text)
        assert trimmed == text.strip(oracle.SPACE)
        assert blank == (not oracle.words(text))


def test_shingle_hashes_agree_with_shingles(spark):
    pairs = [(a, b) for a in SAMPLES for b in SAMPLES]
    df = spark.createDataFrame(pairs, "a string, b string")
    by_text = X.jaccard(X.shingles(F.col("a")), X.shingles(F.col("b")))
    by_hash = X.jaccard(X.shingle_hashes(F.col("a")), X.shingle_hashes(F.col("b")))
    for a, b, x, y in df.select("a", "b", by_text, by_hash).collect():
        assert x == y
        assert math.isclose(x, oracle.jaccard(oracle.shingles(a), oracle.shingles(b)))


def test_tags_and_projects(spark):
    df = _frame(spark, ["Work, project-alpha  work", "", " ,, \t", "A b"])
    tags = [r[0] for r in df.orderBy("i").select(X.parse_tags(F.col("t"))).collect()]
    assert tags == [["work", "project-alpha"], [], [], ["a", "b"]]
    names = [r[0] for r in _frame(spark, [" x ", "\t﻿", "", "a b"]).orderBy("i").select(X.normalize_project(F.col("t"))).collect()]
    assert names == ["x", "default", "default", "a b"]
    assert spark.range(1).select(X.normalize_project(F.lit(None).cast("string"))).first()[0] == "default"


def test_languages(spark):
    want = {"a.go": "go", "b.JSX": "js", "c.mjs": "js", "d.cjs": "js", "e.ts": "ts", "f.tsx": "ts", "g.py": "python", "h.pyi": "python", "i.md": "text", "Makefile": "text", "go": "go", "x.": "text"}
    rows = spark.createDataFrame([(k,) for k in want], "p string").select("p", X.detect_language(F.col("p"))).collect()
    assert dict(map(tuple, rows)) == want


def test_embed_text_clip_and_header(spark):
    lit = F.lit
    row = spark.range(1).select(
        X.embed_text(lit("a/b.go"), lit(3), lit(9), lit("func"), lit("Run"), lit("body")),
        X.embed_text(lit("a.md"), lit(1), lit(2), lit("lines"), lit(""), lit("x")),
        X.clip(lit("ab\U0001f600c"), 3),
        X.clip(lit("ab\U0001f600c"), 4),
        X.hit_header(lit(7), lit("code"), lit("a.go"), lit(1), lit(2)),
        X.hit_header(lit(7), lit("manual"), lit(None).cast("string"), lit(None).cast("int"), lit(None).cast("int")),
    ).first()
    assert tuple(row) == ("a/b.go:3-9 func Run\nbody", "a.md:1-2 lines\nx", "ab", "ab\U0001f600", "[7] (a.go:1-2) ", "[7] (manual) ")
