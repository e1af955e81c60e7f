"""Licence scan, language identification and the pipeline."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_fixtures import DOCS
from recollect.llm import langid, license, quality, rules, simhash
from recollect.llm.base import table
from recollect.session import Scratch

BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
TEXTS = [
    None, "", "...", "All rights reserved.", "ALL   Rights--Reserved all rights reserved", "cc by, CC-BY and cc\nby 4.0", "ccby cc bye acc by",
    "éall rights reserved", "gnu general public license, general public license", "licensed under the Apache License, Version 2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later", "see http://creativecommons.org/licenses/by-sa/4.0", "ÀLL rights reserved",
    "all rights all rights reserved reserved", "x " * 40_000 + "general public license",
]


def test_base_places(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, size string")
    rows = {r["doc_id"]: r for r in license.scanned(df).collect()}
    assert len(rows) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(i, label) for p, label in BASE.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        at = [i for i, _ in places]
        r = rows[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert license.scanned(df.limit(0)).count() == 0


def labels(text):
    return [(d.rule.label, d.rule.form) for d in license.scan(text.encode())[1]]


@pytest.mark.parametrize("expression, want", [
    ("mit or apache-2.0", ["mit", "apache"]),
    ("(mit and (bsd-3-clause or\n *    gpl-2.0-or-later with classpath-exception-2.0)) or isc", ["mit", "bsd", "gpl", "isc"]),
    ("licenseref-own or mpl-2.0+ */", ["mpl"]),
    ("gpl-2.0-only with mit", ["gpl"]),
    ("mit\nor isc", ["mit"]),
    ("mit-0 or zlib.", ["zlib"]),
    ("mit mit license", ["mit", "mit"]),
])
def test_spdx_expressions(expression, want):
    assert [x for x, _ in labels("// spdx-license-identifier: " + expression)] == want


def test_wrapped_in_deep_comments():
    deep = "\n" + " " * 40 + "*" + " " * 9
    for text in ("permission is hereby granted,\n * free of charge", f"licensed under{deep}the apache license", f"apache license,{deep}version 2.0"):
        assert labels(text) == [(x, form) for x, form in labels(" ".join(text.replace("*", " ").split()))] != []
    assert labels(f"permission is hereby granted,{deep}free of charge") == [("mit", "sentence")]
    assert labels("licensed" + " \n" * 200_000) == []


def test_rules():
    found = rules.build()
    assert len(found) > 300 and [r.priority for r in found] == list(range(len(found)))
    assert labels("licensed under the apache license, version 2.0") == [("apache", "grant"), ("apache", "version")]
    assert labels("gnu lesser general public license") == [("lgpl", "name")]  # not also the gpl inside it
    assert labels("spdx-license-identifier: mit") == [("mit", "tag")]
    assert labels("the creative commons attribution-sharealike licence") == [("cc-by-sa", "name")]
    assert labels("permission is hereby granted, free of charge, to any person") == [("mit", "sentence")]
    assert labels("the word license alone") == []


def test_gated_rules_find_what_all_rules_find():
    rng = random.Random(1)
    parts = [f.names[0] for f in rules.FAMILIES] + [p for f in rules.FAMILIES for p in f.phrases] + ["cc by", "version 2.0", "licensed under the"]
    for _ in range(30):
        text = ", ".join(rng.choice(parts) for _ in range(8)).encode()
        every = license.settle([license.Detection(r, *m.span()) for r in rules.build() for m in r.pattern.finditer(text)])
        key = lambda d: (d.start, d.end, d.rule.label, d.rule.form)
        assert sorted(map(key, license.scan(text)[1])) == sorted(map(key, every))


def test_settling_against_all_pairs():
    rng, made = random.Random(2), rules.build()
    for _ in range(50):
        found = []
        for _ in range(25):
            start = rng.randrange(60)
            found.append(license.Detection(rng.choice(made), start, start + rng.randrange(1, 15)))
        kept = []
        for d in sorted(found, key=lambda d: (d.rule.priority, -(d.end - d.start), d.start)):
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        inside = lambda d, k: k is not d and k.rule.label == d.rule.label and k.start <= d.start and d.end <= k.end
        want = [d for d in kept if not any(inside(d, k) and (k.start, -k.end) <= (d.start, -d.end) for k in kept)]
        got = license.settle(found)
        span = lambda d: (d.start, d.end, d.rule.label)
        assert sorted(set(map(span, got))) == sorted(set(map(span, want)))


# -- languages ----------------------------------------------------------------------

SYLLABLES = {"en": "the ing and tion her", "de": "ein sch ung der cht", "fr": "eau les que ent oux"}


def prose(rng, lang, n=40):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    docs, pages = [], []
    for i in range(150):
        lang = rng.choice(list(SYLLABLES))
        docs.append((i, prose(rng, lang), lang.upper() + "-x" if i % 9 else None, f"{lang}host", 0))
    docs += [(900, None, "de", None, 0), (901, "", None, "dehost", 0), (902, prose(rng, "en"), "de", "enhost", 0), docs[3]]
    for i in range(60):
        lang = rng.choice(list(SYLLABLES))
        pages.append((i, f"https://{lang}.site.example/{i}", f'<html lang="{lang}"><script>x</script><body>{prose(rng, lang)}</body>'))
    pages += [(900, "https://fr.site.example/x", None), (901, "http://shop.de", "<html><p>"), (902, None, None), (903, "not an address", "<script>")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(pages, "page_id long, url string, html string")


def test_languages(tables, scratch):
    docs, pages = tables
    rows = langid.languages_of(docs, pages, scratch).collect()
    assert len(rows) == docs.count() + pages.count()
    got = {(r["kind"], r["id"]): r["lang"] for r in rows}
    want = {("document", r["doc_id"]): r["source"][:2] for r in docs.collect() if r["doc_id"] < 900}
    want |= {("page", r["page_id"]): r["url"][8:10] for r in pages.collect() if r["page_id"] < 900}
    assert sum(got[k] == v for k, v in want.items()) >= 0.98 * len(want)
    assert got["document", 900] == "de"  # declared only
    assert got["document", 901] == "de"  # host only
    assert got["document", 902] == "en"  # text against its declaration
    assert got["page", 900] == "fr"  # host only
    assert all(r["lang"] is not None and 0 <= r["confidence"] <= 1 for r in rows)


def test_votes_by_host(tables, scratch):
    docs, pages = tables
    languages, model = langid.trained(docs)
    assert languages == ["de", "en", "fr"]
    rows = langid.evidence(pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"), "url", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host")), languages, model)
    votes = Counter((r["host"], r["vote"]) for r in rows.collect())
    for r in langid.priors(rows, languages, scratch).collect():
        assert r["host_votes"] == [votes[r["h"], x] for x in languages]
        tail = ".".join(r["h"].split(".")[-2:])
        assert r["domain_votes"] == [sum(n for (h, v), n in votes.items() if h and v == x and ".".join(h.split(".")[-2:]) == tail) for x in languages]


def test_languages_without_rows_or_labels(tables, empty, scratch):
    docs, pages = tables
    assert langid.languages_of(empty, pages.limit(0), scratch).count() == 0
    rows = langid.languages_of(docs.withColumn("lang", F.lit(None).cast("string")), pages, scratch).collect()
    assert len(rows) == docs.count() + pages.count() and all(r["lang"] is None for r in rows)
    wide = docs.select("*", *[F.lit("x").alias(c) for c in ("host", "kind", "id", "url", "declared", "score")])
    assert langid.languages_of(wide, pages, scratch).count() == docs.count() + pages.count()


def test_markup():
    assert langid.visible("a<b>c</b><!-- x > --><style>p{}</style>d &amp; e<script>if (a<b) x</SCRIPT>f").split() == ["a", "c", "d", "&", "e", "f"]
    assert langid.visible("a<script>never closed <p>").split() == ["a"] and langid.visible(None) == ""
    assert langid.declared_language("<!DOCTYPE html><HTML class=x LANG='De-at'>") == "de" and langid.declared_language("<p lang=fr>") is None
    assert langid.host_of("HTTPS://u:p@Www.Example.de:80/x?y") == "www.example.de" and langid.host_of("x") is None


# -- pipeline -----------------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = docs.where("length(text) between 300 and 900").orderBy("doc_id", "text").limit(2)
    bench.select(F.monotonically_increasing_id().alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now, seen = table(spark, str(tmp_path), "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = now.collect()
        if k < 4:
            assert now.columns == docs.columns
            assert now.select("doc_id").subtract(before.select("doc_id")).count() == 0
    with Scratch(spark) as s:
        good = quality.scored(docs, s).where("kept")
        assert sorted(map(repr, (r["doc_id"] for r in seen["quality_rules"]))) == sorted(map(repr, (r["doc_id"] for r in good.collect())))
    prints = [simhash.fingerprint(r["text"]) for r in seen["simhash_dedup"]]
    assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(prints) for b in prints[:i])
    items = [" ".join(re.findall(r"[0-9a-z]+", r["text"].lower())) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    for r in seen["benchmark_decontamination"]:
        assert not any(x in " ".join(re.findall(r"[0-9a-z]+", r["text"].lower())) for x in items)
    times = Counter(r["doc_id"] for r in seen["mix_sources"])
    assert set(times.values()) <= {1, 2}
    tokens = Counter(r["doc_id"] for r in seen["token_output"])
    assert tokens == times
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(repr, seen["token_output"]))


def test_settling_equals_trying_all_pairs_and_stays_linear():
    import random
    import time

    rules = list(license._compiled()[3].values())[:6]
    rng = random.Random(3)
    for _ in range(200):
        found = []
        for _ in range(rng.randrange(12)):
            start = rng.randrange(30)
            found.append(license.Detection(rng.choice(rules), start, start + rng.randrange(1, 20)))
        ordered, kept = sorted(found, key=lambda d: (d.rule.priority, -(d.end - d.start), d.start)), []
        for d in ordered:
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        got = license.settle(found)
        assert all(d in kept for d in got)
        for d in kept:  # what is left out reaches no further than one of its label that is told
            assert d in got or any(k.rule.label == d.rule.label and k.start <= d.start and k.end >= d.end for k in got)
    texts = [("mit license a " * n + "zlib " + "x " * (3 * n) + "license").encode() for n in (4000, 16000)]
    spent = []
    for text in texts:
        started = time.process_time()
        license.scan(text)
        spent.append(time.process_time() - started)
    assert spent[1] < 10 * spent[0]
