"""The registered queries over whole small tables: columns of their contracts, and brute force."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
from recollect.llm import tokens
from test_native import counted
from test_similar import bits_of, classes_of, without_repeats

COLUMNS = {
    "op1_language_id": ["doc_id", "page_id", "lang"],
    "op2_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op4_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_repeated_passages": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_decontaminate": ["doc_id", "item_id", "score"],
    "op10_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
}
NUMBERS = {"n_words", "n_base", "first_word", "last_word", "payload_bytes", "start", "n_tokens", "ids_crc32", "n_removed", "n_bytes", "component_id", "size", "source_size", "taken", "refers_to"}


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Tables whose ids are unique, as the contracts take them."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{out}/documents.parquet")
    pages = docs.where("doc_id < 90").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("page_id"), F.lit("http://x.example/").alias("url"), F.col("text").alias("html"))
    pages.write.parquet(f"{out}/pages.parquet")
    bench = docs.where("length(text) between 150 and 400").orderBy("doc_id").limit(3)
    bench.select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark, folder):
    """Each query's rows, and a check of its columns and types."""
    out = {}
    for name, columns in COLUMNS.items():
        df = contract.queries()[name](spark, folder)
        assert df.columns[: len(columns)] == columns, name
        types = dict(df.dtypes)
        assert all(types[c] == "bigint" for c in columns if c in NUMBERS), types
        out[name] = df.collect()
    return out


def by_id(rows):
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_token_queries(results, texts):
    library, at = Tokenizer.from_file(tokens.tokenizer_path()), 0
    files, counts = by_id(results["op4_token_files"]), by_id(results["op7_token_counts"])
    assert files.keys() == counts.keys() == texts.keys()
    for i in sorted(texts):
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids
        assert tuple(counts[i]) == (i, len((texts[i] or "").encode()), len(ids), len(ids) > 2048)
        assert tuple(files[i]) == (i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += len(ids) + 1


def test_repeats_query(results, texts):
    import hashlib

    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in without_repeats(list(texts.items()))}
    assert {r["doc_id"]: tuple(r)[1:] for r in results["op5_repeated_passages"]} == want


def test_quality_query(results, texts):
    for i, r in by_id(results["op6_quality_rules"]).items():
        assert tuple(r)[1:6] == counted(texts[i])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_simhash_query(results, texts):
    prints = {i: bits_of(t) for i, t in texts.items()}
    root, least = classes_of(set(prints.values())), {}
    for i, p in prints.items():
        least[root[p]] = min(least.get(root[p], i), i)
    assert {r["doc_id"]: tuple(r)[1:] for r in results["op8_simhash"]} == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}


def test_decontamination_query(spark, folder, results, texts):
    words = lambda t: " " + " ".join(re.findall(r"[0-9a-z]+", (t or "").lower())) + " "
    bench = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    exact = {(i, k) for i, t in texts.items() for k, x in bench.items() if x in words(t)}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in results["op9_decontaminate"]}


def test_other_queries_have_a_row_for_each(spark, folder, results, texts):
    assert len(results["op1_language_id"]) == len(texts) + spark.read.parquet(f"{folder}/pages.parquet").count()
    assert by_id(results["op2_license_scan"]).keys() == by_id(results["op10_mix_sources"]).keys() == texts.keys()
