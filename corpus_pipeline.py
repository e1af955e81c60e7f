"""The corpus pipeline: each stage works on what the one before it kept.

1. quality rules: documents that the base rule or the robust outlier test rejects go;
2. SimHash near-duplicates within a wide radius, verified by five-word shingles: of each class the
   document with the smallest id stays;
3. benchmark decontamination: documents that hold a benchmark passage go;
4. mixing: sources are read in proportion to their targets, some documents twice, some not at all;
5. token files: what is left is tokenized, coded, written in order and read back.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return the columns
of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import decontaminate, mixing, near_text, quality, token_files
from recollect.llm.base import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, Scratch(spark))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_text.keep_first(docs, Scratch(spark))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, Scratch(spark))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_files(docs, Scratch(spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: SQL has neither the estimates' iterations nor the tokenizer; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
