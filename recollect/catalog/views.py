"""The test tables in the roles the engine gives them.

documents are notes (project = source, tag = lang), conversations are chunks of one
project (a file per conversation, overlapping line ranges), benchmark texts are
queries, pages are files, embeddings are vectors (project = label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.embedding import HashingEmbedder, embed
from recollect.functions.text import content_hash
from recollect.session import prepare, spread

EMBEDDER = HashingEmbedder()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For work on whole texts: all cores even where the table is one small file."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def notes(spark: SparkSession, sf_dir: str, whole_texts: bool = False) -> DataFrame:
    source = documents(spark, sf_dir) if whole_texts else table(spark, sf_dir, "documents")
    return source.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("project"),
        F.lit("manual").alias("kind"),
        "text",
        F.array("lang").alias("tags"),
        F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("int").alias("line_start"),
        F.lit(None).cast("int").alias("line_end"),
        content_hash(F.col("text")).alias("content_hash"),
    )


def turns(spark: SparkSession, sf_dir: str, whole_texts: bool = False) -> DataFrame:
    """Eight-line chunks, five lines apart, so that neighbours overlap."""
    source = table(spark, sf_dir, "conversations")
    source = spread(source, "conv_id", "turn") if whole_texts else source
    return source.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("id"),
        F.lit("talk").alias("project"),
        F.lit("code").alias("kind"),
        "text",
        F.array("role").alias("tags"),
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("file_path"),
        (F.col("turn") * 5 + 1).cast("int").alias("line_start"),
        (F.col("turn") * 5 + 8).cast("int").alias("line_end"),
        content_hash(F.col("text")).alias("content_hash"),
    )


def embedded(rows: DataFrame) -> DataFrame:
    """``rows`` with vectors, as the store would hold them."""
    return rows.withColumn("embedding", embed(F.col("text"), EMBEDDER))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("project"), "embedding"
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text files, named by their id and address."""
    path = F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit("/page.html"))
    return table(spark, sf_dir, "pages").select(path.alias("rel_path"), F.col("html").alias("content"))
