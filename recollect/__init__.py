"""Semantic retrieval and incremental corpus ingestion on Spark DataFrames."""

__version__ = "0.1.0"
