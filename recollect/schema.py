"""The canonical table layouts and the fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 2
DEFAULT_PROJECT = "default"
KIND_MANUAL = "manual"
KIND_CODE = "code"
EMBEDDING_DIM = 384

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

#: One row per stored note or code chunk.
MEMORIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("project", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("tags", T.ArrayType(T.StringType()), False),
        T.StructField("embedding", VECTOR, False),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

#: What users see of a row: everything but the vector.
USER_COLUMNS = [f.name for f in MEMORIES.fields if f.name != "embedding"]

#: A source file before chunking.
FILES = T.StructType(
    [
        T.StructField("rel_path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("content", T.StringType()),
    ]
)
