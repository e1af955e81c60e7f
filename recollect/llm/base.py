"""Reading tables, identity of rows and intermediate files for the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import Scratch, prepare

#: Words of most contracts: runs of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame) -> Column:
    """64 bits over all columns of a row, nulls told from each other.

    With ``doc_id`` beside it this identifies a row up to rows that are wholly equal.
    """
    columns = [F.col(quoted(c)) for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    # Maps have no hash of their own.
    hashed = [F.to_json(c) if "map<" in kind else c for c, (_, kind) in zip(columns, df.dtypes)]
    return F.xxhash64(*hashed, nulls)


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
