import random

import pytest
from pyspark.sql import types as T

from recollect.session import Scratch

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns named as the operators name their own.
CLASHING = ["row", "_row", "size", "place", "stats", "fp", "first", "kept", "key", "copies", "shuffle", "phrase"]


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def corpus(seed=3, n=60):
    """Documents with copies, near copies, nulls, empty, short and very long texts, and repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70))
    rows = []
    for i in range(n):
        text = " ".join(words(rng, rng.choice([5, 30, 80, 200])))
        if i % 7 == 0:
            text += " " + passage
        if i % 11 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 13 == 0 and rows and rows[-1][1]:
            text = rows[-1][1] + " end"
        rows.append((i * 3 % 101, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", None]), 0))
    rows += [
        (1001, None, "en", "a", None), (1002, "", "en", "a", 0), (1003, " \t\n ", None, None, 4),
        (1004, " ".join(words(rng, 30_000, 5000)), "en", "b", 0), (1005, "one", "en", "b", 3),
        (None, "a text without an id " * 30, "en", "b", 0), (None, "a text without an id " * 30, "en", "b", 0),
    ]
    rows += [rows[5], rows[5], (rows[6][0], "the same id with another text " * 20, "de", "a", 1)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def widened(spark, docs):
    """``docs`` with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    out = docs
    for name in CLASHING:
        out = out.withColumn(name, F.lit("x"))
    return out.withColumn("odd name.", F.create_map(F.lit("k"), F.lit(1)))


def plain(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.select(*columns).collect())))
