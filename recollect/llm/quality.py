"""Quality rules and robust multivariate outliers, with DataFrame functions only.

Statistics are taken from whole texts. The method part estimates location and scatter of a
transformed statistic vector per language and source by the minimum covariance determinant:
starting from robust starting values, concentration steps keep the three quarters of a group's
documents with the smallest Mahalanobis distance and estimate anew from those. The reweighting step
then estimates once more from all documents within a quantile of chi-squared, and a document whose
distance to that estimate is beyond a far quantile is rejected.

A document of n words varies as 1 + SIZE / n. Distances are divided by that, and the estimates give
each document the inverse as its weight, so that both speak of the same scatter.

All sums are grouped aggregations with partial sums; a group is never gathered. The quantile of
the distances within a group comes from a histogram with a bounded number of bins. Estimates are
one row per group, pooled upwards (language, then all) where a group is small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.base import SPACE, Scratch, fresh, row_hash
from recollect.session import broadcast_if_small

#: Base rules.
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = r"[#*$%&|<>]"
#: The coordinates of the vector, each with the standard deviation that is added to its estimate:
#: differences below that are no sign of anything, also where a group has none at all.
VECTOR = {"v_chars": 0.2, "v_symbols": 0.04, "v_upper": 0.04, "v_marks": 0.04, "v_repeats": 0.05}
#: Share of a group's documents that an estimate rests on, concentration steps, and the weight in
#: documents of the level above (all sources of the language, all languages).
KEEP, STEPS, PULL = 0.75, 3, 50
#: The scatter of the central three quarters of a normal distribution in five dimensions, inverse.
CONSISTENT = 1.41
#: Reweighting: the 0.975 quantile of chi-squared with five degrees of freedom, and the scatter
#: inside it, inverse: 0.975 by the share that chi-squared with seven degrees has below it.
WITHIN, WITHIN_CONSISTENT = 12.833, 1.0555
#: A document of n words varies as 1 + SIZE / n.
SIZE = 100
#: Squared distance beyond which a document is rejected: the 0.99999 quantile of chi-squared with
#: five degrees of freedom.
CUT = 30.856
#: Files of a table of groups: few, so that their footers don't hide how small it is.
FILES = 8
#: Bins of the histogram of squared distances: to one e-fold, and the range of the logarithm.
_BINS, _LOW, _HIGH = 16, -20.0, 40.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
GROUP = ("lang_key", "source_key")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _covered(grams: Column) -> Column:
    """How many words the windows cover that occur more than once."""
    span = F.lit(REPEAT_WINDOW)

    def twice(pairs: Column) -> Column:
        same = lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"])
        return F.sort_array(F.transform(F.filter(pairs, same), lambda p: p["i"]))

    def words(starts: Column) -> Column:
        own = F.transform(starts, lambda i, k: F.least(span, F.coalesce(F.get(starts, k + 1) - i, span)))
        return F.aggregate(own, F.lit(0), lambda total, n: total + n)

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(pairs, twice), words)


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def repeated(hashes: Column) -> Column:
        starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (REPEAT_WINDOW - 1), F.lit(0)))
        following = [lambda i, k=k: F.get(hashes, i + k) for k in range(1, REPEAT_WINDOW)]
        grams = F.transform(starts, lambda h, i: F.xxhash64(h, *[f(i) for f in following]))
        # Most texts repeat no window; only the others are sorted.
        return _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(g)).otherwise(F.lit(0)))

    def counts(words: Column) -> Column:
        return _let(
            F.array_join(words, ""),
            lambda joined: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(joined).cast("long").alias("word_chars"),
                F.regexp_count(joined, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _let(F.transform(words, lambda w: F.xxhash64(w)), repeated).cast("long").alias("n_repeat_words"),
                F.regexp_count(joined, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                F.regexp_count(joined, F.lit(r"[^\p{L}\p{N}]")).cast("long").alias("n_marks"),
            ),
        )

    return _let(words, counts)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _vector() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        (F.col("word_chars") / n).alias("v_chars"),
        F.sqrt(F.col("n_symbols") / chars).alias("v_symbols"),
        F.sqrt(F.col("n_upper") / chars).alias("v_upper"),
        F.sqrt(F.col("n_marks") / chars).alias("v_marks"),
        F.sqrt((F.col("n_repeat_words") + F.col("n_dup_lines")) / n).alias("v_repeats"),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document: identity, group, counts, base rule and vector."""
    key = lambda name: F.concat(F.when(F.col(name).isNull(), "0").otherwise("1"), F.coalesce(name, F.lit("")))
    rows = docs.select(
        "doc_id", row_hash(docs).alias("row"), key("lang").alias("lang_key"), key("source").alias("source_key"),
        statistics(F.col("text")).alias("stats"),
    )
    flat = rows.select("doc_id", "row", *GROUP, *[F.col(f"stats.{c}").alias(c) for c in COUNTS])
    return flat.select("*", base_failed().alias("base_failed"), *_vector())


# -- estimates ----------------------------------------------------------------


def _weight() -> Column:
    return F.col("n_words") / (F.col("n_words") + SIZE)


def _moments(rows: DataFrame) -> DataFrame:
    """Count, and weighted sums and sums of products, for each group."""
    names, w = list(VECTOR), _weight()
    sums = [F.sum(w).alias("s_w"), *[F.sum(w * F.col(a)).alias(f"s_{a}") for a in names]]
    products = [F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*GROUP).agg(F.count("*").cast("double").alias("s"), *sums, *products)


def _pooled(moments: DataFrame, groups: DataFrame, consistent: float) -> DataFrame:
    """Means ``m_*`` and the inverse Cholesky factor's ingredients ``l_*`` of every group.

    ``moments`` is a kept table of one row a group. A group's moments are joined by those of its
    language with the weight of PULL documents, and these by those of all documents, which are one
    row and so become constants. Where no document has been counted at all, all are null.
    """
    names = list(VECTOR)
    parts = [c for c in moments.columns if c not in GROUP]
    every = moments.agg(*[F.sum(c).alias(c) for c in parts]).first()
    if not every["s"] or not every["s_w"]:
        nothing = [F.lit(None).cast("double").alias(c) for c in _columns()]
        return groups.select(*GROUP, *nothing)
    of_lang = moments.groupBy(F.col("lang_key").alias("b_key")).agg(*[F.sum(c).alias(f"b_{c}") for c in parts])
    own = moments.withColumnsRenamed({g: f"own_{g}" for g in GROUP})
    full = (
        groups.join(own, [F.col(g) == F.col(f"own_{g}") for g in GROUP], "left")
        .join(of_lang, F.col("lang_key") == F.col("b_key"), "left")
        .na.fill(0.0, parts + [f"b_{c}" for c in parts])
    )
    mean_lang = {c: (F.col(f"b_{c}") + PULL * every[c] / every["s"]) / (F.col("b_s") + PULL) for c in parts}
    mean = {c: (F.col(c) + PULL * mean_lang[c]) / (F.col("s") + PULL) for c in parts}
    means = full.select(*GROUP, *[mean[c].alias(c) for c in parts])
    cov = means.select(
        *GROUP,
        *[(F.col(f"s_{a}") / F.col("s_w")).alias(f"m_{a}") for a in names],
        *[
            (
                (F.col(f"s_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("s_w")) * consistent
                + (F.col("s_w") * VECTOR[a] ** 2 if a == b else F.lit(0.0))
            ).alias(f"c{i}{j}")
            for i, a in enumerate(names)
            for j, b in list(enumerate(names))[i:]
        ],
    )
    # Cholesky factor, column by column; the added variances keep it from degenerating.
    size = len(names)
    for j in range(size):
        left = reduce(add, [F.col(f"l{j}{k}") ** 2 for k in range(j)], F.lit(0.0))
        cov = cov.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - left, F.lit(1e-6))))
        for i in range(j + 1, size):
            left = reduce(add, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            cov = cov.withColumn(f"l{i}{j}", (F.col(f"c{j}{i}") - left) / F.col(f"l{j}{j}"))
    return cov.select(*GROUP, *_columns())


def _columns() -> list[str]:
    """What an estimate consists of."""
    return [f"m_{a}" for a in VECTOR] + [f"l{i}{j}" for i in range(len(VECTOR)) for j in range(i + 1)]


def _with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with ``distance``, squared and adjusted to the number of words."""
    joined = rows.join(estimate, list(GROUP), "left")
    for i, a in enumerate(VECTOR):
        left = reduce(add, [F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)], F.lit(0.0))
        joined = joined.withColumn(f"y{i}", (F.col(a) - F.col(f"m_{a}") - left) / F.col(f"l{i}{i}"))
    squared = reduce(add, [F.col(f"y{i}") ** 2 for i in range(len(VECTOR))])
    return joined.select(*rows.columns, (squared * _weight()).alias("distance"))


def _start(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Medians and quartile ranges as a first, diagonal estimate."""
    names = list(VECTOR)
    quartiles = rows.groupBy(*GROUP).agg(
        *[F.percentile_approx(a, [0.25, 0.5, 0.75], 1000).alias(f"q_{a}") for a in names]
    )
    scale = {a: F.greatest((F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0]) / 1.349, F.lit(s)) for a, s in VECTOR.items()}
    return groups.join(quartiles, list(GROUP), "left").select(
        *GROUP,
        *[F.col(f"q_{a}")[1].alias(f"m_{a}") for a in names],
        *[
            (scale[a] if i == j else F.lit(0.0)).alias(f"l{i}{j}")
            for i, a in enumerate(names)
            for j in range(i + 1)
        ],
    )


def _with_bin(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    logarithm = F.log(F.col("distance") + 1e-12)
    bin_ = F.floor(F.greatest(F.lit(_LOW), F.least(F.lit(_HIGH), logarithm)) * _BINS)
    return _with_distance(rows, estimate).withColumn("bin", bin_)


def _concentrated(rows: DataFrame, estimate: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """The estimate of the KEEP share of each group that is nearest to ``estimate``, up to a bin.

    What is joined to the documents is a kept table with a row for each group, which is small
    wherever there are few groups; so the documents themselves need no exchange.
    """
    order = Window.partitionBy(*GROUP).orderBy("bin")
    bins = _with_bin(rows, estimate).groupBy(*GROUP, "bin").agg(F.count("*").alias("n"))
    upto = bins.withColumn("upto", F.sum("n").over(order)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*GROUP))
    )
    last = upto.where(F.col("upto") >= F.col("total") * KEEP).groupBy(*GROUP).agg(F.min("bin").alias("last_bin"))
    last = scratch.keep(last.coalesce(FILES))
    central = _with_bin(rows, estimate).join(last, list(GROUP)).where("bin <= last_bin")
    return _estimate(central, groups, CONSISTENT, scratch)


def _estimate(rows: DataFrame, groups: DataFrame, consistent: float, scratch: Scratch) -> DataFrame:
    moments = scratch.keep(_moments(rows).coalesce(FILES))
    return scratch.keep(_pooled(moments, groups, consistent).coalesce(FILES))


def scored(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, row``, the counts, ``base_failed``, ``distance`` and ``kept`` of every row of ``docs``.

    ``row`` is the hash of the whole row. Null texts have no words and fail the base rule, as all
    texts under MIN_WORDS do. Null languages and sources are groups of their own. Rows that fail the
    base rule are no part of the estimates; where none passes it, there are no distances and nothing
    else is rejected. Repeated rows are judged alike. An empty table gives an empty result.
    """
    rows = scratch.keep(measured(docs))
    sound = rows.where(~F.col("base_failed"))
    groups = scratch.keep(rows.select(*GROUP).distinct().coalesce(FILES))
    estimate = scratch.keep(_start(sound, groups).coalesce(FILES))
    for _ in range(STEPS):
        estimate = _concentrated(sound, estimate, groups, scratch)
    within = _with_distance(sound, estimate).where(F.col("distance") <= WITHIN)
    estimate = _estimate(within, groups, WITHIN_CONSISTENT, scratch)
    judged = _with_distance(rows, estimate)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return judged.withColumn("kept", kept).drop(*GROUP, *VECTOR)


def keep_good(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that neither the base rule nor the method rejects, with their columns."""
    rejected = scratch.keep(scored(docs, scratch).where(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), "row").distinct())
    key = fresh(docs, "_row")
    named = docs.withColumn(key, row_hash(docs))
    bad = broadcast_if_small(rejected)
    return named.join(bad, (named[key] == bad["row"]) & named["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti").drop(key)
