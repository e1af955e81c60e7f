"""Scalar text functions as Spark columns.

String length and white space follow ECMAScript: lengths count UTF-16 units and
white space is the Unicode set below, which neither Java's ``\\s`` nor Spark's
``trim`` covers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of the ECMAScript white-space class (valid inside a
# bracket expression for both java.util.regex and RE2).
SPACE = (
    r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
# The complement, as ranges in the order in which texts use them: java.util.regex tries
# them one after the other for every character.
WORD = (
    r"[!-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}"
    r"\x{2060}-\x{2fff}\x{3001}-\x{fefe}\x{ff00}-\x{10ffff}\x00-\x08\x0e-\x1f]"
)

# File extension to language.
LANGUAGES = {
    "go": "go",
    "js": "js",
    "jsx": "js",
    "mjs": "js",
    "cjs": "js",
    "ts": "ts",
    "tsx": "ts",
    "py": "python",
    "pyi": "python",
}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z", "")


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(WORD))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}++"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}++")).cast("long")


def estimate_tokens(text: Column) -> Column:
    """``ceil(units / 4 + words / 10)`` in integer arithmetic, exact at any length."""
    return F.call_function("div", utf16_length(text) * 5 + word_count(text) * 2 + 19, F.lit(20).cast("long"))


def _grams(items: Column, gram) -> Column:
    """``gram(i, n)`` for every run of n items: 5, or 3 below eight items."""
    n = F.when(F.size(items) >= 8, 5).otherwise(3)
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - n, F.lit(0)))
    return F.array_distinct(F.when(F.size(items) < n, items).otherwise(F.transform(starts, lambda i: gram(i, n))))


def shingles(text: Column) -> Column:
    """Distinct word 5-grams, 3-grams below eight words, single words below three."""
    return let(
        words(F.lower(text)),
        lambda w: F.when(F.size(w) == 0, F.array(F.lit(""))).otherwise(
            _grams(w, lambda i, n: F.array_join(F.slice(w, i + 1, n), " "))
        ),
    )


def shingle_hashes(text: Column) -> Column:
    """``shingles`` as 64-bit hashes, sorted; no gram is ever built as a string."""

    def gram(w: Column):
        def mixed(i: Column, n: Column) -> Column:
            three = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.when(n == 3, three).otherwise(F.xxhash64(three, F.get(w, i + 3), F.get(w, i + 4)))

        return mixed

    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))
    return F.sort_array(
        let(hashed, lambda w: F.when(F.size(w) == 0, F.array(F.lit(0).cast("long"))).otherwise(_grams(w, gram(w))))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; 0 when either is empty."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda common: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
            common.cast("double") / (F.size(a) + F.size(b) - common)
        ),
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def parse_tags(raw: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(raw, F.lit(""))), f"[,{SPACE}]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def normalize_project(raw: Column) -> Column:
    return F.coalesce(F.nullif(trim(raw), F.lit("")), F.lit("default"))


def detect_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    extension = F.lower(F.substring_index(path, ".", -1))
    return F.coalesce(F.try_element_at(table, extension), F.lit("text"))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def embed_text(path: Column, start: Column, end: Column, kind: Column, unit: Column, content: Column) -> Column:
    """Location and unit name travel with the code into the model, not into storage."""
    named = F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise("")
    return F.concat(
        path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" "), kind, named, F.lit("\n"), content
    )


def windows(text: Column, size: int) -> Column:
    """``text`` in consecutive pieces of ``size`` characters, as the model embeds them."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))


def clip(text: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units, as a model with a bounded input sees it.

    A pair of surrogates cut in half is dropped.
    """
    cut = F.substring(F.encode(text, "UTF-16LE"), 1, 2 * units)
    low = F.hex(F.substring(cut, 2 * units, 1))
    halved = (F.octet_length(cut) == 2 * units) & low.between("D8", "DB")
    return F.decode(F.when(halved, F.substring(cut, 1, 2 * units - 2)).otherwise(cut), "UTF-16LE")


def hit_header(id: Column, kind: Column, path: Column, start: Column, end: Column) -> Column:
    located = (F.coalesce(path, F.lit("")) != "") & start.isNotNull()
    place = F.when(
        located,
        F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), F.coalesce(end.cast("string"), F.lit("null"))),
    ).otherwise(kind)
    return F.concat(F.lit("["), id.cast("string"), F.lit("] ("), place, F.lit(") "))


def hit_cost(id: Column, kind: Column, path: Column, start: Column, end: Column, text: Column) -> Column:
    return estimate_tokens(F.concat(hit_header(id, kind, path, start, end), text))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
