"""gitignore rules: parsing one file, deciding on a path, and deciding on tables of paths.

Supported: comments, negation, directory-only rules, anchoring by a leading or
inner slash, ``*``, ``?``, ``[...]``, ``**``, and backslash escapes. The last
matching rule wins, deeper files after shallower ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIECE = re.compile(r"\*\*/|\*\*|\*|\?|\[[!^]?\]?[^\]]*\]|\\.|.", re.DOTALL)
# What each wildcard stands for.
_WILDCARDS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


class Rule(NamedTuple):
    regex: re.Pattern
    negated: bool
    directories_only: bool


def _piece_regex(piece: str) -> str:
    if piece in _WILDCARDS:
        return _WILDCARDS[piece]
    if piece[0] == "[" and len(piece) > 1:
        negated = piece[1] in "!^"
        members = piece[1 + negated : -1].replace("\\", r"\\").replace("]", r"\]").replace("[", r"\[").replace("^", r"\^")
        return f"(?!/)[{'^' * negated}{members}]"
    return re.escape(piece[1:] if piece[0] == "\\" and len(piece) > 1 else piece)


def parse_rules(text: str, base: str) -> list[Rule]:
    """The rules of the ignore file in directory ``base`` ("" is the root)."""
    rules = []
    for line in text.splitlines():
        pattern = re.sub(r"(?<!\\)\s+$", "", line)
        if not pattern.strip() or pattern.lstrip().startswith("#"):
            continue
        negated = pattern.startswith("!")
        pattern = pattern[negated:]
        directories_only = pattern.endswith("/")
        pattern = pattern.rstrip("/") if directories_only else pattern
        anchored = "/" in pattern
        glob = "".join(map(_piece_regex, _PIECE.findall(pattern.removeprefix("/"))))
        prefix = re.escape(base) + "/" if base else ""
        regex = f"{prefix}{'' if anchored else '(?:.*/)?'}{glob}(?:/.*)?"
        rules.append(Rule(re.compile(regex, re.DOTALL), negated, directories_only))
    return rules


def ignored(path: str, is_directory: bool, rule_sets: list[list[Rule]]) -> bool:
    verdict = False
    for rule in (rule for rules in rule_sets for rule in rules):
        if (is_directory or not rule.directories_only) and rule.regex.fullmatch(path):
            verdict = not rule.negated
    return verdict


# -- as relations ---------------------------------------------------------------

_RULES = "base string, position long, pattern string, negated boolean, directories_only boolean"


def rule_table(files: DataFrame) -> DataFrame:
    """``base, position, pattern, negated, directories_only``: the rules of ignore files ``base, content``.

    ``base`` is the folder of the file, "" the root; of repeated folders all rules count, in some order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (base or "", k, f"(?s)\\A(?:{r.regex.pattern})\\z", r.negated, r.directories_only)
                for base, text in zip(batch.column("base").to_pylist(), batch.column("content").to_pylist())
                for k, r in enumerate(parse_rules(text or "", base or ""))
            ]
            names, types = zip(*[c.split() for c in _RULES.split(", ")])
            kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))

    return files.select("base", "content").mapInArrow(run, _RULES)


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``rel_path, ignored`` for each distinct ``rel_path`` of files, given a ``rule_table``.

    A path is ignored if it or any folder above it is. Each folder is judged once, however many files
    lie below it: it meets the rules of the folders above it, and the last match decides,
    deeper folders after shallower ones. Null paths are left out.
    """
    files = paths.select("rel_path").where("rel_path IS NOT NULL").distinct()
    parts = F.split("rel_path", "/")
    prefix = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    places = files.select("rel_path", F.explode(F.transform(depths, lambda n: F.struct(prefix(n).alias("place"), (n < F.size(parts)).alias("folder")))).alias("x"))
    places = places.select("rel_path", "x.*")
    own = F.split("place", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda n: F.struct(F.array_join(F.slice(own, F.lit(1), n), "/").alias("base"), n.alias("depth")))
    met = places.select("place", "folder").distinct().select("place", "folder", F.inline(above))
    matched = met.withColumnRenamed("base", "in_base").join(rules, F.col("in_base") == F.col("base")).where(
        (F.col("folder") | ~F.col("directories_only")) & F.regexp_like("place", F.col("pattern"))
    )
    verdicts = matched.groupBy("place", "folder").agg(F.max_by("negated", F.struct("depth", "position")).alias("negated"))
    bad = verdicts.where(~F.col("negated")).select(F.col("place").alias("bad"), F.col("folder").alias("bad_folder"))
    hit = places.join(bad, (F.col("place") == F.col("bad")) & (F.col("folder") == F.col("bad_folder")), "left")
    return hit.groupBy("rel_path").agg(F.bool_or(F.col("bad").isNotNull()).alias("ignored"))
