"""Include/exclude path patterns: a substring, or a glob when it holds a wildcard."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_GLOB_PIECES = re.compile(r"\*\*|\*|\?|[^*?]+")
# What each wildcard stands for.
_WILDCARDS = {"**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(pattern: str) -> str:
    """An anchored regular expression valid in Python, Java and RE2."""
    body = "".join(_WILDCARDS.get(piece) or re.escape(piece) for piece in _GLOB_PIECES.findall(pattern))
    return f"^{body}$"


def _match(path: Column, pattern: str) -> Column:
    if "*" in pattern or "?" in pattern:
        return F.rlike(path, F.lit(glob_regex(pattern)))
    return F.contains(path, F.lit(pattern))


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_match(path, p) for p in patterns])


def path_filter(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    keep = matches_any(path, include) if include else F.lit(True)
    return keep & ~matches_any(path, exclude) if exclude else keep


def split_patterns(raw: str | None) -> list[str] | None:
    """``"a, b"`` as given on a command line or in a tool call."""
    if not raw:
        return None
    return [p.strip() for p in raw.split(",") if p.strip()] or None
