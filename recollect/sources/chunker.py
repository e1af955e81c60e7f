"""Splitting source files into retrievable chunks.

Go, JavaScript/TypeScript and Python files are cut at top-level declarations:
lines are exploded, running window sums give the bracket depth, and a
declaration is a matching line at depth zero. All windows are partitioned by
file, so one exchange by ``rel_path`` serves the whole scan. Other files, and
files without declarations, get overlapping line windows computed within the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import (
    SPACE,
    detect_language,
    is_blank,
    let,
    normalize_newlines,
    utf16_length,
)


@dataclass(frozen=True)
class ChunkOptions:
    """The default sizes. ``None`` means the default."""

    max_lines: int = 160
    max_chars: int = 6000
    split_overlap: int = 20
    window: int = 60
    overlap: int = 12
    min_lines: int = 4

    @classmethod
    def of(cls, **given) -> "ChunkOptions":
        return cls(**{k: v for k, v in given.items() if v is not None})


#: A window may end up to this many lines early, at a blank line.
LOOK_BACK = 8

_S = f"[{SPACE}]"


@dataclass(frozen=True)
class Grammar:
    """How a language declares things at the margin: words that may stand before a keyword, the
    letters of a name, and the forms in order of precedence. A form is its kind, its keywords, and
    what stands between keyword and name and after the name; ``()`` marks a form without a name."""

    modifiers: tuple[str, ...]
    letters: str
    forms: tuple[tuple[str, tuple[str, ...], str, str], ...]

    @property
    def name(self) -> str:
        first = self.letters.replace("0-9", "")
        return f"([{first}][{self.letters}]*+)"

    def patterns(self) -> list[tuple[str, str]]:
        """``pattern, kind``; group 1 is the unit's name."""
        before = f"(?:(?:{'|'.join(self.modifiers)}){_S}++)*+" if self.modifiers else ""
        found = []
        for kind, keywords, between, after in self.forms:
            # Two words of a keyword stand apart; a keyword ends before its name does begin.
            word = "|".join(k.replace(" ", f"{_S}++") for k in keywords)
            named = between if between.endswith("()") else f"{between}{self.name}"
            found.append((f"^{before}(?:{word})(?![{self.letters}]){_S}*+{named}{after}", kind))
        return found


def _then(word: str) -> str:
    return f"{_S}++{word}(?![A-Za-z0-9_])"


# What is assigned after a name and perhaps its type, in which arrows may stand too: a function
# or an arrow with one bare parameter or a list of them, perhaps generic, perhaps with a result type.
_ASSIGNED = rf"(?![A-Za-z0-9_$])[^=]*+(?:=>[^=]*+)*+=(?!>){_S}*+(?:async(?![A-Za-z0-9_$]){_S}*+)?"
_FUNCTION = (
    rf"(?:function(?![A-Za-z0-9_$])|(?:<[^>]*+>{_S}*+)?\([^)]*+\){_S}*+(?::[^={{]*+)?=>|[A-Za-z_$][A-Za-z0-9_$]*+{_S}*+=>)"
)

# The kinds that units are given, for the declarations of each language.
GRAMMARS = {
    "go": Grammar(
        (),
        "A-Za-z_0-9",
        (
            ("method", ("func",), rf"\([^)]*+\){_S}*+", ""),
            ("func", ("func",), "", ""),
            ("struct", ("type",), "", _then("struct")),
            ("interface", ("type",), "", _then("interface")),
            ("type", ("type",), "", ""),
            ("varblock", ("var",), r"\(()", ""),
            ("constblock", ("const",), r"\(()", ""),
            ("var", ("var",), "", ""),
            ("const", ("const",), "", ""),
        ),
    ),
    "ts": Grammar(
        ("export", "default", "declare", "abstract", "async"),
        "A-Za-z_$0-9",
        (
            ("function", ("function",), rf"\*?{_S}*+", ""),
            ("class", ("class",), "", ""),
            ("interface", ("interface",), "", ""),
            ("type", ("type",), "", rf"{_S}*+[=<]"),
            ("enum", ("enum", "const enum"), "", ""),
            ("namespace", ("namespace", "module"), "", ""),
            ("function", ("const", "let", "var"), "", _ASSIGNED + _FUNCTION),
            ("binding", ("const", "let", "var"), "", ""),
        ),
    ),
    "python": Grammar(("async",), "A-Za-z_0-9", (("class", ("class",), "", ""), ("function", ("def",), "", ""))),
}
DECLARATIONS = {lang: grammar.patterns() for lang, grammar in GRAMMARS.items()}
DECLARATIONS["js"] = DECLARATIONS["ts"]

# Kinds that always keep a chunk of their own.
MAJOR_KINDS = ["func", "method", "function", "class", "struct", "interface", "enum", "namespace", "type"]


def _quoted(q: str) -> str:
    return rf"{q}[^{q}\\\n]*+(?:\\[^\n][^{q}\\\n]*+)*+{q}?+"


def _triple(q: str) -> str:
    return rf"{q}{{3}}[^{q}\\]*+(?:(?:\\[\s\S]|{q}(?!{q}{q}))[^{q}\\]*+)*+(?:{q}{{3}}|\z)"


# A text is a sequence of these tokens; every quantifier is possessive, so that
# long literals neither backtrack nor recurse.
_BRACE_TOKENS = "|".join(
    [
        r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)",
        r"//[^\n]*+",
        r"`[^`\\]*+(?:\\[\s\S]?[^`\\]*+)*+(?:`|\z)",
        _quoted('"'),
        _quoted("'"),
        "[^/\"'`]++",
        "/",
    ]
)
_PYTHON_TOKENS = "|".join(
    [_triple('"'), _triple("'"), r"#[^\n]*+", _quoted('"'), _quoted("'"), "[^#\"']++"]
)


def _blanked(text: Column, tokens: str, opaque: str) -> Column:
    """``text`` with literals and comments blanked, line breaks kept."""
    parts = F.regexp_extract_all(text, F.lit(tokens), F.lit(0))
    return F.array_join(
        F.transform(
            parts, lambda t: F.when(F.rlike(t, F.lit(opaque)), F.regexp_replace(t, r"[^\n]+", " ")).otherwise(t)
        ),
        "",
    )


def source_text(content: Column) -> Column:
    """Line breaks unified and the final one dropped."""
    return F.regexp_replace(normalize_newlines(content), r"\n\z", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _first_rule(code: Column, lang: str) -> Column:
    """Kind and unit name by the first declaration form that matches, else null."""
    return F.coalesce(
        *[
            F.when(
                F.rlike(code, F.lit(pattern)),
                F.struct(F.lit(kind).alias("kind"), F.regexp_extract(code, pattern, 1).alias("unit")),
            )
            for pattern, kind in DECLARATIONS[lang]
        ]
    )


def _by_language(lang: Column, column_for) -> Column:
    brace = F.when(lang == "go", column_for("go")).when(lang.isin("ts", "js"), column_for("ts"))
    return brace.when(lang == "python", column_for("python"))


def _line_features(code_files: DataFrame) -> DataFrame:
    """One narrow row per line; the text itself is not carried further."""
    text, lang = F.col("text"), F.col("lang")
    blanked = F.when(lang == "python", _blanked(text, _PYTHON_TOKENS, "^[#\"']")).otherwise(
        _blanked(text, _BRACE_TOKENS, "^(?://|/\\*|[\"'`])")
    )
    # Two steps: what is computed beside an explode is computed again for every line.
    per_file = code_files.select(
        "rel_path",
        "lang",
        F.size(_lines(text)).alias("n_lines"),
        (F.size(_lines(F.regexp_replace(text, rf"{_S}+\z", ""))) - 1).alias("last_filled"),
        F.arrays_zip(_lines(text).alias("raw"), _lines(blanked).alias("code")).alias("zipped"),
    )
    # Outer, though there is always a line: for the inner form Spark adds a filter on the
    # array's size, for which all of the above would be computed a second time.
    exploded = per_file.select(
        "rel_path", "lang", "n_lines", "last_filled", F.posexplode_outer("zipped").alias("ln", "line")
    )
    raw, code = F.col("line.raw"), F.col("line.code")
    at_margin = F.rlike(raw, F.lit(f"^[^{SPACE}]"))
    comment = F.when(lang == "python", F.rlike(raw, F.lit(rf"^{_S}*#"))).otherwise(
        F.rlike(raw, F.lit(rf"^{_S}*(?://|/\*|\*)"))
    )
    return exploded.select(
        "rel_path",
        "lang",
        "n_lines",
        "last_filled",
        "ln",
        (F.regexp_count(code, F.lit(r"[{(\[]")) - F.regexp_count(code, F.lit(r"[})\]]"))).alias("delta"),
        is_blank(raw).alias("blank"),
        comment.alias("comment"),
        ((lang == "python") & F.startswith(raw, F.lit("@"))).alias("decorator"),
        F.when(at_margin, _by_language(lang, lambda name: _first_rule(code, name))).alias("decl"),
    )


def _declarations(lines: DataFrame) -> DataFrame:
    """Declaration spans: ``start`` and ``end`` lines (0-based, inclusive), kind, unit."""
    by_line = Window.partitionBy("rel_path").orderBy("ln")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    ln = F.col("ln")
    filled = ~F.col("blank")
    # Each select is one window operator.
    summed = lines.select(
        "*",
        F.sum("delta").over(so_far).alias("sum"),
        F.max(F.when(filled, ln)).over(so_far).alias("filled_to"),
        F.max(F.when(filled & ~F.col("comment"), ln)).over(so_far).alias("content_to"),
    )
    # Depth never falls below zero: a running sum less its running minimum. "above"
    # is what stands before this line, decorators skipped.
    line_above = F.when(~F.col("decorator"), F.struct("ln", "comment", "filled_to", "content_to"))
    scanned = summed.select(
        *["rel_path", "lang", "n_lines", "last_filled", "ln", "decl"],
        F.coalesce(F.lag("sum").over(by_line), F.lit(0)).alias("sum"),
        F.least(F.lit(0), F.min("sum").over(before)).alias("lowest"),
        F.last(line_above, ignorenulls=True).over(before).alias("above"),
    )
    outer = scanned.where(F.col("sum") == F.col("lowest"))
    # A bracketed statement ends where the next one at depth zero begins.
    outer = outer.withColumn("closes", F.coalesce(F.lead("ln").over(by_line), F.col("n_lines")) - 1)
    commented = F.coalesce(F.col("above.comment"), F.lit(False))
    decls = outer.where(F.col("decl").isNotNull()).select(
        "rel_path",
        "lang",
        "n_lines",
        "last_filled",
        "ln",
        "closes",
        F.col("decl.kind").alias("kind"),
        F.col("decl.unit").alias("unit"),
        (F.when(commented, F.col("above.content_to")).otherwise(F.col("above.ln")) + 1).alias("lead_in"),
        F.when(commented, F.col("above.content_to")).otherwise(F.col("above.filled_to")).alias("previous_to"),
    )
    python = F.col("lang") == "python"
    ended = decls.withColumn(
        "end",
        F.when(python, F.coalesce(F.lead("previous_to").over(by_line), F.col("last_filled"))).otherwise(F.col("closes")),
    )
    # A comment above belongs to the unit below, unless it lies in the unit before.
    free_from = F.coalesce(F.lag("end").over(by_line) + 1, F.lit(0))
    return ended.withColumn("start", F.greatest(F.coalesce("lead_in", F.lit(0)), free_from))


def _with_gaps(decls: DataFrame) -> DataFrame:
    """Declarations plus spans for the lines before, between and after them."""
    by_line = Window.partitionBy("rel_path").orderBy("ln")
    neighbours = decls.select(
        *["rel_path", "n_lines", "start", "end", "kind", "unit"],
        F.coalesce(F.lag("end").over(by_line), F.lit(-1)).alias("filled_to"),
        F.lead("ln").over(by_line).isNull().alias("last"),
    )

    def span(start: Column, end: Column, kind: Column, unit: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"), unit.alias("unit"))

    spans = F.array(
        span(F.col("filled_to") + 1, F.col("start") - 1, F.lit("preamble"), F.lit("")),
        span(F.col("start"), F.col("end"), F.col("kind"), F.col("unit")),
        span(F.col("end") + 1, F.when(F.col("last"), F.col("n_lines") - 1), F.lit("trailing"), F.lit("")),
    )
    return neighbours.select("rel_path", F.inline(F.filter(spans, lambda s: s["start"] <= s["end"])))


def _merge_small(spans: DataFrame, min_lines: int) -> DataFrame:
    """Fold small neighbouring minor spans into blocks.

    A minor span joins the block before it if either is short. The block reaches
    back to the last major span, or to a long minor one, so it is short exactly
    when the distance to that point is.
    """
    by_start = Window.partitionBy("rel_path").orderBy("start")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    major = F.col("kind").isin(MAJOR_KINDS)
    placed = spans.select(
        "*",
        F.coalesce(F.lag(major).over(by_start), F.lit(True)).alias("after_major"),
        F.coalesce(F.max(F.when(major, F.col("end") + 1)).over(before), F.lit(0)).alias("minor_from"),
    )
    long_enough = F.col("end") - F.col("start") + 1 >= min_lines
    block_long_enough = F.col("start") - F.col("minor_from") >= min_lines
    opens = major | F.col("after_major") | (long_enough & block_long_enough)
    numbered = placed.withColumn("block", F.count_if(opens).over(by_start))
    single = F.count("*") == 1
    return numbered.groupBy("rel_path", "block").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.when(single, F.first("kind")).otherwise("block").alias("kind"),
        F.when(single, F.first("unit")).otherwise("").alias("unit"),
    )


def _slice_text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, end - start + 1), "\n")


def _cut_oversize(lines: Column, spans: Column, options: ChunkOptions) -> Column:
    """Long units become overlapping pieces that keep the unit's name."""
    step = max(1, options.max_lines - options.split_overlap)

    def pieces(s: Column) -> Column:
        size = s["end"] - s["start"] + 1
        chars = utf16_length(_slice_text(lines, s["start"], s["end"])) + 1
        starts = F.filter(
            F.sequence(s["start"], s["end"], F.lit(step)),
            lambda at: (at == s["start"]) | (at - step + options.max_lines - 1 < s["end"]),
        )
        cut = F.transform(
            starts,
            lambda at: F.struct(
                at.alias("start"),
                F.least(s["end"], at + options.max_lines - 1).alias("end"),
                s["kind"].alias("kind"),
                s["unit"].alias("unit"),
            ),
        )
        return F.when((size > options.max_lines) | (chars > options.max_chars), cut).otherwise(F.array(s))

    return F.flatten(F.transform(spans, pieces))


def line_windows(lines: Column, options: ChunkOptions) -> Column:
    """Overlapping windows over an array of lines, ending at a blank line where one is near.

    The next window starts a step further on, or right after this one where it
    was cut shorter than that, so that every line is covered.
    """
    step = max(1, options.window - options.overlap)
    advance = max(1, min(step, options.window - LOOK_BACK))
    window = "array<struct<start:int,end:int,kind:string,unit:string>>"

    def fold(blanks: Column) -> Column:
        n = F.size(blanks)

        def next_window(state: Column, _: Column) -> Column:
            start = state["next"]
            full = F.least(n - 1, start + options.window - 1)
            low = F.greatest(full - LOOK_BACK, start) + 1
            at = F.array_position(F.reverse(F.slice(blanks, low + 1, full - low + 1)), True).cast("int")
            end = F.when(at > 0, full - at).otherwise(full)
            grown = F.array_append(
                state["done"],
                F.struct(start.alias("start"), end.alias("end"), F.lit("lines").alias("kind"), F.lit("").alias("unit")),
            )
            moved = F.when(end >= n - 1, n).otherwise(F.least(start + step, end + 1))
            return F.when(start >= n, state).otherwise(F.struct(moved.alias("next"), grown.alias("done")))

        rounds = F.sequence(F.lit(1), F.ceil(n / advance).cast("int") + LOOK_BACK + 1)
        empty = F.struct(F.lit(0).alias("next"), F.array().cast(window).alias("done"))
        return F.aggregate(rounds, empty, next_window)["done"]

    return let(F.transform(lines, is_blank), fold)


def _as_chunks(files: DataFrame, spans: Column, options: ChunkOptions) -> DataFrame:
    """``files(rel_path, lang, lines)`` and their spans to one row per non-blank chunk."""
    cut = files.withColumn("spans", _cut_oversize(F.col("lines"), spans, options))
    chunks = F.transform(
        "spans",
        lambda s: F.struct(
            _slice_text(F.col("lines"), s["start"], s["end"]).alias("content"),
            (s["start"] + 1).alias("start_line"),
            (s["end"] + 1).alias("end_line"),
            s["unit"].alias("unit"),
            s["kind"].alias("unit_kind"),
        ),
    )
    filled = F.filter(chunks, lambda c: ~is_blank(c["content"]))
    exploded = cut.select("rel_path", "lang", F.posexplode_outer(filled))
    return exploded.where(F.col("pos").isNotNull()).select("rel_path", F.col("pos").alias("ordinal"), "col.*", "lang")


def chunk_text_files(files: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Line windows for every row of ``files(rel_path, content)``; nothing is shuffled."""
    filled = files.where(~is_blank(F.col("content")))
    lined = filled.select(
        "rel_path", detect_language(F.col("rel_path")).alias("lang"), _lines(source_text(F.col("content"))).alias("lines")
    )
    return _as_chunks(lined.withColumn("windows", line_windows(F.col("lines"), options)), F.col("windows"), options)


def chunk_code_files(files: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Declaration chunks; a file without declarations gets line windows."""
    # Both uses below need exactly these two columns and this filter, which the join would
    # otherwise add to one of them, so Spark reads and shuffles the files once.
    filled = files.where(F.col("rel_path").isNotNull() & ~is_blank(F.col("content")))
    placed = filled.select("rel_path", "content").repartition("rel_path")
    texts = placed.select(
        "rel_path", detect_language(F.col("rel_path")).alias("lang"), source_text(F.col("content")).alias("text")
    )
    spans = _merge_small(_with_gaps(_declarations(_line_features(texts))), options.min_lines)
    by_file = spans.groupBy("rel_path").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "unit"))).alias("found")
    )
    # Both sides lie by file already; sizes after Python readers are guesses, so no broadcast.
    lined = texts.select("rel_path", "lang", _lines(F.col("text")).alias("lines"))
    lined = lined.join(by_file.hint("merge"), "rel_path", "left")
    return _as_chunks(lined, F.coalesce("found", line_windows(F.col("lines"), options)), options)


def is_code(path: Column) -> Column:
    return detect_language(path).isin(sorted(DECLARATIONS))


def chunk_files(files: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """``files(rel_path, content)`` to ``(rel_path, ordinal, content, start_line,
    end_line, unit, unit_kind, lang)``; lines are 1-based and inclusive."""
    code = is_code(F.col("rel_path"))
    return chunk_text_files(files.where(~code), options).unionByName(chunk_code_files(files.where(code), options))
