"""Language identification that fuses four kinds of evidence by Bayes' rule.

* The text: likelihoods of byte trigrams, counted over all documents whose language is declared.
* The language that the markup (a page's ``lang`` attribute) or the table declares: how often such
  a declaration goes with each language, counted over all rows.
* The suffix of the address: country suffixes favour the languages of the country.
* The host: how its other rows were voted, smoothed towards its domain, and that towards all rows.
  Votes are counted by grouped aggregation; a row's own vote is taken off again.

Texts are read in place and turned into one number for each language; only these narrow rows are
shuffled, by host, where a host with very many rows is a key that Spark splits.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.base import Scratch
from recollect.llm.words import pieces, slices

#: Trigrams are hashed to this many bits; pseudo-count of a trigram.
BITS, ALPHA = 15, 0.5
#: Trigrams that a text's evidence counts as at most: they repeat and depend on each other, so a
#: long text is not surer than this many independent ones. All of it is read for their mean.
SATURATION = 60
#: Weight in rows of a domain's shares for a host, and of all rows' shares for a domain.
HOST_PULL, DOMAIN_PULL = 5.0, 20.0
#: How much likelier a country suffix is with a language of the country.
SUFFIX_ODDS = 8.0
#: Languages of country suffixes.
COUNTRY = {
    "ar": "es", "at": "de", "be": "nl fr de", "bo": "es", "br": "pt", "ca": "en fr", "ch": "de fr it", "cl": "es",
    "cn": "zh", "co": "es", "cz": "cs", "de": "de", "dk": "da", "ec": "es", "es": "es", "fi": "fi sv", "fr": "fr",
    "gr": "el", "hu": "hu", "ie": "en ga", "il": "he", "in": "en hi", "ir": "fa", "it": "it", "jp": "ja", "kr": "ko",
    "li": "de", "lu": "fr de lb", "mx": "es", "nl": "nl", "no": "no nb nn", "nz": "en", "pe": "es", "pl": "pl",
    "pt": "pt", "ro": "ro", "ru": "ru", "se": "sv", "sk": "sk", "tr": "tr", "ua": "uk", "uk": "en", "us": "en",
    "uy": "es", "ve": "es", "vn": "vi", "au": "en",
}
_PIECE = 1 << 18

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[list(range(97, 123)) + list(range(128, 256))] = list(range(97, 123)) + list(range(128, 256))

_TAG = re.compile(r"<(!--|/?[a-zA-Z]+)")
_DECLARED = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.IGNORECASE)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)


def visible(page: str | None) -> str:
    """The text between tags, without scripts, styles and comments. One pass, whatever is unclosed."""
    page, out, at = page or "", [], 0
    lowered = None
    while m := _TAG.search(page, at):
        out.append(page[at : m.start()])
        name = m[1].lower()
        if name in ("script", "style"):
            lowered = lowered if lowered is not None else page.translate(_ASCII_LOWER)
            end = lowered.find(f"</{name}", m.end())
        elif name == "!--":
            end = page.find("-->", m.end())
        else:
            end = page.find(">", m.end())
        if end < 0:
            return html.unescape(" ".join(out))
        at = end + (3 if name == "!--" else 0 if name in ("script", "style") else 1)
    return html.unescape(" ".join([*out, page[at:]]))


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def declared_language(page: str | None) -> str | None:
    m = _DECLARED.search(page or "")
    return m[1].lower() if m else None


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower().rstrip(".") or None if m else None


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of some texts, one after another, and where each text's begin and end."""
    raw = _LETTERS[np.frombuffer(b"  ".join([b"", *texts, b""]), dtype=np.uint8)].astype(np.uint32)
    codes = raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))
    codes = (codes * np.uint32(2654435769)) >> np.uint32(32 - BITS)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 2) - sizes - 1  # one space before the text
    return codes, np.stack([starts, starts + sizes])


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode()


# -- the model ------------------------------------------------------------------


def primary(column) -> F.Column:
    """The language of a declaration: its part before any hyphen, in lower case."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1)), F.lit(""))


def trained(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages declared in ``lang``, and log likelihoods of the trigrams, a row for each.

    Counts cover all documents; a language is one row of 2^BITS numbers on the driver.
    """
    named = docs.select(primary(F.col("lang")).alias("lang"), "text").where("lang is not null")
    languages = sorted(r["lang"] for r in named.select("lang").distinct().collect())
    place = {x: k for k, x in enumerate(languages)}
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * size, dtype=np.int64)
        for batch in pieces(batches):
            texts = [_bytes(t) for t in batch.column("text").to_pylist()]
            own = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for a, b in slices([len(t) for t in texts], _PIECE):
                codes, (starts, ends) = trigrams(texts[a:b])
                owner = np.repeat(own[a:b], ends - starts + 2)[: len(codes)]
                owner = np.concatenate([owner, np.full(len(codes) - len(owner), own[b - 1])])
                total += np.bincount(owner * size + codes, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    rows = named.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) * size, dtype=np.float64)
    counts[rows["at"]] = rows["n"]
    counts = counts.reshape(len(languages), size) + ALPHA
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def evidence(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """``rows`` of ``kind, id, text, url, declared, host`` as narrow rows with the text's evidence.

    Pages (``kind`` page) are stripped of markup, and their declaration and host are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(model.T)  # a row for each trigram
        for batch in pieces(batches):
            kinds, urls = batch.column("kind").to_pylist(), batch.column("url").to_pylist()
            raw, told = batch.column("text").to_pylist(), batch.column("declared").to_pylist()
            hosts = batch.column("host").to_pylist()
            texts = [None] * len(raw)
            for k, (kind, text) in enumerate(zip(kinds, raw)):
                if kind == "page":
                    told[k], hosts[k] = declared_language(text), host_of(urls[k])
                    text = visible(text)
                texts[k] = _bytes(text)
            scores, n = np.zeros((len(texts), len(languages))), np.zeros(len(texts), dtype=np.int64)
            for a, b in slices([len(t) for t in texts], _PIECE):
                codes, (starts, ends) = trigrams(texts[a:b])
                likely = table[codes]
                for k in range(a, b):
                    n[k] = ends[k - a] - starts[k - a] if texts[k] else 0
                    if n[k]:
                        scores[k] = likely[starts[k - a] : ends[k - a]].mean(axis=0, dtype=np.float64) * min(n[k], SATURATION)
            best = [languages[j] if m else None for j, m in zip(scores.argmax(axis=1), n)] if languages else [None] * len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kind"), batch.column("id"), pa.array(hosts, pa.string()), pa.array(told, pa.string()),
                    pa.array(best, pa.string()), pa.array(list(scores.round(9)), pa.list_(pa.float64())),
                ],
                ["kind", "id", "host", "declared", "vote", "score"],
            )

    return rows.select("kind", "id", "text", "url", "declared", "host").mapInArrow(
        run, "kind string, id long, host string, declared string, vote string, score array<double>"
    )


# -- fusion ---------------------------------------------------------------------


def domain(host: F.Column) -> F.Column:
    """The last two parts of a host; a host without a point is its own domain."""
    return F.substring_index(host, ".", -2)


def priors(rows: DataFrame, languages: list[str], scratch: Scratch) -> DataFrame:
    """Votes by host and by domain, an array for each host in order of ``languages``."""
    votes = [F.sum((F.col("vote") == x).cast("long")).alias(f"v{k}") for k, x in enumerate(languages)]
    by_host = scratch.keep(rows.where("host is not null").groupBy("host").agg(*votes).withColumn("domain", domain(F.col("host"))))
    named = [F.coalesce(f"v{k}", F.lit(0)) for k in range(len(languages))]
    by_domain = by_host.groupBy(F.col("domain").alias("d")).agg(
        F.array(*[F.sum(c) for c in named]).alias("domain_votes")
    )
    own = by_host.select(F.col("host").alias("h"), "domain", F.array(*named).alias("host_votes"))
    return scratch.keep(own.join(by_domain, F.col("domain") == F.col("d")).select("h", "host_votes", "domain_votes"))


def identified(rows: DataFrame, languages: list[str], model: np.ndarray, scratch: Scratch) -> DataFrame:
    """``kind, id, host, lang, confidence, text_lang, declared`` for every row.

    A row without text, declaration and host is given the language that is most frequent overall.
    Without any declared language to learn from, all languages are null.
    """
    scored = scratch.keep(evidence(rows, languages, model))
    if not languages:
        return scored.select("kind", "id", "host", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.col("vote").alias("text_lang"), "declared")
    place = {x: k for k, x in enumerate(languages)}
    size = len(languages)
    # How declarations go with votes, over all rows: one row for each declared language.
    pairs = np.ones((size, size))
    overall = np.ones(size)
    for r in scored.where("vote is not null").groupBy("declared", "vote").count().where(
        F.col("declared").isNull() | F.col("declared").isin(languages)
    ).collect():
        overall[place[r["vote"]]] += r["count"]
        if r["declared"] is not None:
            pairs[place[r["declared"]], place[r["vote"]]] += r["count"]
    told = np.log(pairs / pairs.sum(axis=0, keepdims=True))  # a declaration, given the language
    table = priors(scored, languages, scratch)
    joined = scored.join(table, F.col("host") == F.col("h"), "left").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_fused(r, languages, place, told, overall) for r in batch.to_pylist()]
            names = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("id"), batch.column("host"), *names, batch.column("vote"), batch.column("declared")],
                ["kind", "id", "host", "lang", "confidence", "text_lang", "declared"],
            )

    return joined.mapInArrow(
        run, "kind string, id long, host string, lang string, confidence double, text_lang string, declared string"
    )


def _fused(r: dict, languages: list[str], place: dict[str, int], told: np.ndarray, overall: np.ndarray) -> tuple[str, float]:
    total = np.array(r["score"])
    own = np.zeros(len(languages))
    if r["vote"] is not None:
        own[place[r["vote"]]] = 1.0
    share = (overall - own).clip(1e-9)
    share /= share.sum()
    if r["host_votes"] is not None:
        for votes, pull in ((r["domain_votes"], DOMAIN_PULL), (r["host_votes"], HOST_PULL)):
            votes = np.array(votes) - own
            share = (votes + pull * share) / (votes.sum() + pull)
    total = total + np.log(share)
    if r["declared"] in place:
        total = total + told[place[r["declared"]]]
    if r["host"]:
        for x in COUNTRY.get(r["host"].rpartition(".")[2], "").split():
            if x in place:
                total[place[x]] += np.log(SUFFIX_ODDS)
    weights = np.exp(total - total.max())
    best = int(total.argmax())
    return languages[best], round(float(weights[best] / weights.sum()), 6)


def languages_of(docs: DataFrame, pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents and pages with their language: one row each, ``kind`` telling which.

    Documents declare their language in ``lang`` and count as hosted by ``source``. Null and empty
    texts have no text evidence and rest on the rest. Repeated rows are judged each. Empty tables
    give no rows.
    """
    languages, model = trained(docs)
    both = docs.select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("url"),
        primary(F.col("lang")).alias("declared"), F.col("source").alias("host"),
    ).union(
        pages.select(
            F.lit("page"), "page_id", F.col("html"), "url", F.lit(None).cast("string"), F.lit(None).cast("string")
        )
    )
    return identified(both, languages, model, scratch)
