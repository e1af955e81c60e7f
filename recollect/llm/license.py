"""Licence scan with ordered signature rules.

One automaton of the rules' keywords reads a whole text; only rules whose keyword it found run.
Detections are settled by rank and containment: a detection inside one of higher rank, or inside a
longer one of the same label, says nothing new and is suppressed. What remains gives the labels
and the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.llm.rules import FAMILIES, TAG, Rule, build, identifiers
from recollect.llm.words import NOT_ALNUM, Words, pieces, slices

#: The base phrases and their labels, as fixed by the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Too short to be a keyword by itself: rules with it run where the base phrase stands.
SHORT = b"cc"
#: Bytes of text that are handled together.
_TOGETHER = 1 << 18
_OUTSIDE = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<label:string,form:string,first:long,last:long>>"
)


@dataclass(frozen=True)
class Detection:
    rule: Rule
    start: int
    end: int


@cache
def _compiled():
    """The rules, the automaton of their keywords, and the base patterns; once a process."""
    import ahocorasick

    rules, gated = build(), {}
    for rule in rules:
        if rule.keyword != SHORT and rule.form != "tag":
            gated.setdefault(rule.keyword, []).append(rule)
    automaton = ahocorasick.Automaton()
    for keyword, some in gated.items():
        automaton.add_word(keyword.decode("latin-1"), tuple(some))
    for phrase in BASE:  # each base phrase by its longest word
        word = max(phrase.split(), key=len)
        key = b"base:" + phrase.encode()
        held = automaton.get(word, ())
        automaton.add_word(word, (*held, key))
    automaton.add_word("spdx-license-identifier", ("tag",))
    automaton.make_automaton()
    tags = {tag.encode(): [r for r in rules if r.form == "tag" and r.pattern.fullmatch(b"spdx-license-identifier:" + tag.encode())][0] for f in FAMILIES for tag in f.spdx}
    inside = rb"[0-9a-z\x80-\xff]"
    base = {
        b"base:" + p.encode(): (label, re.compile(rb"(?<!" + inside + rb")" + (_OUTSIDE + rb"+").join(w.encode() for w in p.split()) + rb"(?!" + inside + rb")"))
        for p, label in BASE.items()
    }
    return automaton, base, [r for r in rules if r.keyword == SHORT], tags


def tagged(text: bytes, tags: dict[bytes, Rule]) -> Iterator[Detection]:
    """Each known licence of each SPDX expression; the first one's detection includes the keyword."""
    for keyword in TAG.finditer(text):
        for k, (name, start, end) in enumerate(identifiers(text, keyword.end())):
            if name in tags:
                yield Detection(tags[name], start if k else keyword.start(), end)


def settle(found: list[Detection]) -> list[Detection]:
    """Detections that no other of higher rank, or longer with the same label, contains."""
    # Ends of what is kept, as prefix maxima over the starts (a Fenwick tree): one lookup tells
    # whether anything that begins no later ends no earlier.
    place = {start: k + 1 for k, start in enumerate(sorted({d.start for d in found}))}
    furthest, kept = [-1] * (len(place) + 1), []
    for d in sorted(found, key=lambda d: (d.rule.priority, -(d.end - d.start), d.start)):
        k, reached = place[d.start], -1
        while k:
            reached = max(reached, furthest[k])
            k &= k - 1
        if reached >= d.end:
            continue
        kept.append(d)
        k = place[d.start]
        while k < len(furthest):
            furthest[k] = max(furthest[k], d.end)
            k += k & -k
    out, reach = [], {}
    for d in sorted(kept, key=lambda d: (d.start, -d.end)):
        if reach.get(d.rule.label, -1) < d.end:
            out.append(d)
            reach[d.rule.label] = d.end
    return out


def scan(text: bytes) -> tuple[list[tuple[str, int]], list[Detection]]:
    """Places of the base phrases, ``label, start``, and the settled detections of a lower-cased text."""
    automaton, base, short, tags = _compiled()
    gates = set()
    for _, value in automaton.iter(text.decode("latin-1")):
        gates.update(value)
    places, found = [], []
    for gate in gates:
        if gate == "tag":
            found += tagged(text, tags)
        elif isinstance(gate, bytes):
            label, pattern = base[gate]
            own = [(label, m.start()) for m in pattern.finditer(text)]
            places += own
            if own and label == "cc-by":
                found += [Detection(r, *m.span()) for r in short for m in r.pattern.finditer(text)]
        else:
            found += [Detection(gate, *m.span()) for m in gate.pattern.finditer(text)]
    return sorted(places, key=lambda p: p[1]), settle(found)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _rows(texts: list[bytes]) -> Iterator[tuple]:
    words = Words(texts, NOT_ALNUM)
    for k, text in enumerate(texts):
        low, high = words.bounds[k], words.bounds[k + 1]
        starts = words.starts[low:high] - words.text_starts[k]
        places, found = scan(text)
        at = np.searchsorted(starts, [p for _, p in places]).tolist()
        base = sorted({label for label, _ in places})
        labels = sorted({*base, *(d.rule.label for d in found)})
        doubt = 1.0
        for label in labels:
            doubt *= 1.0 - max([d.rule.weight for d in found if d.rule.label == label], default=0.6)
        shown = [
            {
                "label": d.rule.label, "form": d.rule.form,
                "first": int(np.searchsorted(starts, d.start, "right")) - 1, "last": int(np.searchsorted(starts, d.end)) - 1,
            }
            for d in found
        ]
        yield (
            high - low, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels),
            round(1.0 - doubt, 6), shown,
        )


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: places of base phrases, labels, score and the detections by word.

    Whole texts are read, A-Z lower-cased. A null text is an empty one: no words, no labels (empty
    strings), score 0. Repeated rows give repeated results, an empty table none. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.struct([("label", pa.string()), ("form", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(shape)]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        for batch in pieces(batches):
            texts = [(t or "").encode().translate(_LOWER) for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts], _TOGETHER):
                columns = zip(*_rows(texts[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *(pa.array(c, t) for c, t in zip(columns, types))], names
                )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
