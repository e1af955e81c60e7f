"""Signature rules for licences, derived from a table of names and a table of forms.

Each family below is one licence: its label, what it is called, which versions it has, and the
words or addresses by which its texts are known. Every family is written out in the same forms
(SPDX tag, name with version, grant sentence, address, file header), which makes the rules.
A rule has a keyword, lower case and literal, without which its pattern can't match; patterns run
over lower-cased bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Family:
    label: str
    names: tuple[str, ...]
    spdx: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    address: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    keyword: bytes
    pattern: re.Pattern = field(compare=False)
    priority: int
    weight: float


#: Names, identifiers, addresses and characteristic sentences of public licences.
FAMILIES = (
    Family("agpl", ("gnu affero general public license", "affero gpl"), ("agpl-3.0", "agpl-1.0"), ("3", "1"), ("gnu.org/licenses/agpl",)),
    Family("lgpl", ("gnu lesser general public license", "gnu library general public license"), ("lgpl-2.0", "lgpl-2.1", "lgpl-3.0"), ("2", "2.1", "3"), ("gnu.org/licenses/lgpl",)),
    Family("gpl", ("gnu general public license", "general public license"), ("gpl-1.0", "gpl-2.0", "gpl-3.0"), ("1", "2", "3"), ("gnu.org/licenses/gpl",), ("any later version published by the free software foundation",)),
    Family("gfdl", ("gnu free documentation license",), ("gfdl-1.1", "gfdl-1.2", "gfdl-1.3"), ("1.1", "1.2", "1.3"), ("gnu.org/licenses/fdl",), ("with no invariant sections",)),
    Family("apache", ("apache license", "apache software license"), ("apache-1.1", "apache-2.0"), ("1.1", "2.0"), ("apache.org/licenses/license",), ("limitations under the license",)),
    Family("mit", ("mit license", "expat license", "x11 license"), ("mit", "x11"), (), ("opensource.org/licenses/mit",), ("permission is hereby granted, free of charge", "the above copyright notice and this permission notice shall be included")),
    Family("bsd", ("bsd license", "berkeley software distribution license"), ("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd"), ("2-clause", "3-clause", "4-clause"), ("opensource.org/licenses/bsd",), ("redistribution and use in source and binary forms", "neither the name of the copyright holder")),
    Family("isc", ("isc license",), ("isc",), (), ("opensource.org/licenses/isc",), ("permission to use, copy, modify, and/or distribute this software",)),
    Family("mpl", ("mozilla public license",), ("mpl-1.0", "mpl-1.1", "mpl-2.0"), ("1.0", "1.1", "2.0"), ("mozilla.org/mpl",)),
    Family("epl", ("eclipse public license",), ("epl-1.0", "epl-2.0"), ("1.0", "2.0"), ("eclipse.org/legal/epl",)),
    Family("eupl", ("european union public licence",), ("eupl-1.0", "eupl-1.1", "eupl-1.2"), ("1.0", "1.1", "1.2"), ("joinup.ec.europa.eu/collection/eupl",)),
    Family("cddl", ("common development and distribution license",), ("cddl-1.0", "cddl-1.1"), ("1.0", "1.1"), ("opensource.org/licenses/cddl",)),
    Family("cpl", ("common public license",), ("cpl-1.0",), ("1.0",), ("opensource.org/licenses/cpl",)),
    Family("artistic", ("artistic license", "perl artistic license"), ("artistic-1.0", "artistic-2.0"), ("1.0", "2.0"), ("opensource.org/licenses/artistic",)),
    Family("boost", ("boost software license",), ("bsl-1.0",), ("1.0",), ("boost.org/license",)),
    Family("zlib", ("zlib license", "libpng license"), ("zlib", "libpng"), (), ("opensource.org/licenses/zlib",), ("altered source versions must be plainly marked",)),
    Family("unlicense", ("the unlicense",), ("unlicense",), (), ("unlicense.org",), ("this is free and unencumbered software",)),
    Family("wtfpl", ("do what the fuck you want to public license",), ("wtfpl",), ("2",), ("wtfpl.net",)),
    Family("openssl", ("openssl license", "ssleay license"), ("openssl",), (), ("openssl.org/source/license",)),
    Family("php", ("php license",), ("php-3.0", "php-3.01"), ("3.0", "3.01"), ("php.net/license",)),
    Family("python", ("python software foundation license", "psf license agreement"), ("psf-2.0", "python-2.0"), ("2",), ("docs.python.org/license",)),
    Family("ruby", ("ruby license",), ("ruby",), (), ("ruby-lang.org/en/about/license",)),
    Family("postgresql", ("postgresql license",), ("postgresql",), (), ("opensource.org/licenses/postgresql",)),
    Family("ofl", ("sil open font license",), ("ofl-1.0", "ofl-1.1"), ("1.0", "1.1"), ("scripts.sil.org/ofl",)),
    Family("odbl", ("open database license",), ("odbl-1.0",), ("1.0",), ("opendatacommons.org/licenses/odbl",)),
    Family("odc-by", ("open data commons attribution license",), ("odc-by-1.0",), ("1.0",), ("opendatacommons.org/licenses/by",)),
    Family("pddl", ("public domain dedication and license",), ("pddl-1.0",), ("1.0",), ("opendatacommons.org/licenses/pddl",)),
    Family("cc0", ("cc0", "creative commons zero"), ("cc0-1.0",), ("1.0",), ("creativecommons.org/publicdomain/zero",)),
    Family("cc-by-nc-nd", ("cc by-nc-nd", "creative commons attribution-noncommercial-noderivatives"), ("cc-by-nc-nd-4.0",), ("2.0", "3.0", "4.0"), ("creativecommons.org/licenses/by-nc-nd",)),
    Family("cc-by-nc-sa", ("cc by-nc-sa", "creative commons attribution-noncommercial-sharealike"), ("cc-by-nc-sa-4.0",), ("2.0", "3.0", "4.0"), ("creativecommons.org/licenses/by-nc-sa",)),
    Family("cc-by-nc", ("cc by-nc", "creative commons attribution-noncommercial"), ("cc-by-nc-4.0",), ("2.0", "3.0", "4.0"), ("creativecommons.org/licenses/by-nc",)),
    Family("cc-by-nd", ("cc by-nd", "creative commons attribution-noderivatives"), ("cc-by-nd-4.0",), ("2.0", "3.0", "4.0"), ("creativecommons.org/licenses/by-nd",)),
    Family("cc-by-sa", ("cc by-sa", "creative commons attribution-sharealike"), ("cc-by-sa-3.0", "cc-by-sa-4.0"), ("2.0", "3.0", "4.0"), ("creativecommons.org/licenses/by-sa",)),
    Family("cc-by", ("cc by", "creative commons attribution"), ("cc-by-3.0", "cc-by-4.0"), ("2.0", "3.0", "4.0"), ("creativecommons.org/licenses/by",)),
    Family("public-domain", ("public domain",), (), (), (), ("released into the public domain", "dedicated to the public domain", "no copyright reserved")),
    Family("reserved", ("all rights reserved",), (), (), (), ("unauthorized copying of this file", "may not be reproduced without permission", "proprietary and confidential")),
    Family("sspl", ("server side public license",), ("sspl-1.0",), ("1",), ("mongodb.com/licensing/server-side-public-license",)),
    Family("busl", ("business source license",), ("busl-1.1",), ("1.1",), ("mariadb.com/bsl11",)),
    Family("elastic", ("elastic license",), ("elastic-2.0",), ("2.0",), ("elastic.co/licensing/elastic-license",)),
    Family("ms-pl", ("microsoft public license",), ("ms-pl",), (), ("opensource.org/licenses/ms-pl",)),
    Family("upl", ("universal permissive license",), ("upl-1.0",), ("1.0",), ("opensource.org/licenses/upl",)),
)

_OUTSIDE = rb"[^0-9a-z\x80-\xff]"
_GAP = _OUTSIDE + rb"++"
_BEFORE, _AFTER = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"


def _phrase(text: str) -> bytes:
    """Words of ``text`` in a row, with whatever stands between them outside words."""
    return _GAP.join(re.escape(w.encode()) for w in re.findall(r"[0-9a-z]+", text))


def _version(text: str) -> bytes:
    named = _GAP + rb"(?:version|v)" + _OUTSIDE + rb"*+"
    return rb"(?:" + named + rb"|,?[\s(]{1,3}(?:licence|license)?[\s]{0,2})" + _phrase(text)


#: Forms of a rule, the surest first: its name, its weight.
FORMS = (("tag", 0.98), ("address", 0.95), ("grant", 0.9), ("version", 0.85), ("sentence", 0.8), ("file", 0.75), ("name", 0.6))


def _patterns(f: Family):
    """``form, keyword, pattern`` for everything by which a family is known."""
    for tag in f.spdx:
        yield "tag", "spdx-license-identifier", rb"spdx-license-identifier:[ \t]{0,4}\(?" + re.escape(tag.encode()) + rb"(?:-only|-or-later|\+)?(?![0-9a-z.-])"
    for place in f.address:
        host, _, path = place.partition("/")
        yield "address", host, re.escape(host.encode()) + (b"/" + re.escape(path.encode()) if path else b"") + (rb"(?![a-z-])" if f.label.startswith("cc") else b"")
    for name in f.names:
        word = max(re.findall(r"[0-9a-z]+", name), key=len)
        yield "grant", word, rb"(?:licensed|released|distributed|available|published)" + _GAP + rb"under" + _GAP + rb"(?:the" + _GAP + rb"|a" + _GAP + rb"|terms" + _GAP + rb"of" + _GAP + rb"){0,3}" + _phrase(name)
        for version in f.versions:
            yield "version", word, _phrase(name) + _version(version)
        yield "file", word, rb"(?:see|in)" + _GAP + rb"(?:the" + _GAP + rb")?(?:license|licence|copying|notice)" + _GAP + rb"(?:file" + _GAP + rb")?for" + _GAP + rb"(?:the" + _GAP + rb")?" + _phrase(name)
        yield "name", word, _phrase(name)
    for sentence in f.phrases:
        word = max(re.findall(r"[0-9a-z]+", sentence), key=len)
        yield "sentence", word, _phrase(sentence)


TAG = re.compile(_BEFORE + rb"spdx-license-identifier:")
_IDENTIFIER = rb"[0-9a-z]+(?:[.:-][0-9a-z]+)*+\+?"
#: The next part of an expression: on the same line, or on the next lines within parentheses.
_PART = re.compile(rb"[ \t]*+(\(|\)|" + _IDENTIFIER + _AFTER + rb")")
_INNER = re.compile(rb"[\s*#/;]*+(\(|\)|" + _IDENTIFIER + _AFTER + rb")")
_JOINS = (b"and", b"or", b"with")


def identifiers(text: bytes, start: int):
    """``identifier, start, end`` of each licence in the SPDX expression at ``start``, exceptions left out."""
    depth, expected, last = 0, True, b""
    while part := (_INNER if depth else _PART).match(text, start):
        word, start = part[1], part.end()
        if word == b"(" and expected:
            depth += 1
        elif word == b")" and not expected and depth:
            depth -= 1
        elif not expected and word in _JOINS:
            expected, last = True, word
        elif expected and word not in (b"(", b")"):
            if last != b"with":
                yield re.sub(rb"(?:-only|-or-later|\+)$", b"", word), part.start(1), part.end(1)
            expected, last = False, b""
        else:
            return


def build() -> list[Rule]:
    """All rules in order: by form, and within a form as the families stand."""
    rank, weight = {name: k for k, (name, _) in enumerate(FORMS)}, dict(FORMS)
    found = [(rank[form], n, f.label, form, key, body) for n, f in enumerate(FAMILIES) for form, key, body in _patterns(f)]
    return [
        Rule(label, form, key.encode(), re.compile(_BEFORE + body + _AFTER), k, weight[form])
        for k, (_, _, label, form, key, body) in enumerate(sorted(found, key=lambda x: x[:2]))
    ]
