"""Operator 10: license scans.

One Aho-Corasick automaton runs over a text's normalised words (A-Z lower-cased; runs of 0-9, a-z and characters
beyond ASCII) and finds the base phrases, further notice phrases and identifier tags at once. Where an identifier tag
stands, be it several on a line, the license expression after it in the raw text is read with a shunting-yard parser (``with`` binds before
``and``, ``and`` before ``or``), and evaluated: its labels, and whether a permissive choice is enough.

Only identifiers of FAMILIES, and those that begin with LicenseRef-, are operands; after ``with`` any name is one. A tag
that no such expression follows gives no label.

score: 1 for a whole expression, 0.9 for a base phrase, 0.8 for another notice, 0.5 for a tag whose expression can't
be read, 0 for nothing; the highest counts.

Defined results: null and empty texts have no words, empty labels and score 0; first_word and last_word are null
without a base phrase.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame

from .common import fresh_name, struct_udf, with_struct

#: The base phrases.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of well-known licenses, as normalised words.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier",)
PERMISSIVE = frozenset("mit apache bsd isc bsl cc-by cc0 public-domain blueoak hpnd icu libpng ncsa postgresql psf python unicode upl w3c wtfpl x11 zlib".split())
#: Families of license identifiers, by how they begin, and their labels where these differ.
FAMILIES = tuple(
    "0BSD AFL AGPL Apache APSL Artistic Beerware BlueOak BSD BSL BUSL CAL CC-BY CC0 CDDL CECILL CPAL CPL ECL EFL Elastic EPL EUPL FTL GFDL GPL HPND ICU IJG Info-ZIP IPL ISC LGPL libpng LPL LPPL MIT MPL MS-PL MS-RL MulanPSL NASA NCSA NPL ODbL OFL OLDAP OpenSSL OSL PDDL PHP PostgreSQL PSF Python QPL RPL Ruby SGI-B Sleepycat SPL SSPL TCL Unicode Unlicense UPL Vim W3C WTFPL X11 Xnet ZPL Zlib".lower().split()
)
LABELS = {"0bsd": "bsd", "unlicense": "public-domain"}
LICENSE_REF = "licenseref-"

norm_words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
tag_of = re.compile(r"spdx[^0-9a-z\n\x80-\U0010ffff]{1,3}license[^0-9a-z\n\x80-\U0010ffff]{1,3}identifier[ \t]*:?[ \t]*", re.I).finditer
token_of = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+-]*))").match
BINDS = {"or": 1, "and": 2, "with": 3}


known_of = re.compile(rf"({'|'.join(sorted(map(re.escape, FAMILIES), key=len, reverse=True))})(?:[-+.0-9][a-z0-9.+-]*)?").fullmatch


def family(identifier: str) -> str | None:
    """The label of a license identifier; None if it is none."""
    low = identifier.lower().rstrip(".")
    if low.startswith(LICENSE_REF) and low != LICENSE_REF:
        return low
    return LABELS.get(m[1], m[1]) if (m := known_of(low)) else None


@dataclass
class Value:
    labels: frozenset[str]
    permissive: bool


def evaluate(text: str, at: int = 0, end: int | None = None) -> Value | None:
    """The longest license expression that begins at ``at`` and ends on its line, before ``end``; None if there is none."""
    values: list[Value] = []
    waiting: list[str] = []
    best, operand, end = None, True, len(text) if end is None else end

    def apply() -> None:
        op = waiting.pop()
        b, a = values.pop(), values.pop()
        if op == "with":  # an exception only adds permissions
            values.append(Value(a.labels, a.permissive))
        else:
            values.append(Value(a.labels | b.labels, a.permissive and b.permissive if op == "and" else a.permissive or b.permissive))

    def settled() -> Value | None:
        """What it is worth if it ended here, provided no bracket is open."""
        if "(" in waiting:
            return None
        v, w = values[:], waiting[:]
        while waiting:
            apply()
        out = values[0]
        values[:], waiting[:] = v, w
        return out

    while m := token_of(text, at, end):
        at = m.end()
        bracket, word = m.groups()
        if operand:
            if bracket == "(":
                waiting.append("(")
                continue
            if not word or word.lower() in BINDS:
                break
            label = family(word)
            if label is None and not (waiting and waiting[-1] == "with"):
                break
            values.append(Value(frozenset([label] if label else []), label in PERMISSIVE))
            operand = False
        elif bracket == ")":
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                break
            waiting.pop()
        elif word and word.lower() in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[word.lower()]:
                apply()
            waiting.append(word.lower())
            operand = True
            continue
        else:
            break
        best = settled() or best
    return best


class Scanner:
    def __init__(self):
        self.found = ahocorasick.Automaton()
        kinds: dict[str, list] = {}
        for phrase, label in BASE.items():
            kinds.setdefault(phrase, []).append(("base", label))
        for phrase, label in NOTICES.items():
            kinds.setdefault(phrase, []).append(("notice", label))
        for phrase in TAGS:
            kinds.setdefault(phrase, []).append(("tag", ""))
        for phrase, what in kinds.items():
            self.found.add_word(f" {phrase} ", (len(phrase) + 1, what))
        self.found.make_automaton()

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        words = norm_words(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes: A-Z only
        line = f" {' '.join(words)} "
        places, base, more, tagged, score, permissive = [], set(), set(), False, 0.0, None
        for end, (length, what) in self.found.iter(line):
            for kind, label in what:
                if kind == "base":
                    places.append(end - length)
                    base.add(label)
                elif kind == "notice":
                    more.add(label)
                else:
                    tagged = True
        score = 0.9 if base else 0.8 if more else 0.0
        if tagged:
            score = max(score, 0.5)
            tags = [m.span() for m in tag_of(text)]
            for (_, at), (end, _) in zip(tags, [*tags[1:], (len(text), 0)], strict=True):  # an expression ends before the next tag
                if value := evaluate(text, at, end):
                    more |= value.labels
                    permissive = value.permissive if permissive is None else permissive and value.permissive
                    score = 1.0
        first = last = None
        if places:
            first, last = (line.count(" ", 0, p) for p in (min(places), max(places)))
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score, permissive


FIELDS = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("permissive", "boolean")]


def with_licenses(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of FIELDS; also the struct's name. Other columns stay as they are."""

    def setup() -> Callable:
        return Scanner()

    name = fresh_name(docs, "license")
    return with_struct(docs, struct_udf(setup, FIELDS), text, name), name
