"""Licence scans: identifier tags and notice phrases, and the expressions behind the tags.

A text is lower-cased (A-Z only) and cut into words, runs of digits, a-z and
whatever is not ASCII.  One Aho-Corasick automaton over the words, joined by
single spaces, finds all ``PHRASES``: places where their words stand
consecutively, overlapping ones included.  Where the words of a tag (such as
``SPDX-License-Identifier:``) are among them, the tags' lines are read in the
text itself.  What stands behind a tag is a licence expression; a shunting-yard
parser turns it into postfix order, with WITH before AND before OR, and a stack
evaluates it.

Every licence has a grade, from 0 (no condition) to 1 (nothing allowed).  AND
asks for both sides, the larger grade; OR leaves the choice, the smaller one; an
exception (WITH) halves the grade.  A text's score is the largest grade of what
was found in it, 0 when nothing was.

Null and empty texts have no words, no labels and score 0.  An expression that
does not parse gives the label ``UNPARSED`` with its grade; expressions may be
as long and as deeply nested as the text.  Rows are judged one by one: repeated
rows agree, an empty table gives an empty result.  A task scans one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, functions as F

# The phrases and labels of the base scan.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notice phrases and the labels they give.
MORE_PHRASES = {
    "apache license": "apache", "apache software license": "apache", "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "bsd license": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl",
    "lesser general public license": "lgpl", "library general public license": "lgpl",
    "affero general public license": "agpl", "gnu gpl": "gpl", "gnu lgpl": "lgpl", "gnu agpl": "agpl",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "attribution sharealike": "cc-by-sa",
    "attribution share alike": "cc-by-sa", "cc by nc": "cc-by-nc", "attribution noncommercial": "cc-by-nc",
    "attribution non commercial": "cc-by-nc", "cc by nd": "cc-by-nd", "attribution noderivatives": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0", "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain", "proprietary and confidential": "proprietary",
    "unauthorized copying of this file": "proprietary",
}
TAGS = ("SPDX-License-Identifier:", "License-Expression:", "PackageLicenseDeclared:", "PackageLicenseConcluded:", "LicenseConcluded:")

UNPARSED = "unparsed"
# Grade of a licence whose identifier starts with the text on the left; the longest start counts.
GRADES = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "0bsd": 0.0, "wtfpl": 0.0,
    "mit": 0.2, "apache": 0.2, "bsd": 0.2, "bsl": 0.2, "isc": 0.2, "zlib": 0.2, "python": 0.2, "psf": 0.2,
    "cc-by": 0.3, "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.8, "agpl": 0.9,
    "cc-by-nd": 0.9, "cc-by-nc": 0.9, "reserved": 1.0, "proprietary": 1.0, "none": 1.0, UNPARSED: 0.7,
}
OTHER_GRADE = 0.7  # an identifier that no start fits

FOUND = "struct<n_words:long,places:array<struct<label:string,base:boolean,n:long,first_word:long,last_word:long>>,expressions:array<string>,score:double>"

# Whatever separates words becomes a space, A-Z small letters.
_FOLD = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256)).lower()
_TAG_LINE = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])(?i:" + b"|".join(re.escape(t.encode()) for t in TAGS) + rb")([^\r\n]*)")
_COMMENT_END = re.compile(rb"\*/|-->|\*\)|#>|\"")
_TOKEN = re.compile(rb"\s*([()]|[A-Za-z0-9.:+_-]+)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def folded(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode().translate(_FOLD).split()


def tokens(expression: bytes) -> list[str] | None:
    """Identifiers, operators and brackets in lower case; None if anything else stands there."""
    out, at, expression = [], 0, expression.strip()
    while at < len(expression):
        hit = _TOKEN.match(expression, at)
        if not hit:
            return None
        out.append(hit[1].decode().lower())
        at = hit.end()
    return out


def postfix(infix: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in the order of evaluation; None if it is no expression."""
    out, waiting, operand_next = [], [], True
    for token in infix:
        if token in _BINDS:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif not operand_next:
            return None
        elif token == "(":
            waiting.append(token)
        else:
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def grade(licence: str) -> float:
    """How much a licence, by its label or identifier, restricts."""
    starts = (licence[:n] for n in range(max(map(len, GRADES)), 0, -1))
    return next((GRADES[s] for s in starts if s in GRADES), OTHER_GRADE)


class Licence(NamedTuple):
    grade: float
    names: tuple[str, ...]


def evaluated(order: list[str]) -> Licence | None:
    """Grade and licences of an expression in postfix order; None where WITH does not join a licence and an exception."""
    stack: list[tuple[float, bool]] = []  # grade, and whether it is one identifier
    names: set[str] = set()
    exceptions: set[int] = set()
    # The right operand of WITH is the identifier just before it.
    for at, token in enumerate(order):
        if token == "with":
            exceptions.add(at - 1)
    for at, token in enumerate(order):
        if token in _BINDS:
            (b, b_single), (a, a_single) = stack.pop(), stack.pop()
            if token == "with":
                if not (a_single and b_single):
                    return None
                stack.append((a / 2, False))
            else:
                stack.append((max(a, b) if token == "and" else min(a, b), False))
        else:
            stack.append((grade(token), True))
            if at not in exceptions:
                names.add(token)
    return Licence(stack[0][0], tuple(sorted(names)))


def parsed(expression: bytes) -> Licence | None:
    """Grade and licences of an expression as written; None if it does not parse."""
    order = postfix(tokens(expression) or [])
    return evaluated(order) if order else None


class Scanner:
    """The automaton of all phrases, and the scan of one text."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        listed: dict[str, list[tuple[str, bool]]] = {}
        for phrases, base in ((BASE_PHRASES, True), (MORE_PHRASES, False)):
            for phrase, label in phrases.items():
                listed.setdefault(phrase, []).append((label, base))
        for tag in TAGS:
            listed.setdefault(b" ".join(folded(tag)).decode(), []).append((None, False))
        for phrase, labels in listed.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, labels))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """Fields of ``FOUND``."""
        words = folded(text)
        line = b" " + b" ".join(words) + b" "
        places: dict[tuple[str, bool], list[int]] = {}
        tagged, at, word = False, 0, 0
        hits = [(end + 1 - size, labels) for end, (size, labels) in self.automaton.iter(line.decode("latin-1"))]
        for start, labels in sorted(hits, key=lambda h: h[0]):
            word += line.count(b" ", at, start)
            at = start
            for key in labels:
                if key[0] is None:
                    tagged = True
                elif key in places:
                    places[key][0] += 1
                    places[key][2] = word
                else:
                    places[key] = [1, word, word]
        expressions, top = [], max((grade(label) for label, _ in places), default=0.0)
        if tagged:
            names: set[str] = set()
            for hit in _TAG_LINE.finditer(text.encode()):
                written = _COMMENT_END.split(hit[1], maxsplit=1)[0].strip()
                licence = parsed(written) or Licence(GRADES[UNPARSED], (UNPARSED,))
                expressions.append(written.decode(errors="replace"))
                names.update(licence.names)
                top = max(top, licence.grade)
            for name in names:
                places.setdefault((name, False), [0, None, None])
        rows = [(label, base, n, first, last) for (label, base), (n, first, last) in sorted(places.items())]
        return len(words), rows, expressions, top


def licenses(text: Column) -> Column:
    """What the scan finds in a text, a ``FOUND`` struct.

    ``places`` has for each label, and apart for base phrases and others, the
    number of places and the first and last start word; labels from tags only
    have no place.
    """

    @F.pandas_udf(FOUND)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        names = ["n_words", "places", "expressions", "score"]
        fields = ["label", "base", "n", "first_word", "last_word"]
        for batch in batches:
            rows = [(n, [dict(zip(fields, p)) for p in places], e, s) for n, places, e, s in map(scanner.scan, batch)]
            yield pd.DataFrame(rows, columns=names)

    return of(text)


def label_list(places: Column, base: bool) -> Column:
    """Distinct labels, sorted and joined by commas: those of base phrases, or all."""
    some = F.filter(places, lambda p: p["base"]) if base else places
    return F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda p: p["label"]))), ",")
