"""Licence scans against plain regular expressions and a recursive-descent parser."""

import random
import re

import duckdb
import pytest

from laggard.llm import licenses, queries


def brute(text):
    """The contract's columns of one text."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.split()]
             for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_query_against_brute_force(spark, small):
    got = queries.QUERIES["op11_license_scan"](spark, small).collect()
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{small}/documents.parquet')").fetchall()
    texts = dict(rows)
    assert len(got) == len(rows) and any(r["n_base"] for r in got)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(r["labels"])


def test_random_texts():
    rng, scanner = random.Random(4), licenses.Scanner()
    pool = ["CC", "by", "cc", "By", "General", "PUBLIC", "license", "all", "rights", "reserved", "é", "x7", "ß", "nc", " ", "\n", "-", "\x7f", "İ", "—"]
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice([" ", ".", "", "  "]) for _ in range(rng.randrange(60)))
        n, places, _, _ = scanner.scan(text)
        base = [p for p in places if p[1]]
        got = (n, sum(p[2] for p in base), min((p[3] for p in base), default=None), max((p[4] for p in base), default=None), ",".join(sorted(p[0] for p in base)))
        assert got == brute(text), text


def by_descent(tokens):
    """Grade of an expression, by recursive descent."""
    at = 0

    def sides(inner, word, pick):
        nonlocal at
        value = inner()
        while at < len(tokens) and tokens[at] == word:
            at += 1
            value = pick(value, inner())
        return value

    def single():
        nonlocal at
        at += 1
        if tokens[at - 1] == "(":
            value = sides(lambda: sides(single, "and", max), "or", min)
            at += 1
            return value
        value = licenses.grade(tokens[at - 1])
        if at < len(tokens) and tokens[at] == "with":
            at += 2
            value /= 2
        return value

    return sides(lambda: sides(single, "and", max), "or", min)


def test_expressions_against_recursive_descent():
    rng = random.Random(9)

    def make(depth):
        kind = rng.randrange(5 if depth else 1)
        if kind < 2:
            return rng.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "x-y", "GPL-2.0+ WITH Classpath-exception-2.0", "CC-BY-NC-4.0"])
        if kind == 2:
            return f"({make(depth - 1)})"
        return f"{make(depth - 1)} {rng.choice(['AND', 'or', 'OR', 'and'])} {make(depth - 1)}"

    for _ in range(500):
        text = make(5)
        tokens = re.findall(r"[()]|[^\s()]+", text.lower())
        assert licenses.parsed(text.encode()).grade == by_descent(tokens), text


@pytest.mark.parametrize("text", ["", "AND", "MIT AND", "(MIT", "MIT)", "MIT Apache-2.0", "MIT WITH (a OR b)", "(a AND b) WITH c", "MIT & x", "()", "MIT WITH"])
def test_no_expression(text):
    assert licenses.parsed(text.encode()) is None


def test_long_and_deep():
    deep = "SPDX-License-Identifier: " + "(" * 50_000 + "MIT" + ")" * 50_000
    n, places, written, score = licenses.Scanner().scan(deep)
    assert [p[0] for p in places] == ["mit"] and score == licenses.grade("mit") and len(written) == 1
    many = "all rights reserved. " * 100_000
    n, places, _, score = licenses.Scanner().scan(many)
    assert n == 300_000 and places == [("reserved", True, 100_000, 0, 299_997)] and score == 1.0
    assert licenses.Scanner().scan("SPDX-License-Identifier: " + "g" * 1_000_000)[3] == licenses.OTHER_GRADE


def test_odd_rows(spark):
    tag = "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause */\nSPDX-License-Identifier: MIT MIT"
    rows = [(1, None), (None, ""), (2, tag), (2, tag), (3, "General Public License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS found", "2 AS places", "3 AS n_words")
    found = docs.withColumn("result", licenses.licenses(docs.text))
    got = [r["result"] for r in found.collect()]
    assert [g["n_words"] for g in got[:2]] == [0, 0] and got[0]["places"] == [] and got[0]["score"] == 0
    assert [p["label"] for p in got[2]["places"]] == ["bsd-3-clause", "gpl-2.0-only", "mit", "unparsed"] and got[2] == got[3]
    assert got[2]["expressions"] == ["(MIT OR GPL-2.0-only) AND BSD-3-Clause", "MIT MIT"] and got[2]["score"] == 0.7
    assert [(p["label"], p["base"]) for p in got[4]["places"]] == [("gpl", True)]
    assert docs.limit(0).select(licenses.licenses(docs.text)).count() == 0
