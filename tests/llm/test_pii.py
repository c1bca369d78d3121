"""Identifiers against plain patterns, and terms that reveal them."""

import math
import random
import re

import regex
from pyspark.sql import functions as F

from laggard.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        n = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in n) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def plain(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0]))


def test_identifiers(spark):
    rng = random.Random(9)
    texts = [None, "", "a@b.c_d@e.f g@h", "a@b.c@d.e", "😀 x.y+z@mail-1.example.com. 1.2.3.4.5.6.7.8 300.1.1.1 007.0.0.255", "4111 1111-1111 1111",
             "4111111111111111 4111111111111112", "+1 (415) 555-0100 and +49 30 123456 +1", "1" * 3000 + "@" + "2" * 3000, "1 " * 9000, "a" * 100_000 + "@", "+1" * 50]
    texts += ["".join(rng.choices("a1@.+ -()é5", k=200)) for _ in range(150)]
    texts += ["".join(rng.choices("0123456789 -.", weights=[4] * 10 + [2, 1, 2], k=300)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("email", F.lit("clash"))
    got = pii.find_spans(df).select("doc_id", pii.span_list(*pii.KINDS).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def people(spark):
    filler = ["the", "report", "was", "sent", "again", "about", "some", "other", "matter"]
    rng = random.Random(2)
    some = lambda k: " ".join(rng.choices(filler, k=k))
    rows = [(i, f"{some(9)} Zanzibarov wrote from zed@corp.example {some(9)}") for i in range(6)]
    rows += [(10 + i, f"{some(30)}") for i in range(60)]
    rows += [(100 + i, "copied words Uniquement near one@other.example") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_occur_only_near_an_entity_are_treated(spark):
    docs = people(spark)
    got = {r["doc_id"]: r for r in pii.find_spans(docs).withColumn("clean", pii.sanitised(F.col("text"))).collect()}
    assert [s["value"] for s in got[0]["term"]] == ["Zanzibarov", "wrote", "from"] and all(s["removed"] for s in got[0]["term"])
    assert "Zanzibarov" not in got[0]["clean"] and "<EMAIL>" in got[0]["clean"] and "zed@" not in got[0]["clean"]
    assert all(got[i]["clean"] == got[i]["text"] and not got[i]["term"] for i in range(10, 70))
    # Words that only the copies of one text have reveal its address.
    assert all([s["value"] for s in got[i]["term"]] == ["copied", "words", "Uniquement", "near"] for i in range(100, 120)) and got[100]["clean"].split() == ["<EMAIL>"]
    # The same by a join that is not broadcast.
    again = pii.find_spans(docs, few_terms=0).select("doc_id", pii.span_list(*pii.KINDS, "term").alias("s")).collect()
    spans = pii.find_spans(docs).select("doc_id", pii.span_list(*pii.KINDS, "term").alias("s")).collect()
    assert sorted(again) == sorted(spans)


def test_moderate_terms_are_generalised(spark):
    docs = people(spark).union(spark.createDataFrame([(300 + i, "somebody wrote this") for i in range(8)], "doc_id long, text string"))
    got = {r["doc_id"]: r["clean"] for r in pii.find_spans(docs, generalise=0.5).withColumn("clean", pii.sanitised(F.col("text"))).collect()}
    assert "<TERM>" in got[0] and "wrote" not in got[0] and got[300] == "somebody wrote this"


def test_odd_rows(spark):
    rows = [(1, None), (None, "x@y.zz"), (2, "x@y.zz"), (2, "x@y.zz"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS key", "'n' AS term")
    got = pii.find_spans(df).select("doc_id", "key", pii.span_list(*pii.KINDS, "term").alias("s")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "k", ""), (None, "k", "email:0:6"), (2, "k", "email:0:6"), (2, "k", "email:0:6"), (3, "k", "")], key=str)
    assert pii.find_spans(df.limit(0)).count() == 0


def test_overlapping_identifiers_are_replaced_once(spark):
    text = "call +4111111111111111 now 1.2.3.4"
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("clean", pii.sanitised(F.col("text"))).first()
    assert row["clean"] in ("call +<CARD> now <IP>", "call <PHONE> now <IP>")


def test_a_rare_name_of_one_text_is_treated(spark):
    """One text of 2,500 and 20 copies of another; the name of one stands far from the address."""
    rng = random.Random(6)
    filler = [f"word{c}{d}" for c in "abcde" for d in "abcde"]
    some = lambda k: " ".join(rng.choices(filler, k=k))
    rows = [(i, f"{some(12)}") for i in range(2500)]
    rows += [(9000, f"{some(4)} Zanzibarov {some(60)} zed@corp.example {some(4)}")]
    rows += [(9100 + i, "worda wordb Uniquement ab near one@other.example") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["term"] for r in pii.find_spans(docs).collect()}
    assert [(s["value"], s["removed"]) for s in got[9000]] == [("Zanzibarov", True)]
    assert all("Uniquement" in [s["value"] for s in got[9100 + i]] for i in range(20))
    assert not any(got[i] for i in range(2500))


def brute_terms(docs):
    """Spans of revealing terms by doc_id, from the formula, one document at a time."""
    plain_form = {"email": str.lower, "ip": str, "card": lambda v: re.sub("[^0-9]", "", v), "phone": lambda v: re.sub("[^0-9]", "", v)}
    found, words, near = {}, {}, {}
    for i, text in docs:
        spans = [(k, m) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0])]
        found[i] = {f"{k}:{plain_form[k](m[0])}" for k, m in spans}
        words[i] = {w.lower() for w in regex.findall(r"\p{L}[\p{L}\p{M}]{2,}", text or "")}
        near[i] = {w.lower() for w in regex.findall(r"\p{L}[\p{L}\p{M}]{2,}", re.sub(r"\S*[@0-9]\S*", " ", text or ""))} if found[i] else set()
    n = len(docs)
    n_t = {t: sum(t in words[i] for i, _ in docs) for t in set().union(*near.values())}
    flagged = {}
    for e in set().union(*found.values()):
        holders = [i for i, _ in docs if e in found[i]]
        for t in set().union(*[near[i] for i in holders]):
            n_et, n_e = sum(t in near[i] for i in holders), len(holders)
            if n > n_e:
                d = math.log2(n * n_et / (n_e * (n_t[t] + 1))) / math.log2(n / n_e)
                if d >= pii.GENERALISE:
                    for i in holders:
                        if t in near[i]:
                            flagged.setdefault(i, {}).setdefault(t, set()).add(d >= pii.REMOVE)
    out = {}
    for i, text in docs:
        spans = [(m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0])]
        hits = [(m.start(), m.end(), m[0]) for m in regex.finditer(r"\p{L}[\p{L}\p{M}]{2,}", text or "")]
        out[i] = [(a, b, max(flagged[i][w.lower()])) for a, b, w in hits
                  if w.lower() in flagged.get(i, {}) and not any(x < b and a < y for x, y in spans)]
    return out


def test_term_spans_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(12)
    pool = ["rare%s" % c for c in "abcdefgh"] + ["the", "and", "for", "été", "a1", "x@y.zz", "z@y.zz", "1.2.3.4", "+49 30 123456", "Wörter", "wörter"]
    rows += [(10_000 + i, " ".join(rng.choices(pool, k=rng.randrange(1, 25)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["removed"]) for s in r["term"]] for r in pii.find_spans(docs).collect()}
    want = brute_terms(rows)
    assert got == want and sum(map(len, want.values())) > 100


def test_long_text_of_addresses(spark):
    """80,000 addresses in one text, and others of the same entities."""
    text = " ".join(f"user{i}@corp.example Name{chr(97 + i % 26) * 3}" for i in range(80_000))
    docs = spark.createDataFrame([(1, text), (2, "user1@corp.example only"), (3, "nothing at all")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_spans(docs).withColumn("clean", pii.sanitised(F.col("text"))).collect()}
    assert len(got[1]["email"]) == 80_000 and got[1]["clean"].count("<EMAIL>") == 80_000 and "@" not in got[1]["clean"]
    assert [(s["start"], s["end"]) for s in got[1]["email"]] == [m.span() for m in re.finditer(PLAIN["email"], text)]
    assert got[3]["clean"] == "nothing at all"
