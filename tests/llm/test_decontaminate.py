"""Benchmark items in documents, against plain edit distances."""

import random

from laggard.llm import decontaminate as D


def distances(pattern, text):
    """Least edit distance of the pattern to a part of the text ending at each place."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row


def edited(item, edits, rng):
    out = list(item)
    for _ in range(edits):
        at, what = rng.randrange(len(out)), rng.random()
        if what < 0.34:
            out[at] = rng.choice("abc ")
        elif what < 0.67:
            del out[at]
        else:
            out.insert(at, rng.choice("xyz"))
    return "".join(out)


def test_every_copy_within_the_budget_is_found():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(60)]
    items = [(i, D.normalised(" ".join(rng.choices(words, k=rng.randint(3, 30))))) for i in range(15)]
    matcher = D.Matcher(items, D.ERROR_RATE)
    for _ in range(120):
        n, item = rng.choice(items)
        text = D.normalised(" ".join(rng.choices(words, k=20)) + edited(item, rng.randint(0, len(item) // 7), rng) + " the end")
        found = {m[0]: m for m in matcher.matches(text)}
        for i, p in items:
            best = min(distances(p, text))
            assert (i in found) == (best <= int(D.ERROR_RATE * len(p)))
            if i in found:
                _, d, start, end = found[i]
                assert d == best and distances(p, text[start:end])[-1] == d


def test_blocks_give_the_same_matches_and_odd_rows(spark):
    rng = random.Random(5)
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12))) for i in range(12)]
    docs = [(i, f"before {edited(t, 3, rng).upper()}\n after") for i, t in items] + [(50, None), (51, ""), (None, items[0][1]), (52, items[1][1] * 50), (53, "clean text")]
    docs.append(docs[0])
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS item_id", "'c' AS found")
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, items[2][1]), (None, "text without id")], "item_id long, text string")
    rows = lambda **kw: sorted(map(tuple, D.find_leaks(docs, benchmark, **kw).collect()), key=str)
    one = rows()
    assert one == rows(block_bytes=100)
    assert {r[:2] for r in one} == {(i, i) for i in range(12)} | {(2, 92), (None, 0), (52, 1)}
    assert sum(r[0] == 0 for r in one) == 2
    kept = D.decontaminated(docs, benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [50, 51, 53] and kept.columns == docs.columns
    assert D.find_leaks(docs, benchmark.limit(0)).count() == 0 and D.decontaminated(docs.limit(0), benchmark).count() == 0


def test_items_without_an_id_are_found(spark):
    items = spark.createDataFrame([(None, "a question that has no number"), (None, None), (4, "another question with a number")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a question that has no number y"), (2, "clean words only"), (3, "a question that has no number another question with a number")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()}
    assert found == {(1, None), (3, None), (3, 4)}
    assert [r["doc_id"] for r in D.decontaminated(docs, items).collect()] == [2]
