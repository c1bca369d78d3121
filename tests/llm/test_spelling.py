"""Spelling variants against all pairs; the query against SQL is in test_llm_queries."""

import random
import zlib
from collections import Counter

import pytest

from laggard.llm import spelling


def edits(word, letters):
    cuts = [word[:i] + word[i + 1 :] for i in range(len(word))]
    puts = [word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters]
    swaps = [word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters]
    return set(cuts + puts + swaps) - {word}


def brute(counts, letters):
    near = {w: [v for v in edits(w, letters) if v in counts] for w in counts}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top and counts[top] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def word_list(seed, letters, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 13))) for _ in range(n)]
    some = [rng.choice(sorted(edits(w, letters))) for w in base for _ in range(4)]
    return Counter({w: rng.choice([2, 3, 25, 300, 4000, 50000]) for w in {*base, *some} if len(w) >= 7})


@pytest.mark.parametrize("letters, frequent, crowd", [("ab", 0, 200), ("abc", 2, 3), ("abcdeé", 8, 10), ("abß", 10**9, 1), ("aÿ", 4, 2)])
def test_near_words_are_all_found(spark, letters, frequent, crowd):
    counts = word_list(len(letters), letters, 120)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {(r["a"], r["b"]) for r in spelling.near_words(words, frequent=frequent, crowd=crowd).collect()}
    assert got == {(w, v) for w in counts for v in edits(w, letters) if v in counts and w < v}


def test_untouched_grams_are_shared():
    """What an edit leaves is a gram of both words, whatever the dictionary."""
    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "abcdef"])
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 14)))
        pool = [word[i : i + q] for q in (3, 4) for i in range(len(word) - q + 1)]
        index = spelling.gram_index([g for g in pool if rng.random() < 0.5] + ["".join(rng.choice(letters) for _ in range(rng.choice([3, 4]))) for _ in range(30)])
        touched, between = spelling.merged_lists(word, index)
        for other in edits(word, letters):
            a, b = spelling.merged_lists(other, index)
            assert touched & a if len(other) == len(word) else touched & b if len(other) < len(word) else between & a, (word, other)


def test_forms_and_roots(spark):
    """Chains of forms, from texts; repeated rows count."""
    docs, counts = [], Counter()
    for i, (word, times) in enumerate([("straight", 1200), ("straigt", 110), ("strait", 9), ("staigt", 3), ("straightt", 2), ("unrelated", 2), ("einmalig", 1)]):
        docs += [(i, " ".join([word.upper() if j % 2 else word for j in range(times)]))]
        for j in range(times):
            h = zlib.crc32(f"{i}:{word}".encode())
            counts[word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    counts = Counter({w: n for w, n in counts.items() if n >= 2 and len(w) >= 7})
    df = spark.createDataFrame(docs + [(None, None), (7, ""), (8, "été çà short")], "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS run", "4 AS id")
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_forms(df).collect()}
    assert got == brute(counts, "abcdefghijklmnopqrstuvwxyz")
    assert got["straigt"][1] == "straight"
    assert spelling.spelling_forms(df.limit(0)).count() == 0


def test_chains_are_followed_to_the_end(spark):
    words = ["a" * 7 + "b" * k for k in range(1, 9)]
    forms = spark.createDataFrame([(words[i], words[i + 1]) for i in range(7)], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.roots(forms, 3).collect()}
    assert got == {w: words[-1] for w in words[:-1]}


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(w, 5) for w in word_list(5, "abcdefgh", 200)], "word string, n long")
    all_grams = spelling.gram_dictionary(words, frequent=0)
    some = spelling.gram_dictionary(words, frequent=0, max_grams=len(all_grams) // 2)
    assert 0 < len(some) <= len(all_grams) // 2 and set(some) <= set(all_grams)
    with pytest.raises(ValueError):
        spelling.spelling_forms(words.selectExpr("1 AS doc_id", "word AS text"), longest=5)


def test_long_words(spark):
    long = "ab" * 3_000
    words = spark.createDataFrame([(long, 50), (long[:2000] + "x" + long[2001:], 3), (long + "b", 4), (long[1:], 2)], "word string, n long")
    got = {(r["a"], r["b"]) for r in spelling.near_words(words).collect()}
    assert len(got) == 3
