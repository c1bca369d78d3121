"""Removed words against a plain search for earlier windows."""

import hashlib
import random

import numpy as np
import pytest

from laggard.llm import substrings as S


def plain(rows, n):
    first = {}
    words = [(text or "").encode().split() for _, text in rows]
    key = lambda i: float("inf") if i is None else i
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(first.get(k, float("inf")), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < key(i):
                gone[p : p + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda k: " ".join(rng.choices(vocabulary, k=k))
    shared = [some(k) for k in (13, 14, 12, 30, 80, 200)]
    rows = []
    for i in range(60):
        parts = [some(rng.randint(0, 40)), rng.choice(shared), some(rng.randint(0, 9)), rng.choice(shared)]
        rows.append((rng.randint(0, 55), rng.choice([" ", "\n", "\t  "]).join(parts)))
    rows += [(70, rows[3][1]), (70, rows[3][1]), (71, rows[4][1].replace("w1", "W1")), (None, rows[5][1]), (None, some(50)), (80, None), (81, ""), (82, some(12)),
             (83, " ".join(shared) + " é\x1c\x85" + some(3000)), (84, (shared[3] + " ") * 40)]
    return rows


@pytest.mark.parametrize("window, seed", [(13, 1), (13, 2), (30, 3), (5, 4)])
def test_against_plain_search(spark, window, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "'x' AS h")
    got = S.remove_repeats(df, window).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"]) == sorted(x[:4] for x in plain(rows, window) if x[0])
    assert sorted((tuple(r)[1:4] for r in got), key=str) == sorted((x[1:4] for x in plain(rows, window)), key=str)
    by = {(x[0], x[3]): x[4] for x in plain(rows, window)}
    assert all(r["kept_text"] == by[r["doc_id"], r["kept_sha256"]] for r in got if r["kept_text"] is not None)


def test_empty_table_and_no_repeats(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, " ".join(map(str, range(40))))], "doc_id long, text string")
    assert S.remove_repeats(df.limit(0)).count() == 0
    assert [r["n_removed"] for r in S.remove_repeats(df, texts=False).collect()] == [0, 0]


def test_ladders_double_at_most():
    for n in range(1, 200):
        ladder = S.ladder(n)
        assert ladder[-1] == n and len(ladder) > 1 and all(a <= b <= 2 * a for a, b in zip(ladder, ladder[1:]))


def test_word_hashes_follow_the_words():
    data = "  the cat\tthe  dog\x1cdog ünïcode the\n".encode()
    words, hashes = data.split(), S.word_hashes(data)
    assert len(words) == len(hashes) and all((a == b) == (x == y) for a, x in zip(words, hashes) for b, y in zip(words, hashes))
    assert len(S.word_hashes(b"")) == len(S.word_hashes(b" \n")) == 0
    runs = S.window_hashes(hashes, 2)
    assert len(runs) == len(words) - 1 and len(S.window_hashes(hashes, 99)) == 0
    assert (S.chosen(runs, 3) == [min(runs[i : i + 3]) for i in range(len(runs) - 2)]).all() and S.chosen(np.zeros(1, np.uint64), 3).size == 0
