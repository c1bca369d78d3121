"""Vector codes against a plain nearest-entry search; the query against SQL is in test_llm_queries."""

import hashlib

import numpy as np
import pytest

from laggard.llm import vectors


def plain(x, parts, entries, rounds):
    cut = vectors.cut(x, parts)
    books = [p[:entries].copy() for p in cut]
    for r in range(rounds + 1):
        d = [((p[:, None] - b[None]) ** 2).sum(2) for p, b in zip(cut, books)]
        own = [m.argmin(1) for m in d]
        if r < rounds:
            for p, b, w in zip(cut, books, own):
                for e in np.unique(w):
                    b[e] = p[w == e].sum(0) // (w == e).sum()
    return np.stack(own, 1), sum(m.min(1) for m in d), books


@pytest.mark.parametrize("d, spread", [(1, 3), (2, 2), (4, 50), (16, 1000), (5, 1), (3, 1 << 24)])
def test_search_is_exact_with_ties(d, spread):
    rng = np.random.default_rng(d)
    x, entries = rng.integers(-spread, spread + 1, (800, d)), rng.integers(-spread, spread + 1, (60, d))
    entries[30:40] = entries[:10]
    where, best = vectors.nearest(x, entries)
    full = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (where == full.argmin(1)).all() and (best == full.min(1)).all()


def rows(spark, data, extra=True):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    return df.selectExpr("*", "1 AS scaled", "2 AS length", "3 AS code", "4 AS same") if extra else df


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((300, 10)) * 20).astype(np.int64)
    x[50:90] = x[:40]
    data = [(1000 + i, [float(c) / 1024 for c in v], int(i % 3) if i % 7 else None) for i, v in enumerate(x)]
    got = sorted(vectors.encode(rows(spark, data[::-1]).repartition(5), parts=4, entries=16, rounds=4).collect(), key=lambda r: r["vec_id"])
    codes, error, books = plain(x, 4, 16, 4)
    assert [r["code"] for r in got] == ["".join(f"{c:02x}" for c in row) for row in codes] and [r["error"] for r in got] == error.tolist()
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(vectors.codebook_text(books).encode()).hexdigest()}
    for r in got:
        assert r["label_error"] == sum(g["error"] for g in got if g["label"] == r["label"])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [], 1), (None, [1.0, 2.0, 3.0, 4.0], None), (7, [1.0, 2.0, 3.0, 4.0], None),
            (7, [1.0, 2.0, 3.0, 4.0], 2), (8, [-0.0001, 1e300, -1e300, 0.0], 2), (9, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], 2)]
    got = vectors.encode(rows(spark, data)).collect()
    by = {(r["vec_id"], r["label"]): r for r in got}
    assert len(got) == 6 and by[(5, 1)]["error"] == 0 and by[(9, 2)]["error"] == 0
    assert by[(None, None)]["code"] == by[(7, None)]["code"] == by[(7, 2)]["code"] == "00000000"
    assert by[(8, 2)]["error"] == 0 and by[(None, None)]["label_error"] == 0
    assert len({r["codebooks_sha256"] for r in got}) == 3
    assert vectors.encode(rows(spark, data).limit(0)).count() == 0
    with pytest.raises(ValueError):
        vectors.encode(rows(spark, data), entries=257)
