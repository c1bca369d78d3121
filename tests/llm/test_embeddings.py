"""Embedding links against all pairs."""

import numpy as np
import pytest

from laggard.llm import embeddings as E


def truth(ids, vectors, threshold):
    v = E.unit(vectors)
    near = v @ v.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(v)).min(1))
        if (new == label).all():
            break
        label = new
    least = {c: min(i for i, x in zip(ids, label) if x == c) for c in set(label)}
    return {i: (int(n), least[c]) for i, n, c in zip(ids, near.sum(1), label)}


@pytest.mark.parametrize("chunk", [1_024, 16])
def test_recall_and_exact_counts(spark, chunk):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((700, 16))
    near = np.repeat(base[:30], 6, axis=0) + 0.12 * rng.standard_normal((180, 16))
    hub = base[0] + 0.05 * rng.standard_normal((120, 16))
    v = np.concatenate([base, near, hub, base[:20], 3 * base[20:25]]).astype(np.float32)
    ids = [int(i) for i in rng.permutation(len(v))]
    df = spark.createDataFrame(list(zip(ids, v.tolist())), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_vectors(df, 0.95, chunk=chunk).collect()}
    want = truth(ids, v.astype(np.float64), 0.95)
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in ids]) > 0.97
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (2, [1.0, 0.0]), (11, [1e300, 1e300]), (12, [1e-300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS cid")
    got = sorted((tuple(r) for r in E.near_vectors(df).collect()), key=str)
    by_id = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert by_id[1] == (3, 1, True) and by_id[2] == (3, 1, False) and by_id[None] == (3, 1, False)
    assert all(by_id[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)) and by_id[11] == (1, 11, True) and by_id[12] == (1, 11, False)
    assert E.near_vectors(df.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in E.near_vectors(df.filter("vec_id = 3")).collect()] == [(0, 3, True)]


def test_cells_come_nearest_first():
    rng = np.random.default_rng(1)
    sample = E.unit(rng.standard_normal((600, 8)))
    index = E.fit_index(sample, 40_000, 0.95)
    x = sample[:20]
    cells = E.visited(x, index)
    sums = (E._squared(x[:, :4], index.first)[:, :, None] + E._squared(x[:, 4:], index.second)[:, None, :]).reshape(20, -1)
    for row, order in zip(sums, cells):
        assert np.allclose(row[order], np.sort(row)[: index.visits])


@pytest.mark.parametrize("lengths", [E.LENGTHS, 1])
def test_lengths_have_indexes_of_their_own(spark, monkeypatch, lengths):
    monkeypatch.setattr(E, "LENGTHS", lengths)
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for first, (dim, n) in zip((0, 1_000, 2_000, 3_000), ((12, 300), (8, 120), (3, 40), (1, 5))):
        v = rng.standard_normal((n, dim))
        v[n // 2 :] = v[: n - n // 2] + 0.02 * rng.standard_normal((n - n // 2, dim))
        ids = list(range(first, first + n))
        rows += list(zip(ids, v.tolist()))
        want |= truth(ids, v, 0.95)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df, 0.95).collect()}
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert all(got[i] == want[i] for i in want if i >= 2_000)
