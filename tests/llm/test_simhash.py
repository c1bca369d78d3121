"""SimHash links and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from laggard.llm import simhash
from laggard.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def components(fps, bits):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint():
    random.seed(1)
    texts = [None, "", " \t", "One", "one two three", "A b C d É e \x1c f\x85g", "word " * 5000]
    texts += [" ".join(random.choices("abcdefghij", k=n)) for n in (4, 5, 60, 200)]
    for t in texts:
        assert simhash.fingerprint(t, 4) == plain_fingerprint(t)


@pytest.mark.parametrize("crowd, chunk", [(200, 1000), (1, 4)])
def test_links_join_what_all_pairs_join(spark, crowd, chunk):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for n in (1, 2, 4, 4, 5):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps] + [0, 1, 3, -1]
    edges = simhash.links(spark.createDataFrame([(f,) for f in set(signed)], "fp long"), crowd=crowd, chunk=chunk)
    got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    want = components(set(signed), 4)
    groups = {}
    for f, root in want.items():
        groups.setdefault(root, set()).add(f)
    for members in groups.values():
        assert {got.get(f, f) for f in members} == {min(members)}


def test_pairs_are_found_once(spark):
    fps = [0, 1, 2, 3, 7, 15, 31, 1 << 40, (1 << 40) | 1]
    pairs = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    assert sorted(pairs) == sorted(want)


def test_odd_documents(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(7, text), (3, text.upper()), (3, text), (None, text), (None, None), (9, ""), (10, "\n"), (11, "other words here entirely now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert {c for (i, _), c in got.items() if i in (7, 3)} == {3} and got[(9, 0)] == got[(10, 0)] == got[(None, 0)] == 9
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(nulls).collect()] == [None, None]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, i) for i in range(6, 40)] + [(8, 8), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(101, 131)}, **{i: 5 for i in range(6, 40)}}


@pytest.mark.parametrize("few_crowded", [True, False])
def test_exploded_keys_are_never_broadcast(spark, monkeypatch, few_crowded):
    """Spark sizes 64 keys a fingerprint as one, so a table under its threshold would go through the driver 64 times over."""
    if not few_crowded:  # as with too many crowded keys to broadcast
        monkeypatch.setattr(simhash, "broadcast_if_small", lambda df: df)
    fps = simhash.stage(spark.range(1000).selectExpr("xxhash64(id) AS fp"))
    depth, under, sent = lambda line: len(re.match(r"[ :+\-]*", line)[0]), None, []
    for line in simhash.links(fps)._jdf.queryExecution().executedPlan().toString().splitlines():
        under = None if under is not None and depth(line) <= under else under
        if "BroadcastExchange" in line:
            under = depth(line)
        elif under is not None:
            sent.append(line)
    assert not [line for line in sent if "Generate" in line] and bool(sent) == few_crowded
