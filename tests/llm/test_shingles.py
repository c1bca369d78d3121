"""Copies by word shingles against all pairs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from laggard.llm import shingles, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """Smallest id of each component of sets with Jaccard 0.8 or more."""
    sets, least = [plain_set(t) for _, t in rows], [i for i, _ in rows]
    near = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])]
    for _ in rows:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return sorted({*least})


def edited(words, rng, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def corpus():
    rng = random.Random(4)
    rows, line = [], " ".join(f"line{i}" for i in range(30))
    for n in (3, 7, 40, 100, 300):
        for _ in range(6):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            rows += [" ".join(words), " ".join(words).upper()]
            # About 0.9 to 0.7: both sides of the threshold.
            rows += [edited(words, rng, max(1, round(n * share))) for share in (0.01, 0.02, 0.022, 0.025, 0.03)]
    rows += [f"{line} {' '.join(str(rng.random()) for _ in range(20))}" for _ in range(40)]
    rows += [None, "", " "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("crowd, chunk, outsiders", [(16, 1000, 64), (1, 3, 0), (2, 1000, 3)])
def test_keeps_what_all_pairs_keep(spark, crowd, chunk, outsiders):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.deduplicated(docs, crowd, chunk, outsiders).collect()) == kept(rows)


def test_the_stage_drops_copies_beyond_four_bits(spark, small):
    """Planted copies of similarity 0.8 and more whose fingerprints are far apart."""
    rng = random.Random(5)
    words = [[f"w{rng.randrange(10**9)}" for _ in range(200)] for _ in range(10)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, edited(w, rng, 4)) for i, w in enumerate(words)]
    far = [(simhash.fingerprint(rows[i][1], 4) ^ simhash.fingerprint(rows[10 + i][1], 4)).bit_count() > 4 for i in range(10)]
    assert any(far)
    got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), small)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(10)) == kept(rows)


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(7, text), (3, text.upper()), (3, text), (None, text + " more"), (None, None), (9, ""), (10, "\n"), (11, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS set", "1 AS n", "2 AS id", "3 AS keys")
    assert sorted((r["doc_id"], r["set"]) for r in shingles.deduplicated(docs).collect()) == [(3, "x"), (9, "x"), (11, "x")]
    assert shingles.deduplicated(docs.limit(0)).count() == 0
    assert shingles.deduplicated(spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")).count() == 1


def test_a_prefix_takes_no_copy_of_the_common_shingles():
    common = np.arange(0, 4_000_000, 2, dtype=np.uint64)
    hashes = np.arange(1_000, dtype=np.uint64)
    tracemalloc.start()
    got = shingles.prefix(hashes, common)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << 20
    assert got.tolist() == [*range(1, 403, 2)]
    assert shingles.prefix(hashes, common[:0]).tolist() == [*range(201)]
    assert shingles.prefix(hashes[:3], common[5:]).tolist() == [0]


def test_pairs_verified_in_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK_SHINGLES", 1)
    monkeypatch.setattr(shingles, "BLOCKS", 3)
    rows = corpus()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.deduplicated(docs).collect()) == kept(rows)


def test_a_block_reads_its_own_pairs_only(spark):
    dealt = shingles._dealt(spark.range(1000).selectExpr("id AS a", "id + 1 AS b", "1 AS n_a", "1 AS n_b"))
    assert dealt.rows.count() == dealt.rows.distinct().count() == 1000
    plan = dealt.rows.filter("part % 4 = 1").drop("part")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "Filter (" not in plan


def test_stages_hand_python_bounded_batches(spark, small):
    """Long texts reach Python a few at a time, and a bound that the session has stays."""
    texts = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 5000) AS text", "'en' AS lang")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    most = lambda: texts.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
    spark.conf.unset(corpus_pipeline.BATCHES)
    try:
        assert most() > 8 << 20
        for stage in (corpus_pipeline.known_language, corpus_pipeline.one_of_each_group):
            spark.conf.unset(corpus_pipeline.BATCHES)
            stage(spark, texts.limit(3), small)
            assert most() < 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(corpus_pipeline.BATCHES, 1 << 16)
        corpus_pipeline.one_of_each_group(spark, texts.limit(3), small)
        assert spark.conf.get(corpus_pipeline.BATCHES) == str(1 << 16)
    finally:
        spark.conf.unset(corpus_pipeline.BATCHES)


def test_crowded_keys_give_way_to_rarer_ones(spark, monkeypatch):
    """A line that the sample does not show as common is no key of the many texts that hold it."""
    rng, most, real = random.Random(6), [], shingles.links
    line = " ".join(f"line{i}" for i in range(20))
    rows = [(i, f"{line} {' '.join(str(rng.random()) for _ in range(60))}") for i in range(60)]
    rows += [(100 + i, edited(t.split(), rng, 1)) for i, t in rows[:5]]

    def links(docs, sets, *args, **more):
        most.append(sets.selectExpr("explode(keys) AS key").groupBy("key").count().agg({"count": "max"}).first()[0])
        return real(docs, sets, *args, **more)

    monkeypatch.setattr(shingles, "links", links)
    monkeypatch.setattr(shingles, "common_shingles", lambda docs: np.zeros(0, np.uint64))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.deduplicated(docs).collect()) == kept(rows)
    assert most[0] <= shingles.CROWD


def test_outsiders_meet_only_whom_they_may_be_similar_to(spark, monkeypatch):
    """Forty texts edited from one, none similar to another: their shared keys say that no pair can be."""
    rng, met, real = random.Random(7), [], shingles._verified

    def verified(docs, sets, pairs):
        met.append(pairs.count())
        return real(docs, sets, pairs)

    monkeypatch.setattr(shingles, "_verified", verified)
    words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows = [(i, edited(words, rng, 9)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.deduplicated(docs).collect()) == kept(rows)
    assert met[1] < 100 < 40 * 39 // 2
