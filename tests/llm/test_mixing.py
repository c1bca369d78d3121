"""Mixing sources: targets, positions and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from laggard.llm import mixing

FIELDS = "doc_id long, source string, text string"


def test_targets_stop_at_three_sizes():
    assert mixing.capped_targets([5, 2, 1], [10, 100, 100], 210) == [30.0, 120.0, 60.0]
    assert mixing.capped_targets([1, 1], [0, 10], 10) == [0.0, 10.0]
    assert mixing.capped_targets([0, 0], [5, 5], 10) == [0.0, 0.0]
    random.seed(1)
    for _ in range(50):
        sizes = [random.choice([0, 1, 7, 1000]) for _ in range(6)]
        targets = mixing.capped_targets([5, 2, 1, 5, 2, 1], sizes, sum(sizes))
        assert sum(targets) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(targets, sizes))


def test_words_and_positions_follow_a_changing_schedule(spark):
    rows = [(i, "ab"[i % 2], "w " * (1 + i % 7)) for i in range(600)]
    schedule = lambda sources: {"a": [(0, 1.0), (1, 0.0)], "b": [(0, 0.0), (1, 1.0)]}
    mixed = mixing.mix_sources(spark.createDataFrame(rows, FIELDS), schedule, bucket_docs=50).cache()
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 1
    uses = mixing.training_order(mixed).collect()
    assert [u["position"] for u in uses] == sorted(u["position"] for u in uses)
    # By progress t source a wants the integral of 1 - t: t - t * t / 2 of all words.
    total = sum(u["words"] for u in uses)
    for t in (0.25, 0.5, 0.9):
        a = sum(u["words"] for u in uses if u["source"] == "a" and u["position"] < t)
        assert a / total == pytest.approx(t - t * t / 2, abs=0.02)
    assert mixed.filter("taken > 3 * size").count() == 0


def test_reruns_agree_and_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "w " * (i % 9)) for i in range(300)], FIELDS)
    take = lambda df: sorted(map(tuple, mixing.mix_sources(df, mixing.constant_weights(5, 2, 1)).select("doc_id", "taken", "position").collect()), key=str)
    assert take(docs) == take(docs.repartition(7))


def test_odd_rows(spark):
    rows = [(1, None, "a b"), (None, "x", "a"), (2, "x", None), (2, "x", None), (3, "x", ""), (4, "y", "q " * 5000), (4, "y", "q " * 5000)]
    docs = spark.createDataFrame(rows, FIELDS).withColumn("taken", F.lit("clash")).withColumn("more", F.lit(1))
    got = mixing.mix_sources(docs, mixing.constant_weights(1)).collect()
    assert len(got) == 7 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert sum(r["taken"] for r in got) == pytest.approx(10003, abs=3)
    assert mixing.mix_sources(docs.limit(0), mixing.constant_weights(1)).count() == 0
    assert mixing.mix_sources(docs.filter("size(split(text, '')) = 0"), mixing.constant_weights(1)).count() == 0


def test_too_many_sources_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, source string, size long")
    with pytest.raises(ValueError):
        mixing.source_table(docs, mixing.constant_weights(1), max_sources=1)
