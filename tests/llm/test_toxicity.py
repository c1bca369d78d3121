"""Toxicity: held-out accuracy, misspellings, odd texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from laggard.llm import queries, toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = queries.table(spark, folder, "labels").filter("toxic IS NOT NULL")
    got = queries.QUERIES["op5_toxicity"](spark, folder).join(labels, "doc_id").filter("held_out").select("score", "toxic").toPandas()
    s, y = got["score"].to_numpy(), got["toxic"].to_numpy() == 1
    ranks = np.argsort(np.argsort(s))
    area = (ranks[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    # About one toxic label in eight stands on a text without any toxic word here.
    assert area > 0.95 and (s[y] >= 0.3).mean() > 0.85 and (s[~y] >= 0.3).mean() < 0.1


def test_misspellings_share_subwords():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 8))) for _ in range(200)]
    clean = [" ".join(rng.choices(words, k=60)) for _ in range(200)]
    toxic = [t + " what a worthless " + " ".join(rng.choices(words, k=20)) for t in clean[:100]]
    model = toxicity.train(toxic + clean[100:], [1] * 100 + [0] * 100)
    got = toxicity.scores(model, ["you are worthlesss", "WORTHLES!", clean[3], "", None])
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] < 0.3 and got[3] == got[4] and ((0 <= got) & (got <= 1)).all()


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = toxicity.train(["bad bad word"] * 8 + ["good fine text"] * 8, [1] * 8 + [0] * 8)
    got = [r[0] for r in docs.select(toxicity.toxicity(F.col("text"), model)).collect()]
    assert len(got) == 5 and got[0] == got[1] and got[2] == got[3] and all(0 <= g <= 1 for g in got)
    assert docs.limit(0).select(toxicity.toxicity(F.col("text"), model)).count() == 0
    one_class = toxicity.train(["a text"], [0])
    assert {r[0] for r in docs.select(toxicity.toxicity(F.col("text"), one_class)).collect()} == {0.0}
    labels = spark.createDataFrame([(3, 1), (None, 1), (1, None), (2, 0), (3, 1)], "doc_id long, toxic int")
    texts, marks = toxicity.labelled_texts(docs, labels)
    assert sorted(zip(texts, marks)) == [("", 0), ("x", 1), ("x", 1)]


def test_long_and_repeated_labelled_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(3, 8))) for _ in range(300)]
    text = lambda bad: " ".join(rng.choices(words, k=500) + ["what a worthless idiot"] * bad + rng.choices(words, k=500))
    rows = [(i, text(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert min(len(t) for _, t in rows) > toxicity.LONGEST
    texts, marks = toxicity.labelled_texts(docs, labels)
    assert sorted(texts) == sorted(t for _, t in rows) and sum(marks) == 20
    got = toxicity.scores(toxicity.train(texts, marks), ["a worthless idiot", "".join(rows[1][1])])
    assert got[0] > 0.5 > got[1]
    # One id holds nearly all rows: no more than the wanted number comes to the driver.
    hot = docs.union(spark.range(5_000).selectExpr("59L", "concat('row ', id)"))
    texts, marks = toxicity.labelled_texts(hot, labels.filter("doc_id IN (57, 59)"), per_class=5)
    assert len(texts) == 15 and toxicity.labelled_texts(docs, labels.limit(0)) == ([], [])


def test_room_of_long_texts():
    total = toxicity.CHARACTERS
    assert toxicity._room([]) == toxicity._room([3]) == toxicity.LONGEST
    assert toxicity._room([10, 50_000]) == 50_000
    assert toxicity._room([total, total, 0]) == total // 2
    assert toxicity._room([9_000] * 2_400) == toxicity.LONGEST
