"""Language identification: gradients, held-out accuracy, odd texts."""

import numpy as np
from pyspark.sql import functions as F

from laggard.llm import langid, queries


def test_gradients_are_those_of_the_loss():
    w = {k: v.astype(np.float64) for k, v in langid.start_weights(3, 4, 1).items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 123, (9, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, g = langid.gradients(w, x, y)
    for k in w:
        at = (1, x[4, 2]) if k.endswith("byte") else tuple(rng.integers(0, n) for n in w[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert abs((langid.gradients(up, x, y)[0] - langid.gradients(down, x, y)[0]) / 2e-3 - g[k][at]) < 2e-5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op8_language_id"](spark, folder).join(queries.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] and right[2] <= 1


def test_odd_texts(spark):
    model = langid.train([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")], steps=40)
    rows = [(1, None), (2, ""), (3, "12 %%"), (4, "the dog"), (4, "the dog"), (5, "und die katze " * 20_000), (None, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("clash"))
    got = [(r["doc_id"], r["f"]["lang"], r["f"]["score"]) for r in docs.select("doc_id", langid.language(F.col("text"), model).alias("f")).collect()]
    assert got[:3] == [(i, "und", 0.0) for i in (1, 2, 3)] and got[3] == got[4] and got[3][1] == "en" and got[5][1] == "de"
    assert got[6][1] in ("en", "de") and all(0 <= s <= 1 for *_, s in got)
    nothing = langid.train(langid.training_windows(docs.limit(0)))
    assert docs.limit(0).select(langid.language(F.col("text"), model)).count() == 0
    assert {r[0]["lang"] for r in docs.select(langid.language(F.col("text"), nothing)).collect()} == {"und"}


def test_every_letter_gets_a_label():
    model = langid.train([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")], steps=60)
    runs = langid.byte_labels(model, "the cat and the dog " * 10 + "der hund und die katze " * 10)
    assert runs[0][2] == "en" and runs[-1][2] == "de" and langid.byte_labels(model, "") == []
    assert sum(e - s for s, e, lang in runs if s < 150) >= 100


def test_the_sample_is_bounded_and_covers_rare_languages(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"), F.when(F.col("id") < 5, "xx").otherwise("en").alias("lang"))
    langs = [lang for _, lang in langid.training_windows(docs, per_lang=50)]
    assert langs.count("xx") == 5 and 30 <= langs.count("en") <= 50
