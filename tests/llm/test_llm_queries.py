"""The registered queries, the pipeline, and its stages."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import check_queries
import corpus_pipeline
from laggard.llm import decontaminate, langid, queries
from laggard.llm.tables import Table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, name):
    note, ok, _ = check_queries.compare(spark, check_queries.connect(small), small, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name, columns", [
    ("op1_mix_sources", {"doc_id", "size", "source_size", "target", "taken"}), ("op4_decontamination", {"doc_id", "item_id"}),
    ("op10_pii", {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}),
])
def test_queries_run(spark, small, name, columns):
    got = queries.QUERIES[name](spark, small)
    assert columns <= set(got.columns) and got.count() > 0


def test_pipeline_against_plain_python(spark, small):
    """All stages again, one document at a time, in plain Python."""
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM read_parquet('{small}/documents.parquet')").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{small}/benchmark.parquet')").fetchall()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(langid.training_windows(docs.select("doc_id", "text", "lang")))
    scores = langid.pooled(model, [r[1] for r in rows]).max(1)
    rows = [r for r, s in zip(rows, scores) if re.search(r"[^\W\d_]", r[1] or "") and s >= corpus_pipeline.LEAST_SCORE]
    sets = [word_shingles(r[1]) for r in rows]
    holders = {}
    for i, one in enumerate(sets):
        for shingle in one:
            holders.setdefault(shingle, []).append(i)
    least = [r[0] for r in rows]
    linked = [[j for j, c in Counter(j for x in one for j in holders[x]).items() if 9 * c >= 4 * (len(one) + len(sets[j]))] for one in sets]
    empty = [i for i, one in enumerate(sets) if not one]
    linked = [empty if not one else near for one, near in zip(sets, linked)]
    while True:
        new = [min(least[j] for j in near) for near in linked]
        if new == least:
            break
        least = new
    rows = [r for r, c in zip(rows, least) if r[0] == c]
    patterns = [decontaminate.normalised(t) for _, t in items]
    leaks = lambda t: any(decontaminate.best_end(p, t, int(0.1 * len(p))) for p in patterns)
    rows = [r for r in rows if not leaks(decontaminate.normalised(r[1]))]
    # The kept documents, stage by stage.
    kept = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = Table(stage(spark, kept, small)).rows
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in rows)
    got = corpus_pipeline.run(spark, small).collect()
    size, words, taken = {r["doc_id"]: r["size"] for r in got}, Counter(), Counter()
    for r in got:
        words[r["doc_id"]] += r["words"]
        taken[r["source"]] += r["words"]
    original = {r[0]: r[1] for r in rows}
    assert set(words) <= set(original) and all(words[i] <= 3 * size[i] for i in words)
    target = {r["source"]: r["target"] for r in got}
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    texts = {r["doc_id"]: r["text"] for r in got}
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in texts.values())
    assert all(t == original[i] for i, t in texts.items() if not re.search("[@0-9]", original[i]))
    assert all(size[i] == len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items())


def word_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_stages_keep_columns_and_odd_rows(spark, small):
    long = "plain words of a very long text " * 3000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", None), (3, long, "en", "a", None), (None, "some text without id", "en", None, 5),
            (4, "other text written here by x@y.zz", "de", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS size", "'e' AS email", "'k' AS key", "2 AS row", "3 AS fp", "'p' AS position", "'t' AS term")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.count() <= 6 and stage(spark, docs.limit(0), small).count() == 0, name
    personal = corpus_pipeline.without_personal_data(spark, docs, small).filter("doc_id = 4").first()
    assert personal["text"] == "other text written here by <EMAIL>" and personal["n_chars"] == len(personal["text"]) and personal["email"] == "e"
    last = corpus_pipeline.mixed(spark, docs, small)
    assert len(set(last.columns)) == len(last.columns) and "mix_size" in last.columns and last.count() > 0 and corpus_pipeline.mixed(spark, docs.limit(0), small).count() == 0


CLASHES = """size source_size target taken uses position epoch words times share reach n_docs _source _bucket _off _os _ob _h _start row found own name set id uid
 key keys n a b doc tag h g email ip card phone term _terms _key _same _block _w0 _listed _rule _maybe _canon host path rule verdict _set _first _keep _found
 text_key entities copies clean scaled length code error same label_error fp root component first m lang_pred score""".split()


def with_clashes(df, but=()):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in df.columns and c not in but])


def test_stages_with_clashing_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clashing = Table(with_clashes(docs)).rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, small), stage(spark, clashing, small)
        assert got.columns == clashing.columns, name
        assert sorted(map(tuple, got.select(docs.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str), name
        assert got.filter(" OR ".join(f"`{c}` <> 'own {c}'" for c in CLASHES if c not in docs.columns)).isEmpty(), name
    plain, got = corpus_pipeline.mixed(spark, docs, small), corpus_pipeline.mixed(spark, clashing, small)
    assert set(clashing.columns) | {"mix_size", "mix_words"} <= set(got.columns)
    assert sorted(map(tuple, got.select("doc_id", "mix_epoch", "mix_words").collect())) == sorted(map(tuple, plain.select("doc_id", "epoch", "words").collect()))


def test_pipeline_is_declared():
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixing"]
