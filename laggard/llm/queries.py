"""Named queries of the operators, with SQL counterparts where SQL can say the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, embeddings, langid, licenses, mixing, pii, simhash, spelling, substrings, toxicity, urls, vectors, warc
from .text import crc_remainder, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ------------------------------------------------------- 1: mixing of sources

WEIGHTS = (5.0, 2.0, 1.0)


@query()
def op1_mix_sources(spark, folder):
    """How many words a mix with weights 5, 2, 1 takes of every document, in training order."""
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(docs, mixing.constant_weights(*WEIGHTS))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


# ---------------------------------------------------------------- 2: archives


@query("""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((b0 * 256 + b1) >> (11 - (i * 5) % 8) & 31)::INTEGER + 1, 1), '' ORDER BY i)
   FROM (SELECT i, ('0x' || substr(sha1(html), (i * 5 // 8)::INTEGER * 2 + 1, 2))::INTEGER AS b0,
                CASE WHEN i * 5 // 8 < 19
                     THEN ('0x' || substr(sha1(html), (i * 5 // 8)::INTEGER * 2 + 3, 2))::INTEGER ELSE 0 END AS b1
         FROM range(32) r(i))) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
""")
def op2_warc_round_trip(spark, folder):
    """Every page written as a WARC record and read back."""
    back = warc.round_trip(table(spark, folder, "pages"))
    ids = {c: F.col(c).cast("long") for c in ("page_id", "refers_to")}
    return back.withColumns(ids).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# -------------------------------------------------------------- 7: URL filters

URL_RULES = (
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
)
# Host labels that put a page's URL on the list.
LISTED_LABELS = ("adult-x", "ads-track")
_LABELS = "|".join(LISTED_LABELS)


@query(rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (
  SELECT page_id, host, path, host || regexp_replace(path, '/+$', '') || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
           string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))), '&'), ''), '') AS canon FROM h),
listed AS (SELECT DISTINCT canon FROM c WHERE host <> '' AND regexp_matches(host, '(^|\.)({_LABELS})\.')),
r AS (
  SELECT c.*, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM c)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN listed ON host <> '' AND r.canon = listed.canon
""")
def op7_url_filter(spark, folder):
    """Host, path, fitting rule and verdict of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    listed = pages.filter(urls.url_host(F.col("url")).rlike(rf"(^|\.)({_LABELS})\."))
    judged = urls.filter_urls(pages, listed, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# ------------------------------------------------------------------ 3: SimHash


@query()
def op3_simhash(spark, folder):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


# ------------------------------------------------- 6: embedding near-duplicates


@query()
def op6_embedding_dedup(spark, folder):
    """Links and component of every vector at cosine 0.95."""
    return embeddings.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"), threshold=0.95)


# ------------------------------------------------------ 9: substring dedup


@query()
def op9_substring_dedup(spark, folder):
    """Words of every document that a window of 13 words repeats from an earlier one."""
    return substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), window=13, texts=False)


# ------------------------------------------------ 4: benchmark decontamination


@query()
def op4_decontamination(spark, folder):
    """Every test item found in a document, with at most 10% of its characters edited."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, folder, "benchmark"))


# ------------------------------------------------------------- 8: language ID

LANG_FOLDS = 5


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the labelled documents outside the held-out fold."""
    known = docs.select("doc_id", "text", "lang").filter(crc_remainder(F.col("doc_id"), LANG_FOLDS) != 0)
    return langid.train(langid.training_windows(known))


@query()
def op8_language_id(spark, folder):
    """Predicted language of every document."""
    docs = table(spark, folder, "documents")
    found = langid.language(F.col("text"), language_model(docs))
    rows = docs.select("doc_id", (crc_remainder(F.col("doc_id"), LANG_FOLDS) == 0).alias("held_out"), found.alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


# ---------------------------------------------------------------- 5: toxicity

TOXIC_FOLDS, TOXIC_HELD_OUT, TOXIC_CUT = 4, 2, 0.3


@query()
def op5_toxicity(spark, folder):
    """Toxicity score of every document."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    fold = crc_remainder(F.col("doc_id"), TOXIC_FOLDS)
    known = labels.select("doc_id", "toxic").filter(fold != TOXIC_HELD_OUT)
    model = toxicity.train(*toxicity.labelled_texts(docs, known))
    rows = docs.select("doc_id", (fold == TOXIC_HELD_OUT).alias("held_out"), toxicity.toxicity(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= TOXIC_CUT).cast("int"))


# -------------------------------------------------------------------- 10: PII


@query()
def op10_pii(spark, folder):
    """Identifiers and revealing terms in every document."""
    found = pii.find_spans(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.span_list(*pii.KINDS), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.span_list(*pii.KINDS, "term").alias("spans"))


# --------------------------------------------------------- 11: licence scans


@query()
def op11_license_scan(spark, folder):
    """Licence notices and tags of every document."""
    docs = table(spark, folder, "documents").select("doc_id", licenses.licenses(F.col("text")).alias("found"))
    base = F.filter("found.places", lambda p: p["base"])
    of = lambda field: F.transform(base, lambda p: p[field])
    return docs.select(
        "doc_id", F.col("found.n_words").alias("n_words"),
        F.aggregate(of("n"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_base"),
        F.array_min(of("first_word")).alias("first_word"), F.array_max(of("last_word")).alias("last_word"),
        licenses.label_list(F.col("found.places"), True).alias("base_labels"),
        licenses.label_list(F.col("found.places"), False).alias("labels"), F.col("found.score").alias("score"),
    )


# ------------------------------------------------ 12: vector code compression


def _code_rounds(rounds: int) -> str:
    """SQL of the codebooks after each round, and of the last assignment ``a{rounds}``."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM x JOIN b{r} b USING (p))
  GROUP BY vec_id, p)""")
        if r < rounds:
            out.append(f"""
b{r + 1} AS (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS v FROM (
      SELECT p, e, i, floor(sum(x.v[i])::DOUBLE / count(*))::BIGINT AS c
      FROM a{r} JOIN x USING (vec_id, p), range(1, 1000) r(i) WHERE i <= len(x.v) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    return ",".join(out)


@query(f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v, len(embedding) // 4 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
x AS (SELECT vec_id, p, v[p * w + 1 : p * w + w] AS v FROM k, range(4) r(p)),
b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v
  FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{_code_rounds(4)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN k USING (vec_id), h
""")
def op12_vector_codes(spark, folder):
    """Product code and error of every vector."""
    coded = vectors.encode(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


# ------------------------------------------------ 13: spelling variants


@query("""
WITH RECURSIVE t AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c::BIGINT ORDER BY i) AS tab FROM t WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS m FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run
    FROM documents) GROUP BY doc_id, run),
hashed AS (
  SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hx) // 2 + 1), lambda i: ('0x' || hx[2 * i - 1 : 2 * i])::BIGINT)),
           lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295::BIGINT) AS h
  FROM (SELECT run, m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs), crc),
w AS (
  SELECT word, sum(m)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, m FROM hashed)
  GROUP BY word HAVING length(word) >= 7 AND sum(m) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word)::BIGINT + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN w b ON a.rest = b.word),
near AS (SELECT a, count(*) AS n_near, max(n_b) AS top FROM pairs GROUP BY a),
best AS (SELECT p.a, min(p.b) AS form FROM pairs p JOIN near USING (a) WHERE p.n_b = top AND top >= 10 * p.n_a GROUP BY p.a),
chain AS (SELECT a AS word, form AS root, 1 AS k FROM best UNION ALL SELECT c.word, b.form, k + 1 FROM chain c JOIN best b ON c.root = b.a),
ends AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form IS NOT NULL THEN top END AS form_n
FROM w LEFT JOIN near ON near.a = w.word LEFT JOIN best ON best.a = w.word LEFT JOIN ends ON ends.word = w.word
""")
def op13_spelling_variants(spark, folder):
    """Near words, form and root of every word of seven letters or more."""
    return spelling.spelling_forms(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def pipeline(spark, folder):
    """All stages of ``corpus_pipeline`` over the documents."""
    import corpus_pipeline  # imports the operators, so not before them

    return corpus_pipeline.run(spark, folder)
