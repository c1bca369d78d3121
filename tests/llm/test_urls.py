"""URL parts, rules and the listed URLs."""

import pytest
from pyspark.sql import functions as F

from laggard.llm import urls
from laggard.llm.queries import URL_RULES


def test_parts_and_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://example.net", "example.net", "", None, "allow"),
        (3, "https://example.net/de/", "example.net", "/de/", "net/", "block"),
        (4, "x://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        (5, "x://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
        (6, "//net/", "", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "a://net/?://org/fr/", "net", "/", "net/", "block"),
        (9, "ÄB://É.ORG/fr/", "É.org", "/fr/", "org/fr/", "allow"),
        (10, "a://org?x", "org", "", None, "allow"),
        (10, "a://org?x", "org", "", None, "allow"),
        (11, "a://net/" + "x" * 200_000, "net", "/" + "x" * 200_000, "net/", "block"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("key", F.lit(1))
    listed = spark.createDataFrame([], "url string")
    got = urls.filter_urls(pages, listed, URL_RULES).select("page_id", "url", "host", "path", "rule", "verdict", "key").collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(rows, key=str)
    assert urls.filter_urls(pages.limit(0), listed, URL_RULES).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_listed_urls_are_blocked_and_no_others(spark, broadcast_bytes):
    listed = spark.range(3000).select(F.concat(F.lit("http://h.example/"), "id", F.lit("/?b=2&a=1&utm_source=z")).alias("url"))
    pages = spark.range(9000).select(F.col("id").alias("page_id"), F.concat(F.lit("HTTPS://H.example/"), "id", F.lit("?a=1&b=2#top")).alias("url"))
    hot = pages.limit(1).crossJoin(spark.range(500)).select("page_id", "url")
    got = urls.filter_urls(pages.union(hot), listed.union(spark.createDataFrame([(None,), ("no url",)], "url string")), broadcast_bytes=broadcast_bytes)
    assert {(r["v"], r["b"]): r["n"] for r in got.groupBy(F.col("verdict").alias("v"), (F.col("page_id") < 3000).alias("b")).agg(F.count("*").alias("n")).collect()} == {
        ("block", True): 3500, ("allow", False): 6000}


def test_few_false_hits(spark):
    canon = spark.range(5000).select(F.concat(F.lit("a/"), "id").alias("u"))
    table, blocks = urls.bloom_blocks(canon, "u")
    other = spark.range(5000, 25000).select(F.concat(F.lit("a/"), "id").alias("u"))
    hit = F.lit(True)
    for i, b in enumerate(urls._bits(F.col("u"))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(b) != 0)
    probe = lambda df: df.withColumn("_block", urls._block(F.col("u"), blocks)).join(table, "_block").filter(hit).count()
    assert probe(canon) == 5000 and probe(other) < 400
