"""URL filters: host rules, and a blocked Bloom filter before an exact hash join.

Everything is a DataFrame expression.  The list of blocked URLs becomes a table
of 512-bit blocks (eight 64-bit words, one bit set in each by every listed URL).
A page looks into one block; only pages whose eight bits are all set, the
possible hits, carry a key into the exact join on the canonical URL, which
removes the false positives.  The filter is broadcast when its size, known from
the number of listed URLs, is within ``BROADCAST_BYTES``; a larger one is joined
on the block number.

Null or malformed URLs (no ``://``) have an empty host and path, fit no rule and
are never listed.  Repeated rows are judged alike.  An empty list blocks nothing.
Extra columns are kept, unless their names clash with those added here: then the
added column wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .text import lower_ascii

WORDS = 8
BITS_PER_URL = 16
BROADCAST_BYTES = 32 << 20
# Query parameters that do not change the page.
TRACKING = r"(?s)^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty when there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host, path without closing slashes, and the sorted query without tracking parameters."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    path = F.regexp_replace(url_path(url), r"/+\z", "")
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(url_host(url) != "", F.concat(url_host(url), path, tail))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null fields when none does."""
    found = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = found.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """One bit for each word of the block, from 48 bits of a second hash."""
    second = F.xxhash64(F.lit("bits"), url)
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(63).cast("int"))
        for i in range(WORDS)
    ]


def bloom_blocks(listed: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The filter as one row per used block, and the number of blocks."""
    blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS)))
    key = F.col(column)
    words = [F.bit_or(b).alias(f"_w{i}") for i, b in enumerate(_bits(key))]
    return listed.groupBy(_block(key, blocks).alias("_block")).agg(*words), blocks


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url: str = "url",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add host, path, rule and verdict (``allow`` or ``block``) to every page.

    ``listed`` has a column ``url`` of URLs to block.  A fitting rule decides
    before the list does.
    """
    canon = listed.select(canonical_url(F.col("url")).alias("_listed")).filter("_listed IS NOT NULL").distinct()
    table, blocks = bloom_blocks(canon, "_listed")
    if blocks * 8 * (WORDS + 1) <= broadcast_bytes:
        table = F.broadcast(table)
    # The row travels as one column, so that no name of its own meets those used here.
    own_columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages, u = pages.select(F.struct(*own_columns).alias("_row")), F.col("_row").getField(url)
    pages = pages.withColumns(
        {"host": F.coalesce(url_host(u), F.lit("")), "path": F.coalesce(url_path(u), F.lit("")), "_canon": canonical_url(u)}
    )
    pages = pages.withColumns({"_rule": matching_rule(F.col("host"), F.col("path"), rules), "_block": _block(F.col("_canon"), blocks)})
    probed = pages.join(table, "_block", "left")
    maybe = F.col("_w0").isNotNull() & F.col("_canon").isNotNull()
    for i, bit in enumerate(_bits(F.col("_canon"))):
        maybe = maybe & (F.col(f"_w{i}").bitwiseAND(bit) != 0)
    # Pages that cannot be listed get a key of their own that equals no URL, so that they spread over all tasks.
    spread = F.concat(F.lit("\0"), F.xxhash64(F.monotonically_increasing_id()).cast("string"))
    probed = probed.withColumn("_maybe", maybe).withColumn("_key", F.when(F.col("_maybe"), F.col("_canon")).otherwise(spread))
    exact = (F.col("_key") == F.col("_listed")) & F.col("_maybe")
    hits = probed.join(canon.hint("shuffle_hash"), exact, "left")
    own = F.when(F.col("_listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return hits.select("_row.*", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"))
