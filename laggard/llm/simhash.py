"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link at up to four differing bits.  Cut into three
segments, two linked fingerprints have a segment that differs in at most one
bit (four bits over three segments).  Every fingerprint is indexed under 64
keys: each segment with each one of its bits made a wildcard.  Fingerprints with
a common key are candidates; the equality join verifies them by the number of
differing bits and keeps a pair at one of its common keys only.

Exact copies collapse first: the join sees distinct fingerprints.  A key shared
by more than ``CROWD`` fingerprints is not joined: its members are cut into
chunks, every pair of chunks is compared in one bounded group, and what comes
out are not pairs but links of a spanning forest, enough for the components.

Null and empty texts have no words and fingerprint zero.  Repeated rows share
their fingerprint and component.  Null ids are never the smallest id; a
component of null ids only has a null id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import broadcast_if_small, stage
from .components import connected_components

BITS = 64
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
MAX_BITS = 4  # one more would leave two differing bits in each of three segments
CROWD = 200
CHUNK = 1_000
_SLICE = 1 << 16  # shingles counted at once


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of all word shingles, repeats included, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[:-1] + 1).tolist()]
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(last), _SLICE):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + _SLICE], last[at : at + _SLICE])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(last), bitorder="little").view("<u8")[0])


def simhash(text: Column, shingle: int = 4) -> Column:
    """Fingerprint of a text as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return of(text)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _variants(fp: Column) -> Column:
    """The 64 keys: 22 bits of segment with one bit cleared, and above them the number of that bit."""
    keys = []
    for low, width in SEGMENTS:
        part = F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1).cast("int")
        keys += [part.bitwiseAND(((1 << width) - 1) & ~(1 << i)).bitwiseOR((low + i) << 22) for i in range(width)]
    return F.array(*keys)


def _at_first_key(key: Column, x: Column) -> Column:
    """Whether ``key`` is the first one that fingerprints with the differing bits ``x`` share."""
    bit = F.shiftright(key, 22)
    found, earlier = F.lit(False), F.lit(True)
    for low, width in SEGMENTS:
        part = F.shiftrightunsigned(x, low).bitwiseAND((1 << width) - 1)
        n = F.bit_count(part)
        here = (bit >= low) & (bit < low + width)
        wild = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(bit - low, F.lit(0)))
        found = found | (earlier & here & (((n == 0) & (bit == low)) | ((n == 1) & (part == wild))))
        earlier = earlier & (n > 1)
    return found


def _forest(block: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Links that connect what is linked among one chunk, or between two."""
    fps = np.unique(block["fp"].to_numpy())
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= max_bits
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(fps))
    return pd.DataFrame({"a": fps[label[moved]], "b": fps[moved]})


def links(fps: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the distinct values of ``fp`` that join all fingerprints linked directly.

    Pairs within ``max_bits`` bits where a key has up to ``crowd`` members, a
    spanning forest of them where it has more.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    keyed = fps.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    crowded = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd))
    crowded = broadcast_if_small(crowded)
    # Spark sizes the exploded keys as one a fingerprint, and would broadcast all 64; the hint yields to a broadcast of ``crowded``.
    few = keyed.hint("merge").join(crowded, "key", "left_anti")
    left, right = few.hint("merge").select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits)
    pairs = left.join(right, near & _at_first_key(left["key"], x)).select("a", "b")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    mine, other = F.col("mine"), F.col("other")
    many = keyed.hint("merge").join(crowded, "key").select(
        "fp", "key", F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")
    )
    blocks = many.select("fp", "key", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"))
    forest = blocks.groupBy("key", "i", "j").applyInPandas(lambda b: _forest(b, max_bits), "a long, b long")
    return pairs.union(forest)


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (smallest id reachable by links) for every row of (doc_id, text)."""
    marked = stage(docs.select("doc_id", simhash(F.col("text"), shingle).alias("fp")))
    fps = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = stage(links(fps.select("fp"), max_bits))
    # The groups of more than one fingerprint; all others are their own.
    members = connected_components(edges, "a", "b")
    members = members.union(members.select("component", "component")).distinct().toDF("fp", "root")
    grouped = fps.join(members, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stage(grouped.join(ids, "root").select("fp", "component_id"))
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")

