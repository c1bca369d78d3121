"""Substring deduplication by level-wise doubling of repeated windows.

A window of n words can repeat only if the windows of half its length at its two
ends repeat.  The ladder of lengths (13: 7, 13) therefore starts short, and only
what repeats at one length is extended to (at most) twice that length, until the
asked length is reached or nothing survives.

At the first length not every window is looked at: each window of the next
length is stood for by the smallest hash among the short windows in it, which
equal windows share (about a quarter of all short windows for 7 and 13).  At all
later lengths windows are compared in full, by 96 bits of hash.  A window counts
as repeated when it starts in two documents; it is removed from all but those
with the smallest id.

What grows with the corpus moves as narrow rows: (hash, document) in groupings
with map-side minima, then joins whose hot keys adaptive execution splits.  Each
level is written to the shared checkpoint folder.

Null texts have no words.  A null id counts as larger than every other; rows
that share an id do not remove from each other and are judged each by its own
text.  Documents shorter than a window lose nothing.  Texts of any length are
processed whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tables import Table, free_shuffles

NO_ID = (1 << 63) - 1
SHORTEST = 7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def ladder(window: int) -> list[int]:
    """Lengths from short to ``window``, each at most twice the one before; at least two."""
    lengths = [window]
    while lengths[0] > SHORTEST:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths if len(lengths) > 1 else [window, window]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word of a text."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 if len(raw) else starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    # Sum of byte * base^(position from the word's end), from right to left over the whole text.
    base = _BASES[which]
    powers = np.full(len(raw) + 1, base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    back = np.full(len(raw) + 1, inverse, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    value = (sums[ends] - sums[starts]) * back[starts]
    return _mix(value ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[j : j + count]
    return _mix(out)


def chosen(short: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each run of ``span`` hashes."""
    count, width, out = len(short) - span + 1, 1, short
    if count <= 0:
        return np.zeros(0, np.uint64)
    while 2 * width <= span:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return np.minimum(out[:count], out[span - width : span - width + count])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _tag(digest: str) -> int:
    """Tells apart rows that share a document id."""
    return int(digest[:7], 16)


def _survey(batches: Iterator[pd.DataFrame], lengths: list[int]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc"], batch["text"]):
            data = (text or "").encode()
            words = data.split()
            digest = _digest(words)
            short = window_hashes(word_hashes(data), lengths[0])
            marks = np.unique(chosen(short, lengths[1] - lengths[0] + 1)).view(np.int64)
            rows.append((doc, len(words), digest, _tag(digest), marks))
        yield pd.DataFrame(rows, columns=["doc", "n_words", "digest", "tag", "marks"])


def _windows(batches: Iterator[pd.DataFrame], n: int, before: int, first: bool) -> Iterator[pd.DataFrame]:
    """Windows of ``n`` words that may repeat: by surviving marks, or by surviving starts of length ``before``."""
    for batch in batches:
        for doc, text, alive, tags in zip(batch["doc"], batch["text"], batch["alive"], batch["tags"]):
            data = (text or "").encode()
            tag = _tag(_digest(data.split()))
            words = word_hashes(data)
            count = len(words) - n + 1
            if count <= 0 or (not first and tag not in tags):
                continue
            if first:
                live = np.isin(chosen(window_hashes(words, before), n - before + 1), np.asarray(alive, np.int64).view(np.uint64))
            else:
                ok = np.zeros(len(words), bool)
                ok[np.asarray(alive, np.int64)[np.asarray(tags) == tag]] = True
                live = ok[:count] & ok[n - before : n - before + count]
            at = np.flatnonzero(live)
            if len(at):
                other = window_hashes(word_hashes(data, 1), n)[at]
                yield pd.DataFrame({
                    "doc": doc, "tag": tag, "at": at.astype(np.int32), "h": window_hashes(words, n)[at].view(np.int64),
                    "g": (other >> np.uint64(32)).astype(np.uint32).view(np.int32),
                })


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of a partition put together to larger ones."""
    held, rows = [], 0
    for frame in batches:
        held.append(frame)
        rows += len(frame)
        if rows >= 50_000:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _cut(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text, starts, tags in zip(batch["doc"], batch["text"], batch["starts"], batch["tags"]):
            words = (text or "").encode().split()
            tag = _tag(_digest(words))
            at = np.asarray(starts, np.int64)[np.asarray(tags) == tag]
            if len(at):
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + n, -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept = [w for w, g in zip(words, gone) if not g]
                rows.append((doc, tag, int(gone.sum()), _digest(kept), b" ".join(kept).decode()))
        yield pd.DataFrame(rows, columns=["doc", "tag", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = True) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text`` for every row.

    ``kept_text`` has the kept words joined by one space.
    """
    lengths = ladder(window)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    survey = Table(rows.mapInPandas(
        lambda it: _survey(it, lengths), "doc long, n_words long, digest string, tag int, marks array<long>"
    ))
    base = survey.rows.select("doc", "n_words", "digest", "tag")
    # A later copy of a whole text goes as a whole; only first copies are searched.
    originals = base.groupBy("digest").agg(F.min("doc").alias("first"))
    base = Table(base.join(originals, "digest")).rows
    marks = survey.rows.select("doc", F.explode("marks").alias("h"))
    repeated = Table(marks.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("h"))
    free_shuffles(docs)
    alive = marks.join(repeated.rows, "h", "left_semi").groupBy("doc").agg(F.collect_list("h").alias("alive"))
    searched = base.filter("doc = first").select("doc").distinct()
    alive = Table(alive.join(searched, "doc").withColumn("tags", F.array().cast("array<int>")))
    survey.drop()
    repeated.drop()
    for k, (before, n) in enumerate(zip(lengths, lengths[1:])):
        free_shuffles(docs)
        found = Table(rows.join(alive.rows, "doc").mapInPandas(
            lambda it, n=n, before=before, k=k: _merged(_windows(it, n, before, k == 0)), "doc long, tag int, at int, h long, g int"
        ))
        alive.drop()
        free_shuffles(docs)
        again = Table(found.rows.groupBy("h", "g").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").drop("b"))
        free_shuffles(docs)
        # Tag and place travel as one number.
        packed = F.shiftleft(F.col("tag").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
        hits = found.rows.select("doc", "h", "g", packed.alias("where")).join(again.rows, ["h", "g"])
        hits = hits.filter(F.col("a") < F.col("doc") if n == window else F.lit(True)).select("doc", "where")
        place = lambda w: w.bitwiseAND(0xFFFFFFFF).cast("int")
        starts = hits.groupBy("doc").agg(F.collect_list("where").alias("where"))
        alive = Table(starts.select(
            "doc", F.transform("where", place).alias("alive"), F.transform("where", lambda w: F.shiftright(w, 32).cast("int")).alias("tags")
        ))
        found.drop()
        again.drop()
    free_shuffles(docs)
    marked = alive.rows.withColumnRenamed("alive", "starts")
    schema = "doc long, tag int, n_removed long, kept_sha256 string, kept_text string"
    cut = rows.join(marked, "doc").mapInPandas(lambda it: _cut(it, window), schema)
    cut = Table(cut if texts else cut.drop("kept_text")).rows.dropDuplicates(["doc", "tag"])
    alive.drop()
    free_shuffles(docs)
    whole = (F.col("doc") > F.col("first")) & (F.col("n_words") >= window)
    out = base.join(cut, ["doc", "tag"], "left").select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(_digest([]))).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if texts else []),
    )
    return out
