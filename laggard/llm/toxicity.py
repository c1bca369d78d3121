"""Toxicity by subword-bag embeddings averaged into a linear softmax.

The features are the character n-grams of words (4 to 6 bytes, word edges
included), hashed to ``BUCKET_BITS`` bits; those of
``MIN_TEXTS`` training texts have a row of the embedding table, others count with a zero vector.  A passage of
``PASSAGE`` words is the average of its n-grams' vectors, a linear softmax turns
it into probabilities, and a text scores as its most toxic passage.  Embeddings
and softmax are trained jointly in numpy on the driver: whole texts first, then
the passage that scores highest in each toxic text and all passages of clean ones.  A misspelling never seen in
training shares most n-gram vectors with the word it stands for.

Learned from at most ``per_class`` toxic and twice as many clean texts, drawn by
hash.  They have ``CHARACTERS`` characters between them: short texts are taken whole
and leave their room to longer ones, of which a window at a pseudo-random place is
taken, ``LONGEST`` characters at least.  Every text is scored whole.  Null and
empty texts score as a passage without n-grams.  Rows are judged one by one, so
repeated rows agree.  Without both classes to learn from all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import stage

SIZES = (4, 5, 6)
BUCKET_BITS = 22
PASSAGE = 8
DIMENSIONS = 8
PER_CLASS = 800  # toxic texts; twice as many clean ones
LONGEST = 4_000
CHARACTERS = 4_000_000
ROUNDS = 70
STEP = 4.0
DECAY = 0.005
MIN_TEXTS = 5
_BATCH_BYTES = 1 << 20

_FOLD = np.full(256, 32, np.uint8)  # whatever separates words becomes a space
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_c] = _c
_FOLD[65:91] = np.arange(97, 123)


class Model(NamedTuple):
    seen: np.ndarray  # buckets seen in training
    weights: np.ndarray  # of these: the vector times the difference of the softmax columns
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[self.seen] = self.weights
        return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and passage of every n-gram, and for each passage its text.  Each text has a passage at least."""
    data = [(t or "").lower().encode() for t in texts]
    raw = _FOLD[np.frombuffer(b" " + b" ".join(data) + b" " * SIZES[-1], np.uint8)]
    lengths = np.fromiter(map(len, data), np.int64, len(data)) + 1
    ends = np.cumsum(lengths)
    space = raw == 32
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    text_of_word = np.searchsorted(ends, starts - 1, "right")
    first_word = np.searchsorted(text_of_word, np.arange(len(data)))
    words = np.diff(np.r_[first_word, len(starts)])
    passages = np.maximum(1, -(-words // PASSAGE))
    first_passage = np.cumsum(passages) - passages
    passage_of_word = first_passage[text_of_word] + (np.arange(len(starts)) - first_word[text_of_word]) // PASSAGE
    blanks = np.cumsum(space, dtype=np.int32)
    word_at = np.cumsum(np.r_[False, ~space[1:] & space[:-1]], dtype=np.int32) - 1
    ids, where = [], []
    h, n = raw.astype(np.uint32), 1
    while n < SIZES[-1]:
        h = h[:-1] * np.uint32(0x01000193) + raw[n:]
        n += 1
        if n in SIZES:
            at = np.flatnonzero(blanks[n - 2 : len(raw) - 2] == blanks[: len(raw) - n])  # no space but at the edges
            at = at[~space[at + 1]]
            mixed = (h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            ids.append((mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
            where.append(passage_of_word[word_at[at + 1]].astype(np.int32))
    return np.concatenate(ids), np.concatenate(where), np.repeat(np.arange(len(data)), passages)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str], toxic: list[int], rounds: int = ROUNDS, step: float = STEP, decay: float = DECAY, seed: int = 5) -> Model:
    """Fit embeddings and softmax to labelled texts."""
    y = np.array(toxic)
    if len(set(toxic)) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -np.inf)
    parts, at = [], 0
    texts_with = np.zeros(1 << BUCKET_BITS, np.int32)
    for block in (texts[a : a + 100] for a in range(0, len(texts), 100)):
        ids, where, text_of = grams(block)
        pairs = np.unique(text_of[where] << BUCKET_BITS | ids)
        np.add.at(texts_with, pairs & ((1 << BUCKET_BITS) - 1), 1)
        parts.append((ids, where + np.int32(at), text_of))
        at += len(text_of)
    ids, where = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    text_of = np.concatenate([p[2] + 100 * n for n, p in enumerate(parts)])
    del parts
    sizes = np.maximum(1, np.bincount(where, minlength=len(text_of)))
    text_sizes = np.maximum(1, np.bincount(text_of[where], minlength=len(texts)))
    # N-grams of fewer texts teach nothing but those texts.
    used = texts_with >= MIN_TEXTS
    seen = np.flatnonzero(used).astype(np.int32)
    ids, where = (np.cumsum(used, dtype=np.int32) - 1)[ids[used[ids]]], where[used[ids]]
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((len(seen), DIMENSIONS)) * 0.01).astype(np.float32)
    softmax = rng.standard_normal((DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    speed, speed_softmax, speed_bias = np.zeros_like(vectors), np.zeros_like(softmax), np.zeros_like(bias)
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for r in range(rounds):
        difference = softmax[:, 1] - softmax[:, 0]
        weight = vectors @ difference
        sums = np.bincount(where, weights=weight[ids], minlength=len(text_of))
        if r < rounds // 4:
            logit = np.bincount(text_of, weights=sums, minlength=len(texts)) / text_sizes
            error = (sigmoid(logit + bias[1] - bias[0]) - y) * balance
            of_passage = error[text_of] / text_sizes[text_of]
        else:
            # Each toxic text teaches by its most toxic passage, a clean one by all its passages.
            means = sums / sizes
            best = np.lexsort((means, text_of))[np.r_[np.flatnonzero(np.diff(text_of)), len(text_of) - 1]]
            of_passage = sigmoid(means + bias[1] - bias[0]) * (y[text_of] == 0) * balance[text_of]
            best = best[y == 1]
            of_passage[best] = (sigmoid(means[best] + bias[1] - bias[0]) - 1) * balance[y == 1]
            error, of_passage = of_passage, of_passage / sizes
        d_weight = np.bincount(ids, weights=of_passage.astype(np.float32)[where], minlength=len(seen)).astype(np.float32)
        d_vectors = np.outer(d_weight, difference)
        d_difference = vectors.T @ d_weight
        rate = 1 - r / rounds
        # One step length for the whole table, so that rare n-grams move little.
        speed = 0.8 * speed + step * rate * d_vectors / max(float(np.linalg.norm(d_vectors)), 1e-9)
        speed_softmax = 0.8 * speed_softmax + 0.02 * rate * np.stack([-d_difference, d_difference], 1) / max(float(np.linalg.norm(d_difference)), 1e-9)
        speed_bias = 0.8 * speed_bias + 0.5 * rate * np.array([-error.sum(), error.sum()], np.float32)
        vectors -= speed
        vectors *= 1 - decay
        softmax -= speed_softmax
        bias -= speed_bias
    return Model(seen, (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(model: Model, texts: list[str | None], table: np.ndarray | None = None) -> np.ndarray:
    """Probability that each text is toxic: that of its most toxic passage."""
    table = model.table() if table is None else table
    ids, where, text_of = grams(texts)
    n = np.bincount(where, minlength=len(text_of))
    means = np.bincount(where, weights=table[ids], minlength=len(text_of)) / np.maximum(1, n)
    top = np.maximum.reduceat(means, np.searchsorted(text_of, np.arange(len(texts)))) if len(texts) else means
    return np.zeros(len(texts)) if np.isinf(model.bias) else sigmoid(top + model.bias)


def toxicity(text: Column, model: Model) -> Column:
    """Score of a text, 0 to 1."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = model.table()
        for batch in batches:
            out, part, size = [], [], 0
            for t in batch:
                part.append(t)
                size += len(t or "")
                if size >= _BATCH_BYTES:
                    out.append(scores(model, part, table))
                    part, size = [], 0
            if part:
                out.append(scores(model, part, table))
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return of(text)


def _room(sizes: list[int]) -> int:
    """Characters that are taken of a text at most, so that these texts have ``CHARACTERS`` together."""
    left, rest = CHARACTERS, sorted(sizes)
    for i, size in enumerate(rest):
        if size * (len(rest) - i) > left:
            return max(LONGEST, left // (len(rest) - i))
        left -= size
    return max([LONGEST, *rest[-1:]])


def labelled_texts(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_class`` toxic and twice as many clean rows; ``labels`` has doc_id and toxic.

    The labels are few and narrow: ids are drawn from them alone, by hash, and
    only then are their texts looked up with a broadcast of at most
    ``3 * per_class`` ids.  Lengths are read first, as they say how much of a text
    is taken.  Texts of a repeated id count as often as they stand there.
    """
    rows = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id"))
    drawn = [rows.filter(F.col("toxic") == c).orderBy("h", "doc_id").limit(n) for c, n in ((0, 2 * per_class), (1, per_class))]
    drawn = F.broadcast(stage(drawn[0].union(drawn[1])))
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").join(drawn, "doc_id")
    texts = texts.select("h", "toxic", "text", F.xxhash64("text").alias("t"), F.length("text").alias("size"))
    most = 3 * per_class
    found = texts.groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).orderBy("h", "t").limit(most).collect()
    copies = {(r["h"], r["t"]): r["n"] for r in found}
    room = _room([r["size"] for r in found for _ in range(min(r["n"], most))][:most])
    place = F.pmod(F.xxhash64("h", "t"), F.greatest(F.col("size") - room + 1, F.lit(1))).cast("int") + 1
    parts = texts.select("h", "t", "toxic", F.col("text").substr(place, F.lit(room)).alias("part"))
    rows = parts.dropDuplicates(["h", "t"]).orderBy("h", "t").limit(most).collect()
    rows = [r for r in rows for _ in range(min(copies[r["h"], r["t"]], most))][:most]
    return [r["part"] for r in rows], [r["toxic"] for r in rows]
