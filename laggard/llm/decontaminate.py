"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ in up to ``k = floor(rate * m)`` edits.
Cut into k + 1 pieces, at least one of them stands unchanged in any such copy.
All pieces of a block of items are found in one pass over a text with a
multi-pattern automaton.  The same argument holds for groups of neighbouring
pieces, halved again and again: some hit lies in a chain of ever larger groups of
n pieces with fewer than n edits each.  Around a hit, Myers' bit-parallel
algorithm checks the groups from small to large, and at last the edit distance of
the whole item, which decides.

Texts and items are compared in lower case with white space runs as one space;
``start`` and ``end`` are positions in the text so normalised.  The benchmark is
read in blocks of at most ``BLOCK_BYTES`` of text (and one item), each small
enough to be held by every task, so a large benchmark means more passes over the
documents and no larger tasks.

Null or empty texts match nothing, items without text are never found.  An item
with a null id is found like any other and reported with a null ``item_id``.
Repeated documents are judged each; items with equal texts are all reported.
Tables without rows give no matches.  Extra columns are kept by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

ERROR_RATE = 0.1
BLOCK_BYTES = 2 << 20

MATCHES = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Start and end of ``k + 1`` nearly equal pieces, and the groups they lie in.

    Groups are (start, end, edits allowed), small to large, without the piece and the whole.
    """
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    groups: list[list[tuple[int, int, int]]] = [[] for _ in range(k + 1)]

    def halve(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        if hi - lo <= k:
            for i in range(lo, hi):
                groups[i].insert(0, (cuts[lo], cuts[hi], hi - lo - 1))
        halve(lo, (lo + hi) // 2)
        halve((lo + hi) // 2, hi)

    halve(0, k + 1)
    return [(a, b, g) for a, b, g in zip(cuts, cuts[1:], groups) if b > a]


def letter_masks(pattern: str) -> dict[str, int]:
    """For each character the places where the pattern has it, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(pattern: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """Least distance of the pattern to a part of the text, if at most ``k``, and where the part ends (Myers)."""
    m, masks = len(pattern), masks or letter_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        vertical = eq | minus
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score <= k and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Matcher:
    """The items of one block with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items if t]
        found: dict[str, list[tuple[int, int, list[tuple[int, int, int]]]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for a, b, groups in pieces(text, k):
                found.setdefault(text[a:b], []).append((n, a, groups))
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best match of every item found."""
        if not self.items or not text:
            return []
        text = normalised(text)
        spots: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for n, at, groups in where:
                start = end + 1 - length - at
                if all(self._near(n, text, start, *g) for g in groups):
                    spots.setdefault(n, set()).add(start)
        out = []
        for n, starts in spots.items():
            item, pattern, k = self.items[n]
            best = None
            for lo, hi in self._areas(sorted(starts), len(pattern), k):
                lo = max(0, lo)
                got = best_end(pattern, text[lo:hi], k)
                if got and (best is None or got[0] < best[0]):
                    end = lo + got[1]
                    # The same distance read backwards gives the start.
                    back = text[max(lo, end - len(pattern) - k) : end][::-1]
                    best = got[0], end - best_end(pattern[::-1], back, got[0])[1], end
            if best:
                out.append((item, *best))
        return sorted(out, key=lambda m: (m[0] is None, m[0] or 0, *m[1:]))

    def _near(self, n: int, text: str, start: int, a: int, b: int, edits: int) -> bool:
        """Whether characters a to b of an item stand near where they should, with so many edits at most."""
        area, pattern = text[max(0, start + a - edits) : start + b + edits], self.items[n][1][a:b]
        masks = self.masks.get((n, a, b)) or self.masks.setdefault((n, a, b), letter_masks(pattern))
        return best_end(pattern, area, edits, masks) is not None

    @staticmethod
    def _areas(starts: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
        """Parts of the text around the hits; overlapping ones are put together."""
        lo, hi = starts[0] - k, starts[0] + m + k
        for s in starts[1:]:
            if s - k > hi:
                yield lo, hi
                lo = s - k
            hi = s + m + k
        yield lo, hi


def _blocks(benchmark: DataFrame, rate: float, block_bytes: int) -> list[Callable[[Column], Column]]:
    """For each block of items, a function of the text that lists the matches."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    out = []
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct()
        rows = sorted(((r["item_id"], normalised(r["text"])) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        out.append(_finder(spark.sparkContext.broadcast(rows), rate))
    return out


def _finder(items: Broadcast, rate: float) -> Callable[[Column], Column]:
    @F.pandas_udf(MATCHES)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items.value, rate)
        for batch in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "start", "end"), m)) for m in matcher.matches(t)] for t in batch])

    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, item_id, distance, start, end) for each document and each item found in it."""
    out = None
    for found in _blocks(benchmark, rate, block_bytes):
        rows = docs.select("doc_id", F.explode(found(F.col("text"))).alias("m")).select("doc_id", "m.*")
        out = rows if out is None else out.union(rows)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item is found; rows stay where they are, nothing is shuffled."""
    for found in _blocks(benchmark, rate, block_bytes):
        docs = docs.filter(F.size(found(F.col("text"))) == 0)
    return docs
