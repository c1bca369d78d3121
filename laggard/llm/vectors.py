"""Vector code compression: product codes with equal-average nearest-entry search.

Each component becomes the integer floor(1024 * x); a vector is cut into equal
consecutive parts, each with a codebook of its own.  A codebook starts as the
parts of the first vectors by id and is refined in a fixed number of rounds:
every part goes to its nearest entry (squared Euclidean distance, ties to the
lower index), then an entry becomes the componentwise floor of its parts' mean.
Unused entries stay.  All sums are integers, so reruns agree whatever the
partitioning.

Equal-average search.  The squared distance of two parts of d components is at
least the square of the gap of their component sums over d.  Entries stand
sorted by sum; from a part's own sum the search goes outward, entry by entry on
both sides, until gap ** 2 / d strictly exceeds the best distance, so ties are
still seen.  A task does so for many parts at once: those whose next entry may
still win are compared, the others are done.

Every round is one pass over the vectors that returns, per task, a sum and a
count for each used entry; only the codebooks (``parts`` times ``entries`` short
vectors) are on the driver.

Rows whose vector is null or holds a null or non-finite component are dropped.
Scaled components are kept within +-2 ** 24, so distances are exact for parts of
up to 4,096 components.  Where the
length is no multiple of ``parts`` the last parts are the longer ones; vectors of
another length than others have codebooks of their own.  Equal ids are ordered
by vector, null ids stand last.  With fewer vectors than entries there are fewer
entries.  Repeated rows get the same code and count each; empty vectors have
distance 0; an empty table gives an empty result.  Other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import broadcast_if_small, stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 24
MAX_LENGTHS = 100
_BLOCK = 4_096  # vectors searched at once
_FAR = 1 << 62  # no entry left on this side
_SQUARED = 3_037_000_499  # the largest number whose square fits 64 bits

Codebooks = list[np.ndarray]  # one array (entries, components) per part


def cut(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    """The parts of the rows, consecutive columns."""
    edges = [vectors.shape[1] * p // parts for p in range(parts + 1)]
    return [vectors[:, a:b] for a, b in zip(edges, edges[1:])]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance, for each row of integers."""
    n, d = x.shape
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    sorted_sums, sorted_entries = sums[order], entries[order]
    own = x.sum(1)
    right = np.searchsorted(sorted_sums, own)
    left = right - 1
    best, where = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    active = np.arange(n)
    while True:
        # The nearer sum of the two next entries, beyond both ends none.
        gap_l = np.where(left[active] >= 0, own[active] - sorted_sums[np.maximum(left[active], 0)], _FAR)
        gap_r = np.where(right[active] < len(sums), sorted_sums[np.minimum(right[active], len(sums) - 1)] - own[active], _FAR)
        gap = np.minimum(gap_l, gap_r)
        # Done when there is no entry left, or gap ** 2 / d strictly exceeds the best distance.
        on = (gap < _FAR) & (np.minimum(gap, _SQUARED) ** 2 <= _times(best[active], d))
        active, go_left = active[on], (gap_l <= gap_r)[on]
        if not len(active):
            break
        at = np.where(go_left, left[active], right[active])
        difference = x[active] - sorted_entries[at]
        distance, index = np.einsum("ij,ij->i", difference, difference), order[at]
        wins = (distance < best[active]) | ((distance == best[active]) & (index < where[active]))
        best[active[wins]], where[active[wins]] = distance[wins], index[wins]
        left[active[go_left]] -= 1
        right[active[~go_left]] += 1
    return where, best


def _times(best: np.ndarray, d: int) -> np.ndarray:
    """best * d, or the largest number where that is beyond it."""
    top = np.iinfo(np.int64).max
    return np.where(best > top // max(d, 1), top, best * d)


def _rows(batch: pd.DataFrame, column: str) -> Iterator[tuple[slice, np.ndarray]]:
    for at in range(0, len(batch), _BLOCK):
        part = slice(at, at + _BLOCK)
        yield part, np.stack([np.asarray(v, np.int64) for v in batch[column].iloc[part]])


def _sums(batches: Iterator[pd.DataFrame], books: dict[int, Codebooks]) -> Iterator[pd.DataFrame]:
    """Count and componentwise sum of the parts assigned to each entry in this task."""
    total: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for length, rows in batch.groupby("length"):
            book = books[length]
            state = total.setdefault(length, [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in book])
            for _, x in _rows(rows, "scaled"):
                for part, entries, (n, sums) in zip(cut(x, len(book)), book, state):
                    where, _ = nearest(part, entries)
                    n += np.bincount(where, minlength=len(entries))
                    np.add.at(sums, where, part)
    for length, state in total.items():
        for p, (n, sums) in enumerate(state):
            used = np.flatnonzero(n)
            yield pd.DataFrame({"length": length, "part": p, "entry": used, "n": n[used], "sums": list(sums[used])})


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of all components, within +-LIMIT; null where a vector cannot be used."""
    number = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = F.transform(number, lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("long"))
    return F.when(fine, kept)


def first_entries(rows: DataFrame, entries: int) -> dict[int, np.ndarray]:
    """The scaled vectors of the smallest ids, for each vector length."""
    sizes = [r["length"] for r in rows.select("length").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(sizes) > MAX_LENGTHS:
        raise ValueError(f"More than {MAX_LENGTHS} different vector lengths")
    out = {}
    for length in sizes:
        order = [F.asc_nulls_last("vec_id"), "scaled"]
        drawn = rows.filter(F.col("length") == length).select("vec_id", "scaled").orderBy(*order).limit(entries).collect()
        out[length] = np.array([r["scaled"] for r in drawn], np.int64).reshape(len(drawn), length)
    return out


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, Codebooks]:
    """Codebooks by vector length; ``rows`` has vec_id, length and scaled."""
    books = {n: [p.copy() for p in cut(x, parts)] for n, x in first_entries(rows, entries).items()}
    for _ in range(rounds):
        sums = rows.select("length", "scaled").mapInPandas(lambda it: _sums(it, books), "length int, part int, entry int, n long, sums array<long>")
        # Per component, so that tasks' sums meet in narrow rows.
        cells = sums.select("length", "part", "entry", "n", F.posexplode_outer("sums").alias("at", "value"))
        means = cells.groupBy("length", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        fresh = {n: [b.copy() for b in book] for n, book in books.items()}
        for r in means.filter("at IS NOT NULL").collect():
            fresh[r["length"]][r["part"]][r["entry"], r["at"]] = r["value"] // r["n"]
        books = fresh
    return books


def codebook_text(book: Codebooks) -> str:
    """All components in decimal, by part, entry and position, joined by commas."""
    return ",".join(str(int(x)) for part in book for x in part.ravel())


def _encode(batches: Iterator[pd.DataFrame], books: dict[int, Codebooks], hashes: dict[int, str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for length, rows in batch.groupby("length"):
            book = books[length]
            for at, x in _rows(rows, "scaled"):
                found = [nearest(p, entries) for p, entries in zip(cut(x, len(book)), book)]
                codes = np.stack([w for w, _ in found], 1)
                yield rows.iloc[at].drop(columns=["scaled", "length"]).assign(
                    code=["".join(f"{c:02x}" for c in row) for row in codes],
                    error=np.sum([e for _, e in found], axis=0), codebooks_sha256=hashes[length],
                )


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of (vec_id, embedding, label).

    ``entries`` is 256 at most, two hex digits of code per part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows = vectors.select("vec_id", "label", scaled(F.col("embedding")).alias("scaled")).filter("scaled IS NOT NULL")
    rows = stage(rows.withColumn("length", F.size("scaled")))
    books = fit_codebooks(rows, parts, entries, rounds)
    hashes = {n: hashlib.sha256(codebook_text(b).encode()).hexdigest() for n, b in books.items()}
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string"
    coded = stage(rows.mapInPandas(lambda it: _encode(it, books, hashes), schema))
    totals = broadcast_if_small(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")))
    found = coded.join(totals, F.col("label").eqNullSafe(F.col("same")), "left")
    return found.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
