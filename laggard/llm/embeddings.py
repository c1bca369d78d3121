"""Embedding near-duplicates by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the cells are the
products of the two.  A vector is indexed in the cell of its nearest centroids
and visits the cells nearest to it in multi-sequence order, that is by the sum
of the two half distances.  How many it visits follows from a recall target:
sample vectors are turned to exactly the threshold's angle in random directions,
and the smallest number of cells that finds the target share of them, from one
side or the other, is taken.  Pairs that meet in a cell are verified by cosine in
double precision.

The codebooks are fitted on at most ``sample`` vectors, drawn by hash; every
vector is indexed and searches.  Cells hold about ``CELL_ROWS`` vectors for any
table that the sample can give enough centroids for (``sample`` / 8 per half).
Equal vectors are searched once and counted with their number.  A crowded cell
is cut into chunks and every pair of chunks is one bounded group; groups return
counts and links of a spanning forest, never pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with
nothing.  Vectors link with those of their own length; each length has an index of its own,
the sample being shared among them, and lengths beyond the ``LENGTHS`` commonest are a
cell each.  Repeated rows are vectors of their own; null ids are never the smallest id.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import stage
from .components import connected_components

SAMPLE = 20_000
CELL_ROWS = 64
CHUNK = 1_024
TARGET_RECALL = 0.98
LENGTHS = 100
PROBED = 2_000  # sample vectors that measure how many cells to visit


class MultiIndex(NamedTuple):
    first: np.ndarray  # centroids of the first halves
    second: np.ndarray
    visits: int  # cells each vector visits


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of the rows, from a fixed seed."""
    rng = np.random.default_rng(7)
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _squared(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _ranks(x: np.ndarray, y: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many cells stand before the cell of y in the order of x."""
    h = x.shape[1] // 2
    a, b = _squared(x[:, :h], first), _squared(x[:, h:], second)
    i, j = _squared(y[:, :h], first).argmin(1), _squared(y[:, h:], second).argmin(1)
    a.sort(axis=1), b.sort(axis=1)
    raw_a, raw_b = _squared(x[:, :h], first), _squared(x[:, h:], second)
    want = raw_a[np.arange(len(x)), i] + raw_b[np.arange(len(x)), j]
    return np.array([np.searchsorted(b[r], want[r] - a[r], "left").sum() for r in range(len(x))])


def fit_index(sample: np.ndarray, n: int, threshold: float, target_recall: float = TARGET_RECALL) -> MultiIndex:
    """Codebooks for a table of ``n`` vectors from unit sample vectors, and the number of cells to visit."""
    h = sample.shape[1] // 2
    k = max(1, min(math.ceil(math.sqrt(n / CELL_ROWS)), len(sample) // 8 or 1))
    first, second = codebook(sample[:, :h], k), codebook(sample[:, h:], k)
    rng = np.random.default_rng(8)
    x = sample[rng.permutation(len(sample))[:PROBED]]
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * away / np.where(norm > 0, norm, 1)
    ranks = np.sort(np.minimum(_ranks(x, y, first, second), _ranks(y, x, first, second)))
    visits = int(ranks[min(len(ranks) - 1, math.ceil(target_recall * len(ranks)) - 1)]) + 1
    return MultiIndex(first, second, min(visits, k * k))


def visited(x: np.ndarray, index: MultiIndex) -> np.ndarray:
    """Cells in multi-sequence order, the own one first, for each row."""
    h, k, t = x.shape[1] // 2, len(index.second), index.visits
    a, b = _squared(x[:, :h], index.first), _squared(x[:, h:], index.second)
    near_a, near_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    # The pair (i, j) of the i-th and j-th nearest halves has (i + 1) * (j + 1) - 1 pairs before it.
    i, j = np.array([(i, j) for i in range(min(t, len(index.first))) for j in range(min(k, t // (i + 1)))]).T
    sums = np.take_along_axis(a, near_a, 1)[:, i] + np.take_along_axis(b, near_b, 1)[:, j]
    order = np.argsort(sums, axis=1, kind="stable")[:, :t]
    return np.take_along_axis(near_a, i[order], 1) * k + np.take_along_axis(near_b, j[order], 1)


def _one_cell(length: int) -> MultiIndex:
    return MultiIndex(np.zeros((1, length // 2)), np.zeros((1, length - length // 2)), 1)


def _probe(batches: Iterator[pd.DataFrame], indexes: dict[int, MultiIndex]) -> Iterator[pd.DataFrame]:
    """Each vector once as a member of its cell and once for every cell it visits."""
    for batch in batches:
        for length, alike in batch.groupby("length"):
            index = indexes.get(length) or _one_cell(length)
            rows = max(1, 100_000 // index.visits)
            for at in range(0, len(alike), rows):
                part = alike.iloc[at : at + rows]
                vectors = np.stack(part["embedding"].to_numpy())
                cells = visited(unit(vectors), index)
                raw = [v.tobytes() for v in vectors.astype(np.float64)]
                own = {"cid": part["cid"].to_numpy(), "n": part["n"].to_numpy(), "home": cells[:, 0], "vector": raw}
                visits = [c.astype(np.int64).tobytes() for c in cells]
                yield pd.DataFrame({"length": length, "cell": cells[:, 0], "member": True, **own, "visits": visits})
                t, who = cells.shape[1], np.repeat(np.arange(len(part)), cells.shape[1])
                yield pd.DataFrame({
                    "length": length, "cell": cells.ravel(), "member": False, "cid": own["cid"][who], "n": own["n"][who],
                    "home": own["home"][who], "vector": [raw[w] for w in who], "visits": [b""] * (t * len(part)),
                })


def _compare(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts of links found here, and links of a forest that joins what is linked."""
    empty = pd.DataFrame({"cid": [], "links": [], "least": []}).astype("int64")
    q, i = block[~block["member"]], block[block["member"]]
    if not len(q) or not len(i):
        return empty
    read = lambda s: np.frombuffer(b"".join(s), np.float64).reshape(len(s), -1)
    qid, iid = q["cid"].to_numpy(), i["cid"].to_numpy()
    near = (unit(read(q["vector"])) @ unit(read(i["vector"])).T >= threshold) & (qid[:, None] != iid[None])
    rows, cols = np.nonzero(near.any(1))[0], np.nonzero(near.any(0))[0]
    if not len(rows):
        return empty
    near, q, i, qid, iid = near[np.ix_(rows, cols)], q.iloc[rows], i.iloc[cols], qid[rows], iid[cols]
    n_q, n_i = q["n"].to_numpy(), i["n"].to_numpy()
    # The searching vector counts the link.  The member counts it here unless it visits the other's cell itself.
    visits = np.frombuffer(b"".join(i["visits"]), np.int64).reshape(len(i), -1)
    homes, which = np.unique(q["home"].to_numpy(), return_inverse=True)
    searches = np.stack([(visits == h).any(1) for h in homes])[which]
    q_links, i_links = near @ n_i, ((near & ~searches) * n_q[:, None]).sum(0)
    far = np.iinfo(np.int64).max
    q_least, i_least = qid.copy(), iid.copy()
    while True:
        new_q = np.minimum(q_least, np.where(near, i_least[None], far).min(1))
        new_i = np.minimum(i_least, np.where(near, new_q[:, None], far).min(0))
        if (new_q == q_least).all() and (new_i == i_least).all():
            break
        q_least, i_least = new_q, new_i
    return pd.DataFrame({"cid": np.r_[qid, iid], "links": np.r_[q_links, i_links], "least": np.r_[q_least, i_least]})


def _indexes(classes: DataFrame, threshold: float, target_recall: float, sample: int) -> dict[int, MultiIndex]:
    """An index for each of the ``LENGTHS`` commonest lengths, fitted on its share of the sample."""
    counts = {r["length"]: r["count"] for r in classes.groupBy("length").count().orderBy(F.desc("count"), "length").limit(LENGTHS).collect()}
    if not counts:
        return {}
    # Room that a length does not need goes to the longer tables.
    share, left = {}, sample
    for i, (length, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        share[length] = min(n, max(1, left // (len(counts) - i)))
        left -= share[length]
    # About 1.2 times as many by hash, cut to the share on the driver.
    top = 1 << 32
    part = {length: min(top, int(top * (1.2 * share[length] + 20) / n)) for length, n in counts.items()}
    below = F.element_at(F.create_map(*[F.lit(x) for p in part.items() for x in p]), F.col("length"))
    h = F.xxhash64("embedding")
    drawn = classes.withColumn("h", F.pmod(h, F.lit(top))).filter(F.col("h") < below).select("length", "h", "embedding").collect()
    drawn = sorted(drawn, key=lambda r: (r["h"], r["embedding"]))
    out = {}
    for length, n in counts.items():
        own = [r["embedding"] for r in drawn if r["length"] == length][: share[length]]
        out[length] = fit_index(unit(np.array(own)), n, threshold, target_recall) if len(own) else _one_cell(length)
    return out


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, target_recall: float = TARGET_RECALL, sample: int = SAMPLE, chunk: int = CHUNK,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of (vec_id, embedding)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fits = usable(F.col("embedding"))
    good = rows.filter(fits)
    classes = good.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = stage(classes.withColumns({"cid": F.monotonically_increasing_id(), "length": F.size("embedding")}))
    indexes = _indexes(classes, threshold, target_recall, sample)
    probes = classes.mapInPandas(
        lambda it: _probe(it, indexes), "length int, cell long, member boolean, cid long, n long, home long, vector binary, visits binary"
    )
    probes = stage(probes)
    # One row per cell; a cell with many rows is dealt to (searching chunk, member chunk) groups.
    pieces = lambda of: F.greatest(F.lit(1), F.ceil(F.count_if(of) / chunk)).cast("int")
    cells = stage(probes.groupBy("length", "cell").agg(pieces(F.col("member")).alias("mc"), pieces(~F.col("member")).alias("qc")))
    mine = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    member, all_ = F.col("member"), lambda n: F.sequence(F.lit(0), n - 1)
    dealt = probes.join(cells, ["length", "cell"]).withColumn("_m", F.when(member, F.array(mine(F.col("mc")))).otherwise(all_(F.col("mc"))))
    dealt = dealt.withColumn("_q", F.when(member, all_(F.col("qc"))).otherwise(F.array(mine(F.col("qc")))))
    dealt = dealt.withColumn("m", F.explode("_m")).withColumn("q", F.explode("_q")).drop("_m", "_q", "mc", "qc")
    found = stage(dealt.groupBy("length", "cell", "q", "m").applyInPandas(lambda b: _compare(b, threshold), "cid long, links long, least long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    members = connected_components(found.select("cid", "least"), "cid", "least").toDF("cid", "root")
    of = classes.join(links, "cid", "left").join(members, "cid", "left")
    of = of.select("embedding", "first", F.coalesce("root", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    of = stage(of)
    ids = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = good.join(of, "embedding").join(ids, "root").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fits).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
