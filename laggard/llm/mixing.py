"""Mixing sources to target weights: a curriculum inverted into training positions.

A source's weight is a piecewise linear function of the training progress
``t`` in [0, 1].  Its integral up to ``t`` is the share of the source's words
that training wants by then.  Documents of a source stand in a stable
pseudo-random order; a document that starts after ``c`` words of its source (or
after ``c`` words counted through earlier passes) is wanted at the ``t`` at
which the cumulative demand reaches ``c``.  The result is range-sorted by that
position.

Running word counts never gather a source: documents fall into hash buckets of
about ``BUCKET_DOCS`` documents each, every bucket is summed alone, and only one
row per (source, bucket) takes part in the sum across buckets.  A source with
a third of all rows is therefore spread over many tasks.  The table of sources
(one row each, as the weights are given per source) is bounded by
``MAX_SOURCES``, checked, and broadcast.

Null texts and texts without words have size 0 and are never taken; a null
source is a source of its own.  Rows repeated with the same key count each.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .text import word_count

BUCKET_DOCS = 2_000
MAX_SOURCES = 100_000
MAX_REPEATS = 3

Knots = Sequence[tuple[float, float]]  # (t, weight), t ascending


def capped_targets(weights: Sequence[float], sizes: Sequence[float], total: float, repeats: float = MAX_REPEATS) -> list[float]:
    """Share ``total`` by weight; what exceeds ``repeats`` times a size is shared again by weight."""
    targets, open_ = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0]
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > repeats * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in full:
            targets[i] = float(repeats * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def _at(knots: Knots, t: float) -> float:
    """Weight at ``t``: linear between knots, constant outside."""
    before = [k for k in knots if k[0] <= t]
    after = [k for k in knots if k[0] >= t]
    if not before or not after:
        return float((after or before)[0 if after else -1][1])
    (t0, w0), (t1, w1) = before[-1], after[0]
    return float(w0 if t1 == t0 else w0 + (w1 - w0) * (t - t0) / (t1 - t0))


def demand_curves(schedule: Sequence[Knots]) -> tuple[list[float], list[list[float]], list[list[float]]]:
    """Common knots, shares of each source at them (summing to 1), and the shares' integrals up to them."""
    times = sorted({0.0, 1.0, *(float(t) for knots in schedule for t, _ in knots if 0 < t < 1)})
    raw = [[_at(knots, t) for t in times] for knots in schedule]
    sums = [sum(column) or 1.0 for column in zip(*raw)]
    share = [[w / s for w, s in zip(row, sums)] for row in raw]
    reach = []
    for row in share:
        up = [0.0]
        for k in range(1, len(times)):
            up.append(up[-1] + (row[k - 1] + row[k]) / 2 * (times[k] - times[k - 1]))
        reach.append(up)
    return times, share, reach


def _inverse(words: Column, target: Column, times: Column, share: Column, reach: Column) -> Column:
    """The progress at which a source's cumulative demand reaches ``words``."""
    whole = F.element_at(reach, -1)
    want = words / target * whole
    k = F.greatest(F.lit(1), F.least(F.size(F.filter(reach, lambda r: r <= want)), F.size(reach) - 1))
    here, there = F.element_at(share, k), F.element_at(share, k + 1)
    t0, t1 = F.element_at(times, k), F.element_at(times, k + 1)
    left = F.greatest(F.lit(0.0), want - F.element_at(reach, k))
    # left = here * x + slope / 2 * x * x, solved without cancellation.
    slope = (there - here) / (t1 - t0)
    root = F.sqrt(F.greatest(F.lit(0.0), here * here + 2 * slope * left))
    return F.when(here + root > 0, F.least(t1, t0 + 2 * left / (here + root))).otherwise(t0)


SOURCE_FIELDS = "source string, n_docs long, source_size long, target double, times array<double>, share array<double>, reach array<double>"


def source_table(
    docs: DataFrame, schedule: Callable[[Sequence[str | None]], Mapping[str | None, Knots]],
    repeats: float = MAX_REPEATS, max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """One row per source with its size, target and demand curve."""
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    found = sums.limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than max_sources={max_sources} sources; weights are meant for sources, not documents")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    knots = schedule([r["source"] for r in found])
    times, share, reach = demand_curves([knots[r["source"]] for r in found])
    sizes = [r["source_size"] for r in found]
    targets = capped_targets([r[-1] for r in reach], sizes, sum(sizes), repeats)
    rows = [
        (r["source"], r["n_docs"], r["source_size"], t, times, s, c)
        for r, t, s, c in zip(found, targets, share, reach)
    ]
    return docs.sparkSession.createDataFrame(rows, SOURCE_FIELDS)


ADDED = ("size", "source_size", "target", "taken", "uses", "position")


def mix_sources(
    docs: DataFrame, schedule: Callable[[Sequence[str | None]], Mapping[str | None, Knots]],
    key: Sequence[str] = ("doc_id",), repeats: float = MAX_REPEATS, bucket_docs: int = BUCKET_DOCS, ordered: bool = True,
) -> DataFrame:
    """Documents with what the mix takes of them, range-sorted by training position if ``ordered``.

    ``docs`` needs ``source``, the ``key`` columns that order documents, and
    ``size`` or else ``text``.  ``schedule`` maps the sources, sorted by code
    point with null last, to their weight knots.  Added: ``size`` (words), ``source_size``, ``target`` (of the source, in
    words), ``taken`` (words taken, passes added up), ``uses`` (an array of
    (position, words), one per pass) and ``position`` (of the first use, null
    without one).  The last pass stops in the middle of a document, so each
    source's words equal its target but for rounding.  Columns of these names
    in ``docs``, except ``size``, are replaced.
    """
    if "size" not in docs.columns:
        docs = docs.withColumn("size", word_count(F.col("text")))
    columns = [c for c in docs.columns if c not in ADDED]
    sources = F.broadcast(source_table(docs, schedule, repeats).withColumnRenamed("source", "_source"))
    # The row travels as one column, so that no name of its own meets those used here.
    docs = docs.select(F.struct(*columns).alias("_row"), "size")
    rows = docs.join(sources, F.col("_row.source").eqNullSafe(F.col("_source")))
    keys = [F.col("_row").getField(k) for k in key]
    rows = rows.withColumn("_h", F.xxhash64(*keys))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_h"), F.ceil(F.col("n_docs") / bucket_docs)))
    per_bucket = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        F.col("_source").alias("_os"), F.col("_bucket").alias("_ob"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off")
    )
    same = F.col("_source").eqNullSafe(F.col("_os")) & (F.col("_bucket") == F.col("_ob"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_h", *keys, "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(offsets, same).withColumn("_start", F.col("_off") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    def use(n: Column) -> Column:
        """The n-th pass over this document: when, and how many of its words."""
        at = n * F.col("source_size") + F.col("_start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target") + 0.5) - at)).cast("long")
        return F.struct(_inverse(at, F.col("target"), F.col("times"), F.col("share"), F.col("reach")).alias("position"), words.alias("words"))

    passes = F.sequence(F.lit(0), F.floor(F.col("target") / F.col("source_size")).cast("int"))
    uses = F.when((F.col("target") > 0) & (F.col("size") > 0), F.filter(F.transform(passes, use), lambda u: u["words"] > 0))
    empty = F.array().cast("array<struct<position:double,words:long>>")
    rows = rows.withColumn("uses", F.coalesce(uses, empty))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda sum_, u: sum_ + u["words"])
    rows = rows.withColumns({"taken": taken, "position": F.get(F.col("uses")["position"], F.lit(0))})
    if not ordered:
        return rows.select("_row.*", *ADDED)
    # Documents without a use go to the end, spread by hash; positions tie only with equal starts.
    by = [F.col("position").asc_nulls_last(), F.col("_h")]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).select("_row.*", *ADDED)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per use, sorted by position: ``epoch`` counts the passes over a document from 0."""
    rest = [c for c in mixed.columns if c not in ("taken", "uses", "position")]
    uses = mixed.select(*rest, F.posexplode("uses").alias("epoch", "_use"))
    flat = uses.select(*rest, "epoch", "_use.position", F.col("_use.words").alias("words"))
    return flat.repartitionByRange("position").sortWithinPartitions("position")


def constant_weights(*weights: float) -> Callable[[Sequence[str | None]], dict[str | None, Knots]]:
    """A schedule that deals the weights to the sorted sources in turn, the same at all times."""
    return lambda sources: {s: [(0.0, float(weights[i % len(weights)]))] for i, s in enumerate(sources)}
