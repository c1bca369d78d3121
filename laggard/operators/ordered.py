"""Order-dependent operators that never gather a whole table, or a whole group, in one task.

Rows are range-partitioned on (group, order) keys, so even one group that holds
a third of the table is cut into many partitions.  What crosses partitions is
one carry per partition boundary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from .quantiles import join_groups
from .staging import BROADCAST_ROWS, stage

_IDX_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in key order as a staged table with partition number ``_pid`` and row number ``_idx``."""
    ids = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", ids)
    return stage(
        ranged.withColumns(
            {"_pid": F.shiftright("_mid", _IDX_BITS).cast("int"), "_idx": F.col("_mid").bitwiseAND((1 << _IDX_BITS) - 1)}
        ).drop("_mid")
    )


def with_global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank0") -> DataFrame:
    """Add the 0-based position of every row in the total order; ``order`` must be unique."""
    rows = _numbered(df, order)
    # One row per range partition, so this single-task window stays tiny.
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_pid").count().select("_pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    return (
        rows.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + F.col("_idx"))
        .drop("_pid", "_idx", "_off")
    )


_NARROWED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
_ACCURACY = 10_000  # of the sketch: a bracket holds about 4 / _ACCURACY of the rows, ties apart


def _at_positions(df: DataFrame, order: Sequence[Column], wanted: Sequence[int]) -> dict[int, Row]:
    """The rows at some positions, by sorting all given rows."""
    rows = _numbered(df, order)
    sizes = sorted((r["_pid"], r["count"]) for r in rows.groupBy("_pid").count().collect())
    where, start = {}, 0
    for pid, n in sizes:
        where.update({(pid, p - start): p for p in wanted if start <= p < start + n})
        start += n
    if not where:
        return {}
    hit = F.lit(False)
    for pid, idx in where:
        hit = hit | ((F.col("_pid") == pid) & (F.col("_idx") == idx))
    return {where[r["_pid"], r["_idx"]]: r for r in rows.filter(hit).collect()}


def _brackets(df: DataFrame, first: Column, total: int, wanted: Sequence[int]) -> list[tuple[object, object, int, int]]:
    """For each position values (low, high) of the first key around it, and how many rows lie below low and up to high.

    Null and NaN keys have no bracket: nulls come first, NaN last, and both are counted.
    """
    sure = [min(1.0, max(0.0, p / total + d)) for p in wanted for d in (-2 / _ACCURACY, 2 / _ACCURACY)]
    values = df.agg(F.percentile_approx(first, sure, _ACCURACY).alias("v")).first()["v"]
    if values is None:
        return []
    pairs = list(zip(values[::2], values[1::2]))
    counts = [c for low, high in pairs for c in (F.count_if(first.isNull() | (first < F.lit(low))), F.count_if(first.isNull() | (first <= F.lit(high))))]
    got = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
    return [(low, high, got[2 * i], got[2 * i + 1]) for i, (low, high) in enumerate(pairs)]


def keys_at(
    df: DataFrame, order: Sequence[Column], positions: Callable[[int], Sequence[int]]
) -> tuple[int, dict[int, Row]]:
    """Row count and the rows at some positions of the total order (ascending, nulls first).

    ``positions`` maps the row count to the few wanted 0-based positions.  A
    sketch brackets the first key around each position, one pass counts the rows
    below and inside the brackets, and only rows inside are sorted.  A position
    that is not inside after all, or a first key that has no sketch, is found by
    sorting all keys.
    """
    total = df.count()
    wanted = sorted({p for p in positions(total) if 0 <= p < total})
    if not wanted:
        return total, {}
    kind = df.select(order[0]).schema[0].dataType
    out: dict[int, Row] = {}
    if isinstance(kind, _NARROWED):
        for p, (low, high, below, upto) in zip(wanted, _brackets(df, order[0], total, wanted)):
            if below <= p < upto:
                inside = df.filter((order[0] >= F.lit(low)) & (order[0] <= F.lit(high)))
                out.update({p: r for r in _at_positions(inside, order, [p - below]).values()})
    rest = [p for p in wanted if p not in out]
    return total, out | (_at_positions(df, order, rest) if rest else {})


# Rows one task may sort; beyond them the order is cut into ranges.
FEW_ROWS = 500_000


def with_running_sums(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: dict[str, str], few_rows: int = FEW_ROWS
) -> DataFrame:
    """Add inclusive running sums within each group: ``{new column: summed column}``.

    ``groups`` + ``order`` must be unique; NULL is a group of its own.  Up to
    ``few_rows`` rows in all, counted beforehand, a plain window does.
    """
    groups = list(groups)
    df = stage(df)
    if df.count() <= few_rows:
        upto = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({dst: F.sum(src).over(upto) for dst, src in sums.items()})
    rows = stage(df.repartitionByRange(*groups, *order).withColumn("_pid", F.spark_partition_id()))
    parts = rows.groupBy("_pid", *groups).agg(*[F.sum(src).alias(f"_c_{dst}") for dst, src in sums.items()])
    by_part = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_pid")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    # A partition starts with at most one group carried over from the one
    # before it, so there are fewer carries than partitions: safe to broadcast.
    carries = (
        parts.withColumn("_nth", F.row_number().over(by_part))
        .select("_pid", *groups, "_nth", *[F.sum(f"_c_{dst}").over(earlier).alias(f"_c_{dst}") for dst in sums])
        .filter("_nth > 1")
        .drop("_nth")
    )
    local = Window.partitionBy("_pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({dst: F.sum(src).over(local) for dst, src in sums.items()})
    out = join_groups(summed, F.broadcast(carries), ["_pid", *groups], "left")
    out = out.withColumns({dst: F.col(dst) + F.coalesce(f"_c_{dst}", F.lit(0)) for dst in sums})
    return out.drop("_pid", *[f"_c_{dst}" for dst in sums])


KEY_BUCKETS = 1 << 16  # groups of keys counted before the keys themselves
SEVERAL = 50_000  # below, a limit is passed by too many groups of keys for them to tell anything


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    With a large limit the rows are counted by a hash of their key first, and only keys
    of a group with more rows than the limit are counted by themselves.  A known-short
    list comes back with a broadcast hint, a longer one as a plain join side, counted once.
    """
    if limit >= SEVERAL:
        group = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
        full = [r["_g"] for r in df.groupBy(group.alias("_g")).count().filter(F.col("count") > limit).collect()]
        if not full:
            return None
        df = df.filter(group.isin(full))
    sizes = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    found = sizes.limit(BROADCAST_ROWS + 1).collect()
    if not found:
        return None
    if len(found) > BROADCAST_ROWS:
        return stage(sizes)
    return F.broadcast(df.sparkSession.createDataFrame(found, sizes.schema))
