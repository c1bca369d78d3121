"""Exact interpolated quantiles of columns of any cardinality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.coerce import number
from .staging import stage


# Distinct values one task may hold; beyond them the values are cut into ranges.
FEW_VALUES = 500_000


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of one name in which NULL equals NULL."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), few_values: int = FEW_VALUES
) -> DataFrame:
    """Long frame (by..., column, prob, value) with linear interpolation; NULLs are ignored.

    Equal values are counted map-side first and range-partitioned; only the
    partitions in which a wanted rank falls are sorted.  When a count shows that
    few distinct values are left, each group is one range.
    """
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("value")) for c in columns])
    long = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.column", "_p.value")
    keys = [*by, "column"]
    counted = long.filter(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("cnt"))
    counted = stage(counted)
    if counted.count() <= few_values:
        # One range per group: the same ranks and the same interpolation as below.
        cells = counted.withColumn("_pid", F.lit(0))
    else:
        cells = stage(counted.repartitionByRange(*keys, "value").withColumn("_pid", F.spark_partition_id()))

    group = Window.partitionBy(*keys)
    parts = cells.groupBy(*keys, "_pid").agg(F.sum("cnt").alias("part"))
    parts = parts.withColumns(
        {
            "before": F.coalesce(
                F.sum("part").over(group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "n": F.sum("part").over(group),
        }
    )
    wanted = parts.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    wanted = wanted.withColumn("pos", (F.col("n") - 1) * F.col("prob"))
    wanted = wanted.withColumn("want", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
    hits = wanted.filter("want >= before AND want < before + part").select(*keys, "_pid", "prob", "pos", "want", "before")
    # Without groups there are at most 2 * columns * probabilities hits.  With
    # groups the join strategy is left to the sizes seen at run time.
    hits = hits if by else F.broadcast(hits)

    in_part = Window.partitionBy(*keys, "prob", "want").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    seen = join_groups(cells, hits, [*keys, "_pid"]).withColumn("upto", F.sum("cnt").over(in_part) + F.col("before"))
    ends = (
        seen.filter("upto > want AND upto - cnt <= want")
        .groupBy(*keys, "prob", "pos")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))
    return ends.select(*keys, "prob", value.alias("value"))


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles as plain numbers, per column in the order of ``probs``; all-NULL columns are left out."""
    rows = exact_quantiles(df, columns, probs).collect()
    found = {(r["column"], r["prob"]): r["value"] for r in rows}
    return {c: [found[c, float(p)] for p in probs] for c in columns if (c, float(probs[0])) in found}


def approx_medians(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> dict[str, float]:
    """Mergeable-sketch medians: one pass, no ordering, not interpolated."""
    row = df.agg(*[F.percentile_approx(number(df, c), 0.5, accuracy).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}
