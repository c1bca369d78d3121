"""Connected components by alternating large-star and small-star rounds.

Every round is two groupings with map-side minima and joins on the node, so a
node with very many links is an ordinary skewed join.  Each round's edges are
written to the shared checkpoint folder, which cuts the lineage and survives
lost executors; the rounds end when the edges stop changing, after O(log^2)
rounds in the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to its smallest one."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least).toDF("u", "v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``node`` and ``component`` (its smallest node) for each node but the components' smallest.

    Edges with a null end or equal ends say nothing.
    """
    ends = edges.filter((F.col(a) != F.col(b)))
    ends = stage(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        mark = ends.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark["n"] == 0 or mark == state:
            return ends.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = mark
        ends = stage(_small_star(_large_star(ends)))
