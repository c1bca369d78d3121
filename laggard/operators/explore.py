"""Exploratory summaries: the tables behind describe, histogram, box and correlation plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.coerce import number
from ..schemas import PRE_EXEC_FEATURES
from .quantiles import exact_quantiles, join_groups
from .staging import stage

CORRELATED = (
    "num_tasks",
    "avg_task_runtime",
    "max_task_runtime",
    "std_task_runtime",
    "scheduling_class",
    "priority",
    "is_skewed",
)
QUARTILES = (0.25, 0.5, 0.75)


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str], make) -> DataFrame:
    """Unpivot aggregates: ``make(column name)`` gives {field: aggregate}; one pass over the rows."""
    aggs = {c: make(c) for c in columns}
    flat = df.groupBy(*by).agg(*[v.alias(f"{c}:{k}") for c, fields in aggs.items() for k, v in fields.items()])
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}:{k}`").alias(k) for k in fields]) for c, fields in aggs.items()
    ]
    return flat.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per column (and group), long by column."""
    by = list(by)

    def moments(c):
        x = number(df, c)
        return {
            "count": F.count(x),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "max": F.max(x),
        }

    basics = _cells(df, columns, by, moments)
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    q = exact_quantiles(df, columns, QUARTILES, by)
    quartiles = q.groupBy(*by, "column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()])
    return join_groups(basics, quartiles, [*by, "column"], "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, by: str, bins: int = 50) -> DataFrame:
    """Density histogram whose ``bins`` equal bins span each group's own range; empty bins have 0 rows.

    Bin i holds what is at or above edge i and below the next edge, the last
    bin its upper edge too; the edges are ``lo + i * width``.  Equal values are
    counted first, so that what joins the groups' ranges is distinct values.
    """
    rows = df.select(F.col(by).alias("_g"), number(df, column).alias("_x")).filter("_x IS NOT NULL AND _g IS NOT NULL")
    seen = rows.groupBy("_g", "_x").agg(F.count("*").alias("m"))
    limits = rows.groupBy("_g").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("total"))
    flat = F.col("hi") <= F.col("lo")
    limits = limits.select(
        "_g", "total",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.lit(1.0 / bins)).otherwise((F.col("hi") - F.col("lo")) / bins).alias("width"),
    )
    edge = lambda i: F.col("lo") + i * F.col("width")
    guess = F.greatest(F.lit(0), F.least(F.floor((F.col("_x") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).cast("int")
    nth = F.when((guess < bins - 1) & (F.col("_x") >= edge(guess + 1)), guess + 1).when((guess > 0) & (F.col("_x") < edge(guess)), guess - 1).otherwise(guess)
    counted = seen.join(limits, "_g").groupBy("_g", nth.alias("bin")).agg(F.sum("m").alias("n"))
    every = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return every.join(counted, ["_g", "bin"], "left").select(
        F.col("_g").alias(by), "bin", edge(F.col("bin")).alias("left"), n.alias("n"), (n / (F.col("total") * F.col("width"))).alias("density")
    )


def correlations(df: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """Pearson correlation of every pair of columns, both orders and the diagonal, long form."""
    x = {c: number(df, c) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(x[a], x[b]).alias(f"{a}:{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.col(f"`{a}:{b}`").alias("corr")))
    out = row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def label_correlations(df: DataFrame, features: Sequence[str] = PRE_EXEC_FEATURES, label: str = "is_skewed") -> DataFrame:
    """Correlation of each feature with the label, one pass."""
    names = [c for c in features if c in df.columns]
    y = number(df, label)
    out = _cells(df, names, [], lambda c: {"corr": F.corr(number(df, c), y)})
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr"))).withColumnRenamed("column", "feature")


def box_stats(df: DataFrame, columns: Sequence[str], by: str = "is_skewed") -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outlier count per column and group."""
    q = exact_quantiles(df, columns, QUARTILES, [by])
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    box = q.groupBy(by, "column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()])
    box = stage(box)
    reach = box.withColumns({"_lo": F.expr("q1 - 1.5 * (q3 - q1)"), "_hi": F.expr("q3 + 1.5 * (q3 - q1)")})
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("x")) for c in columns])
    rows = df.select(by, F.explode(pairs).alias("_p")).select(by, "_p.column", "_p.x").filter("x IS NOT NULL")
    # Equal values are counted first, so the join sees distinct values only and
    # never a group's raw rows.
    seen = rows.groupBy(by, "column", "x").agg(F.count("*").alias("m"))
    seen = join_groups(seen, reach, [by, "column"])
    inside = (F.col("x") >= F.col("_lo")) & (F.col("x") <= F.col("_hi"))
    ends = seen.groupBy(by, "column").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("m"))).alias("outliers"),
    )
    return join_groups(box, ends, [by, "column"])


def avg_max_points(jobs: DataFrame) -> DataFrame:
    """Mean against longest runtime of every job, and their ratio (2 is the skew line)."""
    return jobs.select(
        "job_id",
        "is_skewed",
        "avg_task_runtime",
        "max_task_runtime",
        F.when(F.col("avg_task_runtime") > 0, F.col("max_task_runtime") / F.col("avg_task_runtime")).alias("max_over_avg"),
    )


def shape(df: DataFrame) -> DataFrame:
    """Row and column count, and non-NULL values per column; long form, one pass."""
    counts = _cells(df, df.columns, [], lambda c: {"non_null": F.count(F.col(c)), "rows": F.count("*")})
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return counts.withColumns({"type": F.element_at(kinds, F.col("column")), "columns": F.lit(len(df.columns))})
