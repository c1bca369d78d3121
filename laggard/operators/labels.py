"""Skew labels from task runtimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import number
from ..schemas import require_columns

SKEW_MULTIPLIER = 2.0


def job_runtime_stats(task_runtimes: DataFrame) -> DataFrame:
    """Mean, maximum and sample standard deviation (0 for one task) of positive runtimes per job."""
    require_columns(task_runtimes, ["job_id", "runtime"], "task runtimes")
    rows = task_runtimes.select("job_id", number(task_runtimes, "runtime").alias("runtime"))
    return rows.filter("runtime > 0 AND job_id IS NOT NULL").groupBy("job_id").agg(
        F.avg("runtime").alias("avg_task_runtime"),
        F.max("runtime").alias("max_task_runtime"),
        F.coalesce(F.stddev_samp("runtime"), F.lit(0.0)).alias("std_task_runtime"),
    )


def skew_flag(multiplier: float = SKEW_MULTIPLIER) -> Column:
    """1 when the slowest task takes at least ``multiplier`` times the mean, else 0."""
    slow = F.col("max_task_runtime") >= F.lit(multiplier) * F.col("avg_task_runtime")
    return F.coalesce(slow, F.lit(False)).cast("int")


def label_jobs(stats: DataFrame, multiplier: float = SKEW_MULTIPLIER) -> DataFrame:
    require_columns(stats, ["avg_task_runtime", "max_task_runtime"], "job statistics")
    return stats.withColumn("is_skewed", skew_flag(multiplier))


def label_from_runtimes(task_runtimes: DataFrame) -> DataFrame:
    return label_jobs(job_runtime_stats(task_runtimes))


def label_distribution(jobs: DataFrame) -> DataFrame:
    """Count and percentage per label; both labels appear even when empty."""
    row = jobs.agg(F.count("*").alias("n"), F.count_if(F.col("is_skewed") == 1).alias("pos"))
    parts = F.array(
        F.struct(F.lit(0).alias("is_skewed"), (F.col("n") - F.col("pos")).alias("jobs")),
        F.struct(F.lit(1).alias("is_skewed"), F.col("pos").alias("jobs")),
    )
    out = row.select("n", F.explode(parts).alias("p")).filter("n > 0")
    return out.select("p.is_skewed", "p.jobs", F.round(100.0 * F.col("p.jobs") / F.col("n"), 6).alias("pct"))


def skew_statistics(jobs: DataFrame) -> DataFrame:
    """Totals, skew ratio and mean of the longest runtime per class (0 for an empty class); one row."""
    require_columns(jobs, ["is_skewed", "max_task_runtime"], "job table")
    label, longest = F.col("is_skewed"), F.col("max_task_runtime")

    def class_mean(value: int) -> Column:
        return F.coalesce(F.avg(F.when(label == value, longest)), F.lit(0.0))

    return jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(label == 1).alias("skewed_jobs"),
        F.count_if(label == 0).alias("non_skewed_jobs"),
        F.avg(label.cast("double")).alias("skew_ratio"),
        class_mean(1).alias("avg_max_runtime_skewed"),
        class_mean(0).alias("avg_max_runtime_non_skewed"),
    )


def multiplier_sweep(stats: DataFrame, multipliers=(1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0)) -> DataFrame:
    """Skewed jobs and their share at several multipliers, in one pass over the jobs."""
    row = stats.agg(
        F.count("*").alias("n"), *[F.sum(skew_flag(m)).alias(f"m{i}") for i, m in enumerate(multipliers)]
    )
    cells = F.array(
        *[F.struct(F.lit(float(m)).alias("multiplier"), F.col(f"m{i}").alias("jobs")) for i, m in enumerate(multipliers)]
    )
    out = row.select("n", F.explode(cells).alias("c")).filter("n > 0")
    return out.select(
        "c.multiplier", F.col("c.jobs").alias("skewed_jobs"), (F.col("c.jobs") / F.col("n")).alias("skew_share")
    )


def distinct_jobs(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("job_id").alias("jobs"))
