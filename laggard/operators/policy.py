"""Impact of mitigating the jobs a model flags, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import resolve_threshold, threshold_of
from ..schemas import require_columns
from .metrics import ratio

SKEW_REDUCTION, OVERHEAD = 0.3, 0.05


def _impact(rows: DataFrame, by: list[str], skew_reduction: float, overhead: float) -> DataFrame:
    """``rows`` carry ``mitigate``; the longest task's runtime stands for the job's duration."""
    require_columns(rows, ["max_task_runtime", "is_skewed", "skew_probability"], "scored jobs")
    skewed = F.coalesce(F.col("is_skewed") == 1, F.lit(False))
    mitigate, cost = F.col("mitigate"), F.col("max_task_runtime").cast("double")
    adjusted = (
        F.when(mitigate & skewed, cost * (1 - skew_reduction)).when(mitigate, cost * (1 + overhead)).otherwise(cost)
    )
    base, after = F.coalesce(F.sum(cost), F.lit(0.0)), F.coalesce(F.sum(adjusted), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("jobs"),
        F.count_if(mitigate).alias("mitigations"),
        F.count_if(skewed).alias("true_skewed"),
        F.count_if(skewed & mitigate).alias("true_mitigated"),
        F.count_if(~skewed & mitigate).alias("false_mitigated"),
        base.alias("baseline_total"),
        after.alias("adjusted_total"),
        ratio(base - after, base).alias("relative_improvement"),
    )


def policy_impact(
    scored: DataFrame,
    model: str,
    threshold: float | None = None,
    skew_reduction: float = SKEW_REDUCTION,
    overhead: float = OVERHEAD,
) -> DataFrame:
    """Totals when every job at or above the cut is mitigated; one row.

    Mitigation shortens truly skewed jobs and burdens the others.
    """
    flagged = F.coalesce(F.col("skew_probability") >= resolve_threshold(model, threshold), F.lit(False))
    return _impact(scored.withColumn("mitigate", flagged), [], skew_reduction, overhead)


def compare_policies(scores: DataFrame, skew_reduction: float = SKEW_REDUCTION, overhead: float = OVERHEAD) -> DataFrame:
    """Impact per model of a long score frame at the models' default cuts, best first."""
    cut = threshold_of(F.col("model"))
    rows = scores.withColumns(
        {"threshold": cut, "mitigate": F.coalesce(F.col("skew_probability") >= cut, F.lit(False))}
    )
    out = _impact(rows, ["model", "threshold"], skew_reduction, overhead)
    at_least_one = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1)
    return out.withColumns(
        {
            "mitigation_rate": F.col("mitigations") / F.col("jobs"),
            "precision_mitigation": F.col("true_mitigated") / at_least_one("mitigations"),
            "recall_on_skew": F.col("true_mitigated") / at_least_one("true_skewed"),
        }
    ).orderBy(F.col("relative_improvement").desc(), "model")
