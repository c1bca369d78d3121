"""Score tables: predictions, long model scores and history-relative confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import number
from ..functions.scoring import confidence, recommendation, resolve_threshold, tertile_band, threshold_of
from ..schemas import require_columns
from .ordered import keys_at


def add_predictions(scored: DataFrame, model: str, threshold: float | None = None) -> DataFrame:
    """Turn ``skew_probability`` into the prediction columns."""
    cut = F.lit(resolve_threshold(model, threshold))
    p = F.col("skew_probability")
    return scored.withColumns(
        {
            "predicted_skew": (p >= cut).cast("int"),
            "threshold_used": cut,
            "prediction_confidence": confidence(p, cut, F.lit(model)),
        }
    )


def add_predictions_by_model(scores: DataFrame) -> DataFrame:
    """The same for a long frame with a ``model`` column, each with its default cut."""
    p, cut = F.col("skew_probability"), threshold_of(F.col("model"))
    return scores.withColumns(
        {
            "predicted_skew": (p >= cut).cast("int"),
            "threshold_used": cut,
            "prediction_confidence": confidence(p, cut, F.col("model")),
        }
    )


def score_report(predicted: DataFrame) -> DataFrame:
    """One row per job: the call, its probability and cut, the confidence and what to do."""
    pred = F.col("predicted_skew")
    return predicted.select(
        *(["model"] if "model" in predicted.columns else []),
        "job_id",
        pred.alias("prediction"),
        "skew_probability",
        (pred == 1).alias("is_skewed"),
        "threshold_used",
        F.col("prediction_confidence").alias("confidence"),
        recommendation(pred, F.col("skew_probability")).alias("recommendation"),
    )


# Weight of each min-max scaled column beside 0.60 * probability.
HISTORY_WEIGHTS = {
    "num_tasks": 0.15,
    "priority": 0.10,
    "cpu_request_std": 0.05,
    "memory_request_std": 0.05,
    "disk_space_request_std": 0.05,
}
PROBABILITY_WEIGHT = 0.60


#: (least, largest) value of each weighted column.
Limits = dict[str, tuple[float, float]]


def _weighted(rows: DataFrame) -> dict[str, Column]:
    return {c: F.coalesce(number(rows, c), F.lit(0.0)) for c in HISTORY_WEIGHTS if c in rows.columns}


def history_limits(rows: DataFrame) -> Limits:
    """Limits of the weighted columns over all ``rows``; empty without rows."""
    value = _weighted(rows)
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[x for c, v in value.items() for x in (F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}"))]).first()
    return {c: (found[f"min_{c}"], found[f"max_{c}"]) for c in value} if found["n"] else {}


def demo_score(rows: DataFrame, limits: Limits) -> Column:
    """The probability mixed with submit features scaled between their limits."""
    score = F.coalesce(number(rows, "skew_probability"), F.lit(0.0)) * PROBABILITY_WEIGHT
    for c, v in _weighted(rows).items():
        low, high = limits.get(c, (0.0, 0.0))
        if high > low:
            score = score + (v - F.lit(low)) / F.lit(high - low) * HISTORY_WEIGHTS[c]
    return score


def history_score(rows: DataFrame) -> DataFrame:
    """Add ``demo_score``, its limits taken over all ``rows``."""
    return rows.withColumn("demo_score", demo_score(rows, history_limits(rows)))


def band_ends(n: int) -> tuple[int, int]:
    """Last 0-based positions of the bands low and medium among n rows, -1 for an empty band."""
    # rank / n <= share holds for the first positions only.
    near = ([p for p in range(int(n * s) - 1, int(n * s) + 2) if p >= 0 and (p + 1) / n <= s] if n else [] for s in (1 / 3, 2 / 3))
    low, medium = (max(found, default=-1) for found in near)
    return low, medium


def history_confidence(new: DataFrame, history: DataFrame | None = None, arrival: Sequence[str] = ("job_id",)) -> DataFrame:
    """Replace ``prediction_confidence`` of new rows by their tertile among history and new rows.

    Ties rank by arrival: history before new rows, then the ``arrival`` columns,
    which must make a new row unique.  Only the two tertile cuts
    are looked up; no row is ranked one by one.
    """
    require_columns(new, ["skew_probability", *arrival], "predictions")
    names = ["skew_probability", *[c for c in HISTORY_WEIGHTS if c in new.columns], *arrival]
    both = new.withColumn("_new", F.lit(1))
    if history is not None and "skew_probability" in history.columns:
        past = history.select(*[c for c in names if c in history.columns]).withColumn("_new", F.lit(0))
        both = both.unionByName(past, allowMissingColumns=True)
    scored = history_score(both)
    order = ["demo_score", "_new", *arrival]

    n, rows = keys_at(scored.select(*order), [F.col(c) for c in order], band_ends)
    band = F.lit("high")
    key = F.struct(*order)
    for name, at in zip(("medium", "low"), reversed(band_ends(n))):
        if at in rows:
            cut = F.struct(*[F.lit(rows[at][c]).cast(scored.schema[c].dataType).alias(c) for c in order])
            band = F.when(key <= cut, name).otherwise(band)
    return scored.filter("_new = 1").withColumn("prediction_confidence", band).drop("_new", "demo_score")
