"""Thresholds, confidence bands and recommendations as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Default decision cut per model.
DEFAULT_THRESHOLDS = {
    "logistic_regression": 0.10,
    "random_forest": 0.08,
    "xgboost": 0.07,
    "lightgbm": 0.23,
}
FALLBACK_THRESHOLD = 0.5

# Distances from the cut where confidence turns medium and high.
CONFIDENCE_BANDS = {
    "logistic_regression": (0.03, 0.08),
    "random_forest": (0.025, 0.07),
    "xgboost": (0.025, 0.07),
    "lightgbm": (0.04, 0.10),
}
FALLBACK_BANDS = (0.03, 0.08)
CERTAIN_LOW, CERTAIN_HIGH = 0.02, 0.98

MODELS = tuple(DEFAULT_THRESHOLDS)

# Recommendation texts.
RECOMMENDATIONS = {
    "high": "HIGH RISK: Job likely to be skewed. Consider increasing parallelism or enabling skew handling.",
    "moderate": "MODERATE RISK: Job may be skewed. Monitor closely during execution.",
    "low": "LOW RISK: Job appears balanced. Normal execution expected.",
    "low_moderate": "LOW-MODERATE RISK: Job likely balanced but monitor for unexpected skew.",
}


def resolve_threshold(model: str, threshold: float | None = None) -> float:
    """An explicit cut wins over the model's default; unknown models use 0.5."""
    return float(DEFAULT_THRESHOLDS.get(model, FALLBACK_THRESHOLD) if threshold is None else threshold)


def _lookup(model: Column, table: dict[str, float], fallback: float) -> Column:
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in table.items()))
    return F.coalesce(F.try_element_at(pairs, model), F.lit(float(fallback)))


def threshold_of(model: Column) -> Column:
    """Default cut of the model named in a column."""
    return _lookup(model, DEFAULT_THRESHOLDS, FALLBACK_THRESHOLD)


def confidence(probability: Column, threshold: Column, model: Column) -> Column:
    """low / medium / high by the distance from the cut; near 0 or 1 always high."""
    low = _lookup(model, {k: v[0] for k, v in CONFIDENCE_BANDS.items()}, FALLBACK_BANDS[0])
    high = _lookup(model, {k: v[1] for k, v in CONFIDENCE_BANDS.items()}, FALLBACK_BANDS[1])
    margin = F.abs(probability - threshold)
    certain = (probability <= CERTAIN_LOW) | (probability >= CERTAIN_HIGH)
    return F.when(certain | (margin >= high), "high").when(margin >= low, "medium").otherwise("low")


def recommendation(prediction: Column, probability: Column) -> Column:
    skewed = F.when(probability > 0.8, RECOMMENDATIONS["high"]).otherwise(RECOMMENDATIONS["moderate"])
    balanced = F.when(probability < 0.2, RECOMMENDATIONS["low"]).otherwise(RECOMMENDATIONS["low_moderate"])
    return F.when(prediction == 1, skewed).otherwise(balanced)


def tertile_band(rank_share: Column) -> Column:
    return F.when(rank_share <= 1.0 / 3.0, "low").when(rank_share <= 2.0 / 3.0, "medium").otherwise("high")
