"""Classification and calibration metrics as distributed aggregates.

Inputs are long score frames: a model column (any ``by`` columns), a 0/1
``label``, a probability ``score`` and, where needed, a 0/1 ``prediction``.
All models are evaluated by one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import with_running_sums
from .staging import stage

CLASS_METRICS = ("accuracy", "precision", "recall", "f1_score")
PROBA_METRICS = ("pr_auc", "roc_auc", "brier", "ece")


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den, ``empty`` when the denominator is 0."""
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(empty).cast("double"))


def _confusion(label: str, prediction: str) -> dict[str, Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    cells = {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}
    return {k: F.count_if(v) for k, v in cells.items()}


def _class_scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn, None),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
    }


def class_metrics(df: DataFrame, by: Sequence[str] = ("model",), label="label", prediction="prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 per group; 0 where a ratio has no denominator."""
    counts = df.groupBy(*by).agg(*[c.alias(k) for k, c in _confusion(label, prediction).items()])
    scores = _class_scores(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select(*by, *[v.alias(k) for k, v in scores.items()])


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), label="label", prediction="prediction") -> DataFrame:
    """All four cells per group, those without rows too."""
    counts = df.groupBy(*by).agg(*[c.alias(k) for k, c in _confusion(label, prediction).items()])
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    rows = [F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.col(k).alias("n")) for k, (y, p) in cells.items()]
    return counts.select(*by, F.explode(F.array(*rows)).alias("_c")).select(*by, "_c.*")


def brier_score(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    gap = F.col("score") - F.col("label")
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def probability_bin(score: Column, n_bins: int = 10) -> Column:
    """Bin of a probability among equal-width bins [e_i, e_i+1); exactly 1.0 gives ``n_bins``.

    The edges are the doubles i * (1 / n_bins), so 0.3 lies below the edge
    0.30000000000000004 and belongs to bin 2.  The arithmetic guess is corrected
    against the edges on both sides.
    """
    step = 1.0 / n_bins
    guess = F.least(F.greatest(F.floor(score * n_bins), F.lit(0)), F.lit(n_bins)).cast("int")

    def edge(i: Column) -> Column:
        return F.when(i >= n_bins, F.lit(1.0)).otherwise(i * F.lit(step))

    up = (guess < n_bins) & (score >= edge(guess + 1))
    down = (guess > 0) & (score < edge(guess))
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def reliability_bins(df: DataFrame, by: Sequence[str] = ("model",), n_bins: int = 10) -> DataFrame:
    """Rows, observed rate and mean probability per bin; scores of exactly 1.0 are in bin ``n_bins``."""
    return df.groupBy(*by, probability_bin(F.col("score"), n_bins).alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(F.col("label").cast("double")).alias("accuracy"),
        F.avg("score").alias("confidence"),
    )


def calibration_error(
    df: DataFrame, by: Sequence[str] = ("model",), n_bins: int = 10, exclude_one: bool = True
) -> DataFrame:
    """Expected calibration error.

    By default scores of exactly 1.0 count in the denominator but not in the
    sum; ``exclude_one=False`` puts them into the last bin.
    """
    in_bin = df
    if not exclude_one:
        top = F.lit(1.0 - 0.5 / n_bins)
        in_bin = df.withColumn("_bin", probability_bin(F.when(F.col("score") >= 1.0, top).otherwise(F.col("score")), n_bins))
    else:
        in_bin = df.withColumn("_bin", probability_bin(F.col("score"), n_bins))
    bins = in_bin.groupBy(*by, "_bin").agg(
        F.count("*").alias("_n"), F.sum(F.col("label").cast("double")).alias("_y"), F.sum("score").alias("_p")
    )
    gap = F.when(F.col("_bin") < n_bins, F.abs(F.col("_y") - F.col("_p"))).otherwise(0.0)
    return bins.groupBy(*by).agg((F.sum(gap) / F.sum("_n")).alias("ece"))


def score_steps(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Positives and negatives per distinct score, counted map-side: all the metrics need."""
    y = F.col("label") == 1
    return df.groupBy(*by, "score").agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def _ranked_steps(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Steps with the positives (``tp``) and negatives (``fp``) at or above each score.

    The running sums are cut into ranges, so a model with billions of distinct
    scores is not sorted in one task.
    """
    return with_running_sums(steps, by, [F.col("score").desc()], {"tp": "pos", "fp": "neg"})


def _step_sums() -> dict[str, Column]:
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    return {
        "_ap": F.sum(pos * tp / (tp + fp)),
        "_area": F.sum(neg * (tp - pos / 2)),
        "_pos": F.sum(pos),
        "_neg": F.sum(neg),
    }


def _areas(ap: Column, area: Column, pos: Column, neg: Column) -> dict[str, Column]:
    """NULL where a class is missing."""
    return {"pr_auc": ratio(ap, pos, None), "roc_auc": ratio(area, pos * neg, None)}


def ranking_metrics(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Average precision (step sum) and area under the ROC curve (ties as one step).

    With one class only the result is NULL.
    """
    sums = _ranked_steps(score_steps(df, by), by).groupBy(*by).agg(*[v.alias(k) for k, v in _step_sums().items()])
    areas = _areas(*[F.col(c) for c in ("_ap", "_area", "_pos", "_neg")])
    return sums.select(*by, *[v.alias(k) for k, v in areas.items()])


def evaluate_scores(df: DataFrame, by: Sequence[str] = ("model",), cut: float = 0.5) -> DataFrame:
    """All metrics of every model, one row per group; the class prediction is ``score > cut``.

    The scores are read once: every metric follows from the counts per distinct score.
    """
    by = list(by)
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("score")
    called = score > F.lit(float(cut))
    bins = _ranked_steps(score_steps(df, by), by).groupBy(*by, probability_bin(score).alias("_bin")).agg(
        *[v.alias(k) for k, v in _step_sums().items()],
        F.sum(F.when(called, pos).otherwise(0)).alias("_tp"),
        F.sum(F.when(called, neg).otherwise(0)).alias("_fp"),
        F.sum(pos * (score - 1) * (score - 1) + neg * score * score).alias("_sq"),
        F.sum(score * (pos + neg)).alias("_p"),
    )
    miss = F.when(F.col("_bin") < 10, F.abs(F.col("_pos") - F.col("_p"))).otherwise(0.0)
    sums = {c: F.sum(c) for c in ("_ap", "_area", "_pos", "_neg", "_tp", "_fp")}
    tp, fp, p, n = sums["_tp"], sums["_fp"], sums["_pos"], sums["_neg"]
    out = {
        **_class_scores(tp, fp, p - tp, n - fp),
        **_areas(sums["_ap"], sums["_area"], p, n),
        "brier": F.sum("_sq") / (p + n),
        "ece": F.sum(miss) / (p + n),
    }
    return bins.groupBy(*by).agg(*[out[c].alias(c) for c in (*CLASS_METRICS, *PROBA_METRICS)])


def long_metrics(wide: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by..., metric, value) rows of a wide metric frame."""
    names = [c for c in wide.columns if c not in by]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return wide.select(*by, F.explode(cells).alias("_m")).select(*by, "_m.metric", "_m.value")


def rolling_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and population std over folds per (model, metric)."""
    return fold_metrics.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std")
    )


def comparison_table(metrics: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Model rows plus the rule baseline, which has no probability metrics."""
    if baseline is not None:
        metrics = metrics.unionByName(baseline, allowMissingColumns=True)
    return metrics.select("model", *[c for c in (*CLASS_METRICS, *PROBA_METRICS) if c in metrics.columns])


def quality_band(f1: Column) -> Column:
    """good above 0.7, moderate above 0.5, else poor."""
    return F.when(f1 > 0.7, "good").when(f1 > 0.5, "moderate").otherwise("poor")


def prediction_accuracy(df: DataFrame, label="is_skewed", prediction="predicted_skew") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


# ---------------------------------------------------------- threshold sweeps


def passed_cuts(value: Column, low: Column, step: Column, top: Column, last: int, inclusive: bool) -> Column:
    """How many of the cuts low + i * step (i = 0..last, the last being ``top``) a value passes.

    The arithmetic guess is corrected against the exact double cuts.
    """
    raw = F.when(step > 0, F.floor((value - low) / F.when(step > 0, step))).otherwise(F.lit(0))
    guess = F.least(F.greatest(raw, F.lit(-1)), F.lit(last)).cast("int")

    def passes(i: Column) -> Column:
        cut = F.when(i >= last, top).otherwise(i * step + low)
        return value >= cut if inclusive else value > cut

    # The largest passed cut is next to the guess; cuts grow with i.
    best = F.lit(0)
    for shift in (-2, -1, 0, 1, 2):
        i = guess + shift
        best = F.when((i >= 0) & (i <= last) & passes(i), i + 1).otherwise(best)
    flat = F.when(value >= top if inclusive else value > top, F.lit(last + 1)).otherwise(F.lit(0))
    return F.when(step > 0, best).otherwise(flat)


def sweep_counts(cells: DataFrame, by: Sequence[str], n_cuts: int) -> DataFrame:
    """tp/fp/fn/tn per cut out of (by..., passed, pos, neg) cells.

    There are at most ``n_cuts + 1`` aggregated cells per group.  A cell also
    stands for the cuts since the cell before it, which nobody stops at.
    """
    group = Window.partitionBy(*(by or [F.lit(0)]))
    up = group.orderBy("passed")
    after = group.orderBy(F.col("passed").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumns(
        {
            "_from": F.lag("passed", 1, 0).over(up),
            "_last": F.lead("passed").over(up).isNull(),
            "_tp": F.sum("pos").over(after),
            "_fp": F.sum("neg").over(after),
            "_p": F.sum("pos").over(group),
            "_n": F.sum("neg").over(group),
        }
    )
    end = F.when(F.col("_last"), F.lit(n_cuts)).otherwise(F.col("passed")) - 1
    cuts = F.when(end >= F.col("_from"), F.sequence(F.col("_from"), end))
    run = run.withColumn("cut", F.explode(cuts))
    reached = F.col("cut") < F.col("passed")
    tp, fp = F.when(reached, F.col("_tp")).otherwise(0), F.when(reached, F.col("_fp")).otherwise(0)
    return run.select(
        *by, "cut", tp.alias("tp"), fp.alias("fp"), (F.col("_p") - tp).alias("fn"), (F.col("_n") - fp).alias("tn")
    )


def _sweep_steps(steps: DataFrame, by: list[str], n: int) -> DataFrame:
    passed = passed_cuts(F.col("score"), F.lit(0.0), F.lit(1.0 / n), F.lit(1.0), n, inclusive=True)
    cells = steps.groupBy(*by, passed.alias("passed")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    swept = sweep_counts(cells, by, n + 1)
    threshold = F.when(F.col("cut") >= n, F.lit(1.0)).otherwise(F.col("cut") * F.lit(1.0 / n))
    scores = _class_scores(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return swept.select(*by, threshold.alias("threshold"), "tp", "fp", "fn", "tn", *[scores[m].alias(m) for m in CLASS_METRICS])


def threshold_sweep(df: DataFrame, by: Sequence[str] = ("model",), steps: int = 100) -> DataFrame:
    """tp/fp/fn/tn, precision, recall and F1 for every cut i/steps, predicting where score >= cut.

    Rows are counted per cut interval map-side; only those counts are shuffled.
    """
    y = F.col("label") == 1
    rows = df.select(*by, "score", y.cast("int").alias("pos"), (~y).cast("int").alias("neg"))
    return _sweep_steps(rows, list(by), steps)


def best_thresholds(df: DataFrame, by: Sequence[str] = ("model",), steps: int = 100, min_recall: float = 0.8) -> DataFrame:
    """Per model: AP and ROC area, the best-F1 cut, and the best-F1 cut that keeps recall at ``min_recall``.

    The first cut wins a tie for best F1, the highest cut a tie under the recall bound.
    """
    by = list(by)
    counts = stage(score_steps(df, by))
    swept = _sweep_steps(counts, by, steps)
    row = F.struct("threshold", "f1_score", "precision", "recall")
    first = F.struct(F.col("f1_score"), -F.col("threshold"))
    enough = F.col("recall") >= min_recall
    kept = F.when(enough, F.struct(F.col("f1_score"), F.col("threshold")))
    picked = swept.groupBy(*by).agg(F.max_by(row, first).alias("a"), F.max_by(row, kept).alias("b"))
    flat = picked.select(
        *by,
        F.col("a.threshold").alias("best_f1_threshold"),
        F.col("a.f1_score").alias("best_f1"),
        F.col("a.precision").alias("precision_at_best_f1"),
        F.col("a.recall").alias("recall_at_best_f1"),
        F.col("b.threshold").alias("threshold_recall_ge"),
        F.col("b.precision").alias("precision_recall_ge"),
        F.col("b.recall").alias("recall_recall_ge"),
        F.col("b.f1_score").alias("f1_recall_ge"),
    )
    sums = _ranked_steps(counts, by).groupBy(*by).agg(*[v.alias(k) for k, v in _step_sums().items()])
    areas = _areas(*[F.col(c) for c in ("_ap", "_area", "_pos", "_neg")])
    return sums.select(*by, *[v.alias(k) for k, v in areas.items()]).join(flat, by)
