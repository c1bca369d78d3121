"""Fitting, calibration and persistence of the classifiers, on MLlib."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scoring import MODELS
from ..schemas import feature_columns
from .features import training_frame
from .metrics import class_metrics, evaluate_scores, long_metrics, rolling_summary
from .scoring import add_predictions
from .smote import balance_classes
from .splits import calibration_holdout, stratified_folds


def side_by_side(spark: SparkSession, work: Sequence[Callable[[], object]], at_once: int | None = None) -> list:
    """Results of functions that each run Spark jobs, run at the same time.

    A boosted fit is hundreds of short jobs in a row; several fits together fill
    the cores that one leaves idle.  With ``spark.scheduler.mode`` FAIR no fit
    waits for all jobs of another.  The first error is raised when all are done.
    """
    if not work:
        return []
    with ThreadPoolExecutor(at_once or len(work)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(one)) for one in work]
    return [one.result() for one in started]


@dataclass
class SkewModel:
    """A fitted classifier with an optional isotonic or sigmoid calibration of its score."""

    name: str
    pipeline: PipelineModel
    calibration: IsotonicRegressionModel | LogisticRegressionModel | None = None
    mode: str = "pre_exec"

    @property
    def classifier(self):
        return self.pipeline.stages[-1]

    def add_score(self, framed: DataFrame, column: str) -> DataFrame:
        """Add the calibrated probability of a frame with ``features``, and nothing else."""
        before = framed.columns
        scored = self.pipeline.transform(framed).withColumn("_raw", _raw_score(self.name))
        if isinstance(self.calibration, LogisticRegressionModel):
            slope, shift = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
            p = 1 / (1 + F.exp(-(F.col("_raw") * slope + shift)))
        elif self.calibration is not None:
            scored = self.calibration.transform(scored)
            p = F.least(F.greatest(F.col("_calibrated"), F.lit(0.0)), F.lit(1.0))
        else:
            p = vector_to_array("probability")[1]
        return scored.select(*before, p.alias(column))

    def score(self, jobs: DataFrame) -> DataFrame:
        """Add ``skew_probability`` to a job table."""
        return self.add_score(_framed(jobs, self.mode), "_p").select("_row.*", F.col("_p").alias("skew_probability"))

    def predict(self, jobs: DataFrame, threshold: float | None = None) -> DataFrame:
        """Score a job table and add the prediction columns."""
        return add_predictions(self.score(jobs), self.name, threshold)


def _framed(jobs: DataFrame, mode: str) -> DataFrame:
    """Whole rows as ``_row`` beside their ``features``."""
    framed = training_frame(jobs.select(F.struct("*").alias("_row"), "*"), mode, keep=["_row"])
    return framed.select("_row", "features")


def _raw_score(name: str):
    """What gets calibrated: the margin of the linear model, the probability of the trees."""
    return vector_to_array("rawPrediction" if name == "logistic_regression" else "probability")[1]


def class_weights(frame: DataFrame) -> tuple[DataFrame, float, float]:
    """Balanced ``weight`` column (n / 2 n_class), the neg/pos ratio (1 without positives) and the weight sum."""
    row = frame.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos")).first()
    n, pos = row["n"], row["pos"]
    neg = n - pos
    w1 = n / (2.0 * pos) if pos else 1.0
    w0 = n / (2.0 * neg) if neg else 1.0
    weighted = frame.withColumn("weight", F.when(F.col("label") == 1, F.lit(w1)).otherwise(F.lit(w0)))
    return weighted, (neg / pos if pos else 1.0), w1 * pos + w0 * neg


def estimator(name: str, weight_sum: float, rounds: int | None = None, trees: int | None = None, seed: int = 42) -> Pipeline:
    """Unfitted pipeline of one of the four models.

    ``rounds`` and ``trees`` shorten the boosted and bagged models; the
    defaults are the full sizes.
    """
    if name == "logistic_regression":
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        # A unit L2 penalty on the summed loss is 1 / (sum of weights) on MLlib's mean loss.
        lr = LogisticRegression(
            featuresCol="scaled",
            weightCol="weight",
            maxIter=1000,
            regParam=1.0 / max(weight_sum, 1.0),
            elasticNetParam=0.0,
            standardization=False,
        )
        return Pipeline(stages=[scaler, lr])
    if name == "random_forest":
        # Deep trees: rows remember their nodes, instead of all trees so far being sent to every task of each level.
        rf = RandomForestClassifier(numTrees=trees or 200, maxDepth=12, weightCol="weight", seed=seed, cacheNodeIds=True, checkpointInterval=10)
        return Pipeline(stages=[rf])
    if name == "xgboost":
        depth, share, least, rate = 6, "0.8", 1, 0.9
    elif name == "lightgbm":
        # 31 leaves grown best-first have no MLlib twin; depth 5 gives at most 32.
        depth, share, least, rate = 5, "0.8", 20, 1.0
    else:
        raise ValueError(f"Unknown model: {name}")
    gbt = GBTClassifier(
        maxIter=rounds or 300,
        maxDepth=depth,
        stepSize=0.05,
        subsamplingRate=rate,
        featureSubsetStrategy=share,
        minInstancesPerNode=least,
        weightCol="weight",
        seed=seed,
    )
    return Pipeline(stages=[gbt])


def fit_model(name: str, frame: DataFrame, mode: str = "pre_exec", **sizes) -> SkewModel:
    """Fit one classifier on a (features, label) frame with balanced class weights."""
    weighted, ratio, total = class_weights(frame)
    if name == "xgboost":
        # Only positives are scaled here, by neg / pos.
        weighted = frame.withColumn("weight", F.when(F.col("label") == 1, F.lit(ratio)).otherwise(F.lit(1.0)))
    return SkewModel(name, estimator(name, total, **sizes).fit(weighted), None, mode)


CALIBRATIONS = ("isotonic", "sigmoid")
ROWS_PER_TASK = 5_000  # below, another task costs more than it saves


def calibrate(model: SkewModel, holdout: DataFrame, method: str = "isotonic") -> SkewModel:
    """Calibration of a fitted model on rows it has not seen: isotonic, or a logistic curve through the raw score."""
    if method not in CALIBRATIONS:
        raise ValueError(f"method must be one of {CALIBRATIONS}")
    scored = model.pipeline.transform(holdout).select(_raw_score(model.name).alias("_raw"), "label")
    if method == "sigmoid":
        scored = scored.withColumn("_raw", array_to_vector(F.array("_raw")))
        curve = LogisticRegression(featuresCol="_raw", labelCol="label", standardization=False).fit(scored)
        return SkewModel(model.name, model.pipeline, curve, model.mode)
    return SkewModel(model.name, model.pipeline, isotonic_curve(scored), model.mode)


def isotonic_curve(scored: DataFrame) -> IsotonicRegressionModel:
    """Isotonic regression of ``label`` on ``_raw``; rows of one score are counted first, so the fit sees distinct scores."""
    steps = scored.groupBy("_raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="weight", predictionCol="_calibrated").fit(steps)


def logistic_slopes(model: SkewModel, frame: DataFrame) -> DataFrame:
    """(feature, slope) of the mean weighted loss with its L2 penalty at the fitted coefficients."""
    weighted, _, total = class_weights(frame)
    scored = model.pipeline.transform(weighted)
    gap = F.col("weight") * (vector_to_array("probability")[1] - F.col("label"))
    names, coefficients = feature_columns(model.mode), model.classifier.coefficients.toArray()
    rows = scored.select(vector_to_array("scaled").alias("x"), gap.alias("gap"))
    sums = [F.sum(F.col("gap") * F.col("x")[i]) + F.lit(float(c)) for i, c in enumerate(coefficients)] + [F.sum("gap")]
    slopes = rows.agg(F.array(*[x / F.lit(max(total, 1.0)) for x in sums]).alias("slopes"))
    return slopes.select(F.explode(F.arrays_zip(F.array(*map(F.lit, [*names, "intercept"])).alias("feature"), F.col("slopes").alias("slope"))).alias("s")).select("s.*")


class ModelSet(dict):
    """Fitted models by name; ``failed`` has the errors of those that could not be fitted."""

    def __init__(self):
        super().__init__()
        self.failed: dict[str, str] = {}


def _shared(frame: DataFrame) -> DataFrame:
    """The (features, label) frame that all fits read, kept in as many partitions as there are cores, fewer for few rows."""
    frame = frame.select("features", "label").persist()
    cores = frame.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, min(cores, frame.count() // ROWS_PER_TASK))
    if frame.rdd.getNumPartitions() <= wanted:
        return frame
    narrow = frame.coalesce(wanted).persist()
    narrow.count()
    frame.unpersist()
    return narrow


def train_models(
    jobs: DataFrame,
    names: Sequence[str] = MODELS,
    mode: str = "pre_exec",
    use_smote: bool = False,
    with_calibration: bool = True,
    calibration_size: float = 0.2,
    save_path: str | None = None,
    seed: int = 42,
    rounds: int | None = None,
    trees: int | None = None,
    calibration_method: str = "isotonic",
    all_must_fit: bool = False,
) -> ModelSet:
    """Holdout, optional minority oversampling of the fit rows, fits, calibration, save.

    A boosted model that fails is left out and named in ``failed`` of the
    result; the others must fit.  With ``all_must_fit`` its error is raised, for
    tables that could not say that a model is missing.
    """
    fit_jobs, holdout = jobs, None
    if with_calibration:
        fit_jobs, holdout = calibration_holdout(jobs, size=calibration_size, seed=seed)
    frame = training_frame(fit_jobs, mode)
    if use_smote:
        frame = balance_classes(frame, seed=seed)
    spark = jobs.sparkSession
    frame = _shared(frame)
    held = training_frame(holdout, mode).select("features", "label").persist() if holdout is not None else None

    def fit(name: str) -> SkewModel | Exception:
        try:
            model = fit_model(name, frame, mode, rounds=rounds, trees=trees, seed=seed)
            return model if held is None else calibrate(model, held, calibration_method)
        except Exception as error:
            if name not in ("xgboost", "lightgbm"):
                raise
            return error

    models = ModelSet()
    try:
        for name, result in zip(names, side_by_side(spark, [partial(fit, n) for n in names])):
            if isinstance(result, Exception):
                if all_must_fit:
                    raise RuntimeError(f"{name} could not be fitted: {result}") from result
                models.failed[name] = str(result)
            else:
                models[name] = result
    finally:
        frame.unpersist()
        if held is not None:
            held.unpersist()
    if save_path:
        save_models(models, save_path, jobs.sparkSession)
    return models


def save_models(models: dict[str, SkewModel], path: str, spark: SparkSession) -> None:
    """One directory per model and a manifest."""
    for name, model in models.items():
        model.pipeline.write().overwrite().save(f"{path}/{name}/pipeline")
        if model.calibration is not None:
            model.calibration.write().overwrite().save(f"{path}/{name}/calibration")
    method = lambda m: "sigmoid" if isinstance(m.calibration, LogisticRegressionModel) else "isotonic"
    manifest = [(n, m.mode, m.calibration is not None, method(m)) for n, m in models.items()]
    table = spark.createDataFrame(manifest, "name string, mode string, calibrated boolean, method string")
    table.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_models(spark: SparkSession, path: str) -> dict[str, SkewModel]:
    """Models of a directory written by :func:`save_models`."""
    rows = spark.read.schema("name string, mode string, calibrated boolean, method string").json(f"{path}/manifest").collect()
    out = {}
    for r in sorted(rows, key=lambda r: MODELS.index(r["name"]) if r["name"] in MODELS else len(MODELS)):
        base = f"{path}/{r['name']}"
        kind = LogisticRegressionModel if r["method"] == "sigmoid" else IsotonicRegressionModel
        calibration = kind.load(f"{base}/calibration") if r["calibrated"] else None
        out[r["name"]] = SkewModel(r["name"], PipelineModel.load(f"{base}/pipeline"), calibration, r["mode"])
    return out


def model_scores(models: dict[str, SkewModel], jobs: DataFrame) -> DataFrame:
    """Long (model, job...) frame of all models' probabilities; the jobs are read once for all models of a mode."""
    if not models:
        raise ValueError("No models given")
    out = None
    for mode in sorted({m.mode for m in models.values()}):
        some = {n: m for n, m in models.items() if m.mode == mode}
        framed = _framed(jobs, mode)
        for i, model in enumerate(some.values()):
            framed = model.add_score(framed, f"_p{i}")
        each = F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(n).alias("m")) for i, n in enumerate(some)])
        part = framed.select("_row", F.explode(each).alias("_one"))
        part = part.select("_row.*", F.col("_one.p").alias("skew_probability"), F.col("_one.m").alias("model"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_models(models: dict[str, SkewModel], jobs: DataFrame) -> DataFrame:
    """All metrics of all models on labelled jobs, one plan."""
    rows = model_scores(models, jobs).select(
        "model", F.col("is_skewed").alias("label"), F.col("skew_probability").alias("score")
    )
    return evaluate_scores(rows)


def feature_importance(model: SkewModel) -> DataFrame:
    """(feature, importance) of a tree model, most important first."""
    spark = SparkSession.active()
    if not hasattr(model.classifier, "featureImportances"):
        raise ValueError(f"{model.name} has no feature importances")
    values = model.classifier.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(feature_columns(model.mode), values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def cross_validate(
    jobs: DataFrame, names: Sequence[str] = MODELS, n_folds: int = 5, seed: int = 42, mode: str = "pre_exec", **sizes
) -> DataFrame:
    """Mean and std of F1 and accuracy over stratified folds, and whether F1 is stable (std below 0.1)."""
    spark = jobs.sparkSession
    folds = stratified_folds(jobs, n_folds, seed=seed).persist()
    frames = [_shared(training_frame(folds.filter(F.col("fold") != k), mode)) for k in range(n_folds)]
    try:
        work = [(k, n) for n in names for k in range(n_folds)]
        fits = side_by_side(spark, [partial(fit_model, n, frames[k], mode, **sizes) for k, n in work])

        def measured(k: int) -> list:
            models = {n: m for (fold, n), m in zip(work, fits) if fold == k}
            called = model_scores(models, folds.filter(F.col("fold") == k).drop("fold")).select(
                "model",
                F.col("is_skewed").alias("label"),
                (F.col("skew_probability") > 0.5).cast("int").alias("prediction"),
            )
            # Two numbers per model and fold.
            return long_metrics(class_metrics(called)).filter("metric IN ('f1_score', 'accuracy')").collect()

        rows = [r for part in side_by_side(spark, [partial(measured, k) for k in range(n_folds)]) for r in part]
        parts = spark.createDataFrame(rows, "model string, metric string, value double")
    finally:
        for frame in (*frames, folds):
            frame.unpersist()
    summary = rolling_summary(parts)
    pick = lambda m, f: F.max(F.when(F.col("metric") == m, F.col(f)))
    out = summary.groupBy("model").agg(
        pick("f1_score", "mean").alias("f1_mean"),
        pick("f1_score", "std").alias("f1_std"),
        pick("accuracy", "mean").alias("accuracy_mean"),
        pick("accuracy", "std").alias("accuracy_std"),
    )
    return out.withColumn("consistent", F.col("f1_std") < 0.1)
