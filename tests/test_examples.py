"""Worked examples with known answers."""

import pytest
from pyspark.sql import functions as F

from laggard.functions.coerce import number
from laggard.functions.parse import constraint_flag, resource_requests
from laggard.functions.scoring import confidence, recommendation, tertile_band
from laggard.operators import clean, early, features, labels, metrics, policy, runtimes, splits
from laggard.operators.scoring import history_confidence


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    "values, mean, longest, std, skewed",
    [
        ([10.0, 10.0, 60.0], 26.6667, 60.0, 28.8675, 1),
        ([10.0, 1000.0], 505.0, 1000.0, 700.0357, 0),
        ([7.0], 7.0, 7.0, 0.0, 0),
        ([1.0, 1.0, 4.0], 2.0, 4.0, 1.7321, 1),
    ],
)
def test_labels(spark, values, mean, longest, std, skewed):
    df = spark.createDataFrame([(1, v) for v in values], "job_id long, runtime double")
    r = one(labels.label_from_runtimes(df))
    assert r.avg_task_runtime == pytest.approx(mean, abs=1e-4)
    assert r.max_task_runtime == longest
    assert r.std_task_runtime == pytest.approx(std, abs=1e-4)
    assert r.is_skewed == skewed


def test_resubmitted_task(spark):
    rows = [(1, 0, 0, 0), (1, 0, 0, 5), (1, 0, 4, 3), (1, 0, 4, 20)]
    df = spark.createDataFrame(rows, "job_id long, task_index long, event_type int, timestamp long")
    pairs = runtimes.event_runtimes(df)
    assert sorted(r.runtime for r in pairs.collect()) == [3.0, 15.0, 20.0]
    by_pairs = one(labels.job_runtime_stats(pairs))
    without = one(runtimes.event_job_stats(df))
    for c in ("avg_task_runtime", "max_task_runtime", "std_task_runtime"):
        assert without[c] == pytest.approx(by_pairs[c])
    assert by_pairs.avg_task_runtime == pytest.approx(38 / 3)


@pytest.mark.parametrize("n, take", [(30, 5), (100, 10), (3, 3)])
def test_early_take(spark, n, take):
    df = spark.range(n).select(F.lit(1).alias("job_id"), F.col("id").alias("end_time"), (F.col("id") + 1.0).alias("runtime"))
    r = one(early.early_features(df))
    assert r.early_num_tasks == take
    assert r.early_max_task_runtime == float(take)


def test_early_rejects_share(spark):
    df = spark.createDataFrame([(1, 1.0)], "job_id long, runtime double")
    for k in (0, 1.5):
        with pytest.raises(ValueError):
            early.early_features(df, k)


@pytest.mark.parametrize("n, train", [(10, 8), (4057, 3245)])
def test_time_split_size(spark, n, train):
    df = spark.range(n).select(F.col("id").alias("job_id"), (F.col("id") % 7).cast("double").alias("submit_time"))
    counts = {r["split"]: r["count"] for r in splits.time_split(df).groupBy("split").count().collect()}
    assert counts == {"train": train, "test": n - train}


def test_rolling_folds():
    assert splits.rolling_folds(10) == [(4, 6), (6, 8), (8, 10)]


def scores(spark, ys, ps):
    return spark.createDataFrame([("m", y, p) for y, p in zip(ys, ps)], "model string, label int, score double")


def test_calibration_error_leaves_one_out(spark):
    df = scores(spark, [0, 1], [0.3, 1.0])
    assert one(metrics.calibration_error(df)).ece == pytest.approx(0.15)
    df = scores(spark, [0, 0], [0.3, 1.0])
    assert one(metrics.calibration_error(df, exclude_one=False)).ece == pytest.approx((0.3 + 1.0) / 2)


def test_probability_bins(spark):
    ps = [0.0, 0.1, 0.3, 0.6, 0.7, 0.999, 1.0]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = [r.b for r in df.select("i", metrics.probability_bin(F.col("p")).alias("b")).orderBy("i").collect()]
    assert got == [0, 1, 2, 5, 6, 9, 10]


def test_ranking_metrics(spark):
    r = one(metrics.ranking_metrics(scores(spark, [1, 0, 1], [0.9, 0.8, 0.7])))
    assert r.pr_auc == pytest.approx(0.8333, abs=1e-4)
    assert r.roc_auc == pytest.approx(0.5)


def test_ranking_metrics_one_class(spark):
    r = one(metrics.ranking_metrics(scores(spark, [0, 0], [0.9, 0.8])))
    assert r.pr_auc is None and r.roc_auc is None


def test_quantile_buckets(spark):
    values = [1.0, 1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 10.0]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in enumerate(values)], "i int, a double, b double")
    buckets = splits.quantile_buckets(df, ["a", "b"])
    got = df.select("i", buckets["a"].alias("a"), buckets["b"].alias("b")).orderBy("i").collect()
    # edges 1, 1.4, 2, 3.2, 4.6, 10; a constant column has no bucket
    assert [r.a for r in got] == [0, 0, 1, 1, 2, 3, 4, 4]
    assert {r.b for r in got} == {None}


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, 0, c) for c in (2, 1, 1, 2)], "job_id long, task_index long, scheduling_class int")
    assert one(features.pre_exec_features(df)).scheduling_class == 1.0


def test_coercion(spark):
    texts = ["1e3", " 12 ", "0x10", "True", "1_000", "1,000", "", "nan", "1d", "2.5f", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = [r.v for r in df.select("i", number(df, "s").alias("v")).orderBy("i").collect()]
    assert got == [1000.0, 12.0] + [None] * 9


@pytest.mark.parametrize(
    "text, want",
    [
        ("{'cpus': 0.02, 'memory': 0.014}", (0.02, 0.014, None)),
        ("{'cpus': None, 'cpu': 1}", (None, None, None)),
        ("{'cpu': 1, 'mem': 2, 'disk_space': 3}", (1.0, 2.0, 3.0)),
        ("bad", (None, None, None)),
        ("", (None, None, None)),
        ("5", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_resources(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    parsed = resource_requests(F.col("t"))
    assert tuple(one(df.select(*[v.alias(k) for k, v in parsed.items()]))) == want


@pytest.mark.parametrize(
    "text, want",
    [
        (None, None),
        ("", 0.0),
        ("[]", 0.0),
        ("()", 0.0),
        ("{}", 0.0),
        ("(1)", 0.0),
        ("(1,)", 1.0),
        ("(1, 2)", 1.0),
        ("{'a': 1}", 1.0),
        ("{1, 2}", 1.0),
        ("[{'a':1}]", 1.0),
        ("['some words, here']", 1.0),
        ("[abc]", 0.0),
        ("x y", 0.0),
        ("7", 0.0),
        ("'text'", 0.0),
        ("[1,,2]", 0.0),
    ],
)
def test_constraints(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(constraint_flag(F.col("t")).alias("f"))).f == want


def test_confidence_and_recommendation(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.15, 0.12, 0.30, 0.99)], "p double")
    band = confidence(F.col("p"), F.lit(0.10), F.lit("logistic_regression"))
    assert [r.b for r in df.select("p", band.alias("b")).collect()] == ["high", "medium", "low", "high", "high"]
    df = spark.createDataFrame([(1, 0.81), (1, 0.5), (0, 0.1), (0, 0.2)], "y int, p double")
    got = [r.t.split(" RISK")[0] for r in df.select(recommendation(F.col("y"), F.col("p")).alias("t")).collect()]
    assert got == ["HIGH", "MODERATE", "LOW", "LOW-MODERATE"]


def test_tertiles_of_first_ranks(spark):
    df = spark.createDataFrame([(1 / 3,), (2 / 3,), (1.0,)], "r double")
    assert [r.b for r in df.select(tertile_band(F.col("r")).alias("b")).collect()] == ["low", "medium", "high"]
    preds = spark.createDataFrame([(0, 0.3, "x"), (1, 0.1, "x"), (2, 0.3, "x")], "n int, skew_probability double, prediction_confidence string")
    got = history_confidence(preds, arrival=("n",)).orderBy("n").collect()
    assert [r.prediction_confidence for r in got] == ["medium", "low", "high"]


def test_policy(spark):
    rows = [(100.0, 1, 0.9), (100.0, 0, 0.9), (100.0, 1, 0.0)]
    df = spark.createDataFrame(rows, "max_task_runtime double, is_skewed int, skew_probability double")
    r = one(policy.policy_impact(df, "logistic_regression"))
    assert r.adjusted_total == pytest.approx(275.0)
    assert r.relative_improvement == pytest.approx(25 / 300)
    none = one(policy.compare_policies(df.filter("is_skewed IS NULL OR skew_probability < 0.05").withColumn("model", F.lit("xgboost"))))
    assert none.precision_mitigation == 0.0 and none.mitigations == 0


def test_unit_switch_is_global(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 2e10)], "job_id long, duration double")
    assert sorted(r.runtime for r in runtimes.direct_runtimes(df).collect()) == [5e-6, 2e4]
    assert sorted(r.runtime for r in runtimes.direct_runtimes(df, "s").collect()) == [5.0, 2e10]
    small = df.filter("job_id = 1")
    assert one(runtimes.direct_runtimes(small)).runtime == 5.0


def test_numeric_id_rule(spark):
    schema = "collection_id string, duration double"
    mostly = spark.createDataFrame([("7", 1.0), ("07", 1.0), ("7.0", 1.0), ("-3", 1.0), ("job_1", 1.0), (None, 1.0)], schema)
    assert sorted(r.job_id for r in clean.clean_direct(mostly).collect()) == ["7", "7", "7", "job_1"]
    few = spark.createDataFrame([("7", 1.0), ("-3", 1.0), ("a", 1.0), ("b", 1.0)], schema)
    assert sorted(r.job_id for r in clean.clean_direct(few).collect()) == ["-3", "7", "a", "b"]


def test_event_cleaning(spark):
    rows = [
        (1, 0, 1, 0, 0, 1.0, None),
        (1, 1, 1, 0, 0, 9.0, None),
        (1, None, 1, 0, 0, 9.0, None),
        (-1, 0, 1, 0, 0, 9.0, None),
        (1, 0, None, 0, 0, 9.0, None),
        (1, 0, 1, -1, 0, 9.0, None),
        (2, 0, 1, 1, 12, 5.0, None),
        (3, 0, 1, 2, 4, None, None),
    ]
    df = spark.createDataFrame(
        rows, "timestamp long, missing_info int, job_id long, task_index long, event_type int, cpu_request double, priority double"
    )
    got = clean.clean_events(df).orderBy("timestamp").collect()
    # The median (3.0) counts the row whose event code is dropped later.
    assert [(r.timestamp, r.cpu_request, r.priority) for r in got] == [(1, 1.0, 0.0), (3, 3.0, 0.0)]
    report = one(clean.cleaning_report(df))
    assert (report.rows_before, report.rows_after) == (8, 2)
    assert report.removed_missing_info == 2 and report.removed_unknown_event == 1


def test_required_columns(spark):
    df = spark.range(1)
    for call in (
        lambda: labels.job_runtime_stats(df),
        lambda: labels.label_jobs(df),
        lambda: features.training_frame(df),
        lambda: features.feature_columns("other"),
        lambda: runtimes.extract_runtimes(df),
        lambda: splits.template_split(df),
        lambda: early.early_features(df),
    ):
        with pytest.raises(ValueError):
            call()
