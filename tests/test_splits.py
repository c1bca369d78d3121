"""Split properties: whole, disjoint, stable under repartitioning, no leakage."""

import math

import pytest
from pyspark.sql import functions as F

from laggard.operators import splits


def parts(df):
    return {r["job_id"]: r["split"] for r in df.select("job_id", "split").collect()}


def test_time_split_is_ordered(jobs):
    out = splits.time_split(jobs)
    n = jobs.count()
    assert out.filter("split = 'train'").count() == int(n * 0.8)
    last = out.filter("split = 'train'").agg(F.max("submit_time")).first()[0]
    assert last <= out.filter("split = 'test'").agg(F.min("submit_time")).first()[0]
    assert parts(out) == parts(splits.time_split(jobs.repartition(5)))


def test_time_split_without_time(spark):
    df = spark.range(10).withColumnRenamed("id", "job_id").withColumn("submit_time", F.lit(None).cast("double"))
    want = {i: "train" if i < 8 else "test" for i in range(10)}
    assert parts(splits.time_split(df)) == want
    assert parts(splits.time_split(df.drop("submit_time"))) == want


def test_missing_times_come_last(spark):
    df = spark.createDataFrame([(i, None if i < 3 else float(i)) for i in range(10)], "job_id long, submit_time double")
    assert {k for k, v in parts(splits.time_split(df, test_size=0.3)).items() if v == "test"} == {0, 1, 2}


def test_template_split(jobs):
    out = splits.template_split(jobs)
    sides = out.groupBy("template_id").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s"))
    assert sides.filter("n > 1").count() == 0
    assert sides.filter("s = 'test'").count() == math.ceil(0.2 * sides.count())
    assert parts(out) == parts(splits.template_split(jobs.repartition(3)))
    assert parts(out) != parts(splits.template_split(jobs, seed=7))


def test_stratified_split(jobs):
    out = splits.stratified_split(jobs)
    n = jobs.count()
    assert out.filter("split = 'test'").count() == math.ceil(n * 0.2)
    for r in out.groupBy("is_skewed").agg(F.avg((F.col("split") == "test").cast("int")).alias("share")).collect():
        assert r["share"] == pytest.approx(0.2, abs=0.01)


def test_allocate():
    assert splits.allocate([90, 10], 20) == [18, 2]
    assert splits.allocate([5, 5], 3) == [2, 1]
    assert splits.allocate([0, 0], 3) == [0, 0]


def test_folds(jobs):
    out = splits.stratified_folds(jobs, 5)
    counts = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(counts) == 5 and max(counts) - min(counts) <= 2


def test_rolling_grows(jobs):
    out = splits.rolling_split(jobs)
    sizes = {(r["fold"], r["split"]): r["count"] for r in out.groupBy("fold", "split").count().collect()}
    n = jobs.count()
    win, start = int(n * 0.2), int(n * 0.4)
    assert sizes == {(f, s): v for f in range(3) for s, v in (("train", start + f * win), ("test", win))}
    valid = splits.fold_validity(out).collect()
    assert all(r["valid"] for r in valid)
    assert splits.rolling_split(jobs.limit(0)).count() == 0


def test_calibration_holdout(jobs, spark):
    fit, held = splits.calibration_holdout(jobs)
    assert fit.count() + held.count() == jobs.count()
    assert fit.join(held, "job_id", "left_semi").count() == 0
    same, none = splits.calibration_holdout(jobs.filter("is_skewed = 0"))
    assert none is None and same.count() == jobs.filter("is_skewed = 0").count()
    lone = spark.createDataFrame([(i, int(i == 3)) for i in range(20)], "job_id long, is_skewed int")
    fit, held = splits.calibration_holdout(lone)
    assert held is None or fit.count() + held.count() == 20


def test_template_fallback(jobs):
    out = splits.add_template_id(jobs.drop("user_name", "template_id"))
    assert out.filter("template_id NOT RLIKE '^[0-9.]+[|][0-9]+[|][0-9]+$'").count() == 0
    flat = splits.add_template_id(jobs.select("job_id"))
    assert {r[0] for r in flat.select("template_id").distinct().collect()} == {"0|nan|nan"}


def test_random_rows(jobs):
    a = [r["job_id"] for r in splits.random_rows(jobs).collect()]
    assert a == [r["job_id"] for r in splits.random_rows(jobs.repartition(6)).collect()] and len(set(a)) == 10
