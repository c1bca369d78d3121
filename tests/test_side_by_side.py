"""Fits that run together, one scan for all models, selection without a sort, numbering by scan partition."""

import threading

import pytest
from pyspark.sql import functions as F

from laggard.operators import train
from laggard.operators.early import sequential_index
from laggard.operators.ordered import keys_at
from laggard.sources.generate import generate_labelled_jobs


def test_work_runs_at_the_same_time(spark):
    meet = threading.Barrier(3, timeout=60)

    def one(n):
        meet.wait()  # passes only when all three are running
        return spark.range(n).count()

    assert train.side_by_side(spark, [lambda n=n: one(n) for n in (3, 4, 5)]) == [3, 4, 5]
    assert train.side_by_side(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        train.side_by_side(spark, [lambda: 1 // 0, lambda: 1])


def test_all_models_read_the_jobs_once(spark, tmp_path):
    path = str(tmp_path / "jobs")
    generate_labelled_jobs(spark, 600).write.parquet(path)
    jobs = spark.read.parquet(path)
    models = train.train_models(jobs, ["logistic_regression", "random_forest", "xgboost"], rounds=2, trees=3)
    scores = train.model_scores(models, jobs)
    assert scores._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for name, model in models.items():
        one = model.score(jobs).select("job_id", "skew_probability")
        assert scores.filter(F.col("model") == name).select("job_id", "skew_probability").exceptAll(one).count() == 0
    assert scores.count() == 3 * jobs.count()


@pytest.mark.parametrize("key", ["double", "ties", "nulls", "nan", "text", "one value"])
def test_selected_keys_are_exact(spark, key):
    of = {
        "double": "rand(4)", "ties": "cast(id % 3 as double)", "nulls": "if(id % 2 = 0, null, cast(id % 17 as double))",
        "nan": "if(id % 5 = 0, double('nan'), rand(4))", "text": "cast(id % 97 as string)", "one value": "7",
    }[key]
    df = spark.range(5_000).selectExpr(f"{of} AS a", "id AS b")
    rows = [tuple(r) for r in df.orderBy("a", "b").collect()]
    wanted = [0, 1, 1_234, 2_500, 3_999, 4_998, 4_999]
    n, got = keys_at(df, [F.col("a"), F.col("b")], lambda n: [*wanted, n, -1])
    assert n == 5_000 and {p: str(tuple(r)[:2]) for p, r in got.items()} == {p: str(rows[p]) for p in wanted}


def test_rows_are_numbered_by_scan_partition(spark):
    """A job with nine tenths of the rows: numbers 0..n-1, each once, in scan order within a partition."""
    df = spark.range(0, 20_000, 1, 8).selectExpr("if(id % 10 = 0, id % 7, null) AS small", "id").selectExpr("coalesce(small, 99) AS job_id", "id AS n")
    df = df.union(spark.range(5).selectExpr("cast(null as long)", "id"))
    got = sequential_index(df)
    counts = got.groupBy("job_id").agg(F.count("*").alias("n"), F.min("task_index").alias("a"), F.max("task_index").alias("b"), F.countDistinct("task_index").alias("d"))
    assert counts.filter("a <> 0 OR b <> n - 1 OR d <> n").count() == 0 and got.count() == 20_005
    most = got.filter("job_id = 99").orderBy("task_index").select("n").collect()
    assert [r["n"] for r in most] == sorted(r["n"] for r in most)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_pid" in plan
