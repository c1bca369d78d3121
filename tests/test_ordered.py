"""Order-dependent helpers, and the range-cut paths for hot keys against the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from laggard.operators import early, runtimes
from laggard.operators.early import sequential_index
from laggard.operators.ordered import hot_keys, keys_at, with_global_rank, with_running_sums
from laggard.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def lopsided(spark):
    """A third of the rows belong to one job, with many equal rows in it."""
    rows = []
    for i in range(3000):
        job = 0 if i % 3 == 0 else i % 97
        rows.append((job, (i * 7) % 50, i % 11, float(1 + (i * 13) % 23)))
    return spark.createDataFrame(rows, "job_id long, end_time long, task_index long, runtime double").repartition(8)


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    rows = with_global_rank(df, [F.col("k").desc()]).collect()
    assert all(r["rank0"] == 999 - r["k"] for r in rows) and len(rows) == 1000


def test_keys_at(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    n, rows = keys_at(df, [F.col("k")], lambda n: [0, n // 2, n - 1, n])
    assert n == 100 and {p: r["k"] for p, r in rows.items()} == {0: 0, 50: 50, 99: 99}
    assert keys_at(df.filter("k < 0"), [F.col("k")], lambda n: [0]) == (0, {})


@pytest.mark.parametrize("few", [0, 500_000])
def test_running_sums(lopsided, few):
    counted = lopsided.groupBy("job_id", "end_time").agg(F.count("*").alias("n"))
    got = with_running_sums(counted, ["job_id"], [F.col("end_time")], {"upto": "n"}, few).toPandas()
    want = counted.toPandas().sort_values(["job_id", "end_time"])
    want["upto"] = want.groupby("job_id")["n"].cumsum()
    pd.testing.assert_frame_equal(
        got.sort_values(["job_id", "end_time"]).reset_index(drop=True)[["job_id", "end_time", "n", "upto"]],
        want.reset_index(drop=True),
    )


@pytest.mark.parametrize("few", [0, 500_000])
def test_running_sums_without_groups(spark, few):
    df = spark.range(500).select("id", F.lit(2).alias("w"))
    got = with_running_sums(df, [], [F.col("id").desc()], {"s": "w"}, few).collect()
    assert all(r["s"] == 2 * (500 - r["id"]) for r in got)


@pytest.mark.parametrize("few", [0, 500_000])
def test_quantiles(spark, few):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "a": rng.integers(0, 20, 2000).astype(float), "b": rng.random(2000)})
    pdf.loc[pdf.index % 10 == 0, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.2, 0.5, 0.77, 1.0]
    for r in exact_quantiles(df, ["a", "b"], probs, few_values=few).collect():
        assert r["value"] == pytest.approx(pdf[r["column"]].quantile(r["prob"]))
    rows = exact_quantiles(df, ["a", "b"], probs, ["g"], few_values=few).collect()
    assert len(rows) == 3 * 2 * len(probs)
    for r in rows:
        assert r["value"] == pytest.approx(pdf[pdf.g == r["g"]][r["column"]].quantile(r["prob"]))


def test_hot_keys(lopsided):
    assert [r["job_id"] for r in hot_keys(lopsided, ["job_id"], 500).collect()] == [0]
    assert hot_keys(lopsided, ["job_id"], 5000) is None


def test_early_slices_of_hot_jobs(lopsided):
    shares = (0.05, 0.1, 0.5, 1.0)
    plain = early.early_features_sweep(lopsided, shares).toPandas()
    cut = early.early_features_sweep(lopsided, shares, hot_rows=25).toPandas()
    by = ["job_id", "k"]
    pd.testing.assert_frame_equal(
        plain.sort_values(by).reset_index(drop=True), cut.sort_values(by).reset_index(drop=True)[plain.columns], rtol=1e-9
    )


def test_early_slice_against_pandas(lopsided):
    pdf = lopsided.toPandas().sort_values(["job_id", "end_time", "task_index", "runtime"])
    got = early.early_features(lopsided).toPandas().set_index("job_id")
    for job, g in pdf.groupby("job_id"):
        take = min(len(g), max(5, int(np.ceil(0.1 * len(g)))))
        head = g.iloc[:take]["runtime"]
        r = got.loc[job]
        assert r["early_num_tasks"] == take
        assert r["early_avg_task_runtime"] == pytest.approx(head.mean())
        assert r["early_std_task_runtime"] == pytest.approx(head.std(ddof=0))


def test_sequential_index_of_hot_jobs(lopsided):
    df = lopsided.drop("task_index").withColumn("id", F.monotonically_increasing_id())
    order = ["end_time", "runtime", "id"]
    ids = df.toPandas()
    fixed = df.sparkSession.createDataFrame(ids)
    plain = sequential_index(fixed, order).toPandas().sort_values("id").reset_index(drop=True)
    cut = sequential_index(fixed, order, hot_rows=100).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, cut[plain.columns], check_dtype=False)


def test_pair_free_stats_of_hot_tasks(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame(
        {
            "job_id": np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, 5, n)),
            "task_index": np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, 3, n)),
            "event_type": rng.choice([0, 4, 1], n),
            "timestamp": 1_700_000_000_000_000 + rng.integers(0, 300, n) * 1_000_003,
        }
    )
    df = spark.createDataFrame(pdf).withColumn("event_type", F.col("event_type").cast("int"))
    s, f = pdf[pdf.event_type == 0], pdf[pdf.event_type == 4]
    pairs = s.merge(f, on=["job_id", "task_index"])
    pairs["runtime"] = (pairs.timestamp_y - pairs.timestamp_x).astype(float)
    want = pairs[pairs.runtime > 0].groupby("job_id")["runtime"].agg(["mean", "max", "std"])
    for hot in (10, 1_000_000):
        got = runtimes.event_job_stats(df, hot_rows=hot).toPandas().set_index("job_id")
        assert set(got.index) == set(want.index)
        for job, w in want.iterrows():
            assert got.loc[job, "avg_task_runtime"] == pytest.approx(w["mean"])
            assert got.loc[job, "max_task_runtime"] == w["max"]
            assert got.loc[job, "std_task_runtime"] == pytest.approx(w["std"] if w["std"] == w["std"] else 0.0)


def test_pairs_of_hot_tasks(spark):
    """Blocks of one hot task give the pairs of the plain join, also with equal times and null ids."""
    rows = [(1, 0, 0, float(i // 3)) for i in range(90)] + [(1, 0, 4, float(i)) for i in range(40)]
    rows += [(2, 0, 0, 1.0), (2, 0, 4, 5.0), (2, 1, 4, 5.0), (None, 0, 0, 1.0), (None, 0, 4, 2.0), (1, 0, 4, None), (1, 0, 0, None)]
    df = spark.createDataFrame(rows, "job_id long, task_index long, event_type int, timestamp double")
    plain, cut = runtimes.event_runtimes(df), runtimes.event_runtimes(df, hot_pairs=100, block=16)
    assert plain.count() == sum(f > i // 3 for i in range(90) for f in range(40)) + 1
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0


def test_a_hot_task_is_spread(spark):
    """No key of the blocked join holds more than block events a side."""
    keys = ("job_id", "task_index")
    side = lambda n, time: spark.range(n).selectExpr("1L AS job_id", "0L AS task_index", f"cast(id AS double) AS {time}")
    seen = []
    real = runtimes.stage
    runtimes.stage = lambda df: seen.append(real(df)) or seen[-1]
    try:
        pairs = runtimes._pairs_in_blocks(side(1000, "start_time"), side(1000, "end_time"), 100)
        assert pairs.groupBy(*keys).count().collect()[0]["count"] == 1000 * 999 // 2
    finally:
        runtimes.stage = real
    assert seen[0].count() == 55  # of 100 pairs of blocks those that can hold a later finish
