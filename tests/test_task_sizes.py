"""Tasks that stay small for large tables: rows dealt by count, hot keys by groups, hot slices read once."""

import numpy as np
from pyspark.sql import functions as F

from laggard.operators import neighbours, ordered, staging
from laggard.operators.early import early_features, early_features_sweep
from laggard.operators.runtimes import event_job_stats


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _sorted(df):
    return sorted(map(str, df.collect()))


def _tasks(spark, n=600):
    i = F.col("id")
    return spark.range(n).select((i % 60).alias("job_id"), i.alias("task_index"), ((i * 7) % 101 + 1).cast("double").alias("runtime"))


def test_sweep_deals_rows_by_their_number(spark, monkeypatch):
    rows = _tasks(spark)
    plain = _sorted(early_features_sweep(rows, (0.1, 1.0)))
    monkeypatch.setattr(staging, "TASK_ROWS", 20)
    many = early_features_sweep(rows, (0.1, 1.0))
    assert many.rdd.getNumPartitions() >= 30
    assert _sorted(many) == plain


def test_event_stats_deal_rows_by_their_number(spark, monkeypatch):
    rows = _tasks(spark).select("job_id", F.col("task_index").alias("task_index"), "runtime")
    ends = rows.select("job_id", "task_index", F.lit(4).alias("event_type"), (F.col("runtime") + 5).cast("bigint").alias("timestamp"))
    events = rows.select("job_id", "task_index", F.lit(0).alias("event_type"), F.lit(5).cast("bigint").alias("timestamp")).union(ends)
    plain = _sorted(event_job_stats(events))
    monkeypatch.setattr(staging, "TASK_ROWS", 40)
    many = event_job_stats(events)
    assert "RepartitionByExpression [job_id" in _plan(many) and ", 30" in _plan(many)
    assert _sorted(many) == plain


def test_hot_keys_by_groups(spark, monkeypatch):
    rows = spark.range(40).select(F.when(F.col("id") < 12, 1).when(F.col("id") < 22, F.lit(None)).when(F.col("id") < 31, 2).otherwise(F.col("id")).alias("k"))
    assert ordered.hot_keys(rows, ["k"], ordered.SEVERAL) is None
    want = _sorted(ordered.hot_keys(rows, ["k"], 9))
    monkeypatch.setattr(ordered, "SEVERAL", 1)
    for groups in (1, 2, 1 << 16):
        monkeypatch.setattr(ordered, "KEY_BUCKETS", groups)
        assert _sorted(ordered.hot_keys(rows, ["k"], 9)) == want and len(want) == 2
    # Keys of groups within the limit are never counted by themselves.
    monkeypatch.setattr(ordered, "KEY_BUCKETS", 1 << 16)
    counted = []
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(ordered, "stage", lambda df: counted.append(_plan(df)) or df)
    ordered.hot_keys(rows, ["k"], 9)
    assert "xxhash64" in counted[0]


def test_hot_slices_read_their_rows_once(spark, tmp_path):
    _tasks(spark).withColumn("origin_mark", F.lit(1)).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    cut = early_features(rows, hot_rows=2)
    assert sum("Relation" in line and "origin_mark" in line for line in _plan(cut).splitlines()) == 1
    close = lambda df: sorted((r["job_id"], r["early_num_tasks"], round(r["early_avg_task_runtime"], 9), round(r["early_std_task_runtime"], 9)) for r in df.collect())
    assert close(cut) == close(early_features(rows))


def test_a_point_is_compared_with_the_pivots_of_near_groups():
    random = np.random.default_rng(5)
    at = np.repeat(random.integers(0, 60, (450, 2)).astype(float), 2, axis=0)  # with equal pivots
    x = np.concatenate([random.uniform(0, 60, (500, 2)), at[:100], [[500.0, 500.0]]])
    pivots, met = neighbours._Pivots(at), 0
    near = pivots.near

    def counted(*args):
        nonlocal met
        for rows, some, d in near(*args):
            met += d.size
            yield rows, some, d

    pivots.near = counted
    cell, dist, sure = pivots.cells(x, 5)
    d = neighbours._distances(x, at)
    assert (cell == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
    assert (sure >= np.sort(d, axis=1)[:, 5]).all() and np.isfinite(sure).all()
    assert met < d.size / 3
