"""Nothing is lost or misread in silence: ids, columns by name, NULL groups, tight spreads."""

import csv

from pyspark.sql import functions as F

from laggard.functions.parse import resource_requests
from laggard.operators import clean, explore, features, metrics, runtimes
from laggard.operators.early import early_features
from laggard.schemas import LIVE_JOB
from laggard.sources import trace
from laggard.streaming import live


def test_only_whole_numbers_are_unified(spark):
    ids = ["7", "07", "7.0", " 7 ", "1.5", "1e30", "1e3", "-4", "12345678901234567890", "9.", "x7"]
    df = spark.createDataFrame([(i,) for i in ids], "job_id string").withColumn("duration", F.lit(1.0))
    got = [r["job_id"] for r in clean.clean_direct(df).collect()]
    assert got == ["7", "7", "7", "7", "1.5", "1e30", "1000", "12345678901234567890", "9", "x7"]


def test_event_ids_may_be_names(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("job_id,task_index,event_type,timestamp,missing_info\njob_1,3.0,0,5,0.0\n7.0,0,4,6,0\n-2,0,4,6,0\njob_1,0,4,6,1\n")
    rows = clean.clean_events(trace.read_trace(spark, str(path))).collect()
    assert [(r["job_id"], r["task_index"], r["event_type"]) for r in rows] == [("job_1", 3, 0), ("7.0", 0, 4)]


def test_spread_of_tight_runtimes(spark):
    rows = [("j", t, 0, 0) for t in range(3)] + [("j", t, 4, 10**12 + t) for t in range(3)]
    rows += [("k", t, 0, 0) for t in range(5)] + [("k", t, 4, 10**11 + 50 * t * t) for t in range(5)]
    got = {r["job_id"]: r for r in runtimes.event_job_stats(spark.createDataFrame(rows, "job_id string, task_index long, event_type int, timestamp long")).collect()}
    assert abs(got["j"]["std_task_runtime"] - 1.0) < 1e-9 and got["j"]["avg_task_runtime"] == 10**12 + 1
    gaps = [50 * t * t for t in range(5)]
    mean = sum(gaps) / 5
    assert abs(got["k"]["std_task_runtime"] - (sum((g - mean) ** 2 for g in gaps) / 4) ** 0.5) < 1e-6


def test_null_jobs_drop_out(spark):
    df = spark.createDataFrame([(None, 1.0, 0), ("a", 2.0, 0), ("a", 3.0, 1)], "job_id string, runtime double, task_index long")
    assert [r["job_id"] for r in early_features(df).collect()] == ["a"]
    assert [r["job_id"] for r in features.aggregate_job_level(df).collect()] == ["a"]


def test_null_groups_and_empty_cells_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "g int, x double")
    got = {r["g"]: r for r in explore.describe(df, ["x"], ["g"]).collect()}
    assert got[None]["p50"] == 2.0 and got[1]["p50"] == 5.0
    assert {r["g"]: r["median"] for r in explore.box_stats(df, ["x"], "g").collect()} == {None: 2.0, 1: 5.0}
    bins = explore.histogram(df, "x", "g", bins=4).collect()
    assert len(bins) == 4 and sum(r["n"] for r in bins) == 1
    called = spark.createDataFrame([("m", 1, 1), ("m", 1, 1)], "model string, label int, prediction int")
    assert {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(called, ["model"]).collect()} == {
        (1, 1): 2, (0, 0): 0, (0, 1): 0, (1, 0): 0}


def test_resource_literals(spark):
    texts = ["{'cpus': 0.5, 'ok': True}", "{'cpus': 0.5, 'at': (1, 2)}", "{'cpus': 0.5,}", "{'cpus': .5}", "{'cpus':\n 0.5}", "{'cpus': (0.5)}", "{'cpus': None, 'cpu': 1}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(resource_requests(F.col("t"))["cpu_request"].alias("c"))
    assert [r["c"] for r in df.collect()] == [0.5] * 6 + [None]


def score(rows):
    from laggard.operators.scoring import add_predictions

    return add_predictions(rows.withColumn("skew_probability", F.col("num_tasks") / F.lit(300.0)), "xgboost")


def test_live_columns_are_found_by_name(spark, tmp_path):
    names = LIVE_JOB.fieldNames()
    values = {n: str(i + 1) for i, n in enumerate(names)} | {"job_id": "a"}
    inbox = tmp_path / "in"
    inbox.mkdir()

    def put(name, header, *rows):
        with open(inbox / name, "w", newline="") as f:
            csv.writer(f).writerows([header, *rows])

    flipped = list(reversed(names))
    put("a.csv", flipped + ["other"], [values[n] for n in flipped] + ["x"], ["1", "2"], ["" if n == "job_id" else values[n] for n in flipped] + ["y"])
    put("b.csv", names, [values[n] for n in names] + ["one too many"], [{"job_id": "q, r"}.get(n, values[n]) for n in names])
    put("c.csv", names[:-1], [values[n] for n in names[:-1]])
    live.score_to_files(live.live_source(spark, str(inbox)), score, str(tmp_path / "out"), str(tmp_path / "mark"), trigger={"availableNow": True}).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    full = [r for r in got if r["job_id"] in ("a", "q, r")]
    assert len(full) == 2 and all(str(int(r[n])) == values[n] for r in full for n in names if n != "job_id")
    assert sum(r["job_id"] is None for r in got) == 2  # a row without an id is scored, a short row has NULLs
    kept_back = spark.read.json(str(tmp_path / "out_rejects")).collect()
    assert len(kept_back) == 2 and any("one too many" in r["line"] for r in kept_back)
