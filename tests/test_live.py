"""Live scoring: exactly the arrived rows, once each, across restarts and broken input."""

import csv

import pytest
from pyspark.sql import functions as F

from laggard.operators.scoring import add_predictions
from laggard.schemas import LIVE_JOB
from laggard.sources.generate import generate_live_jobs, live_job_stream
from laggard.streaming import live

NOW = {"availableNow": True}


def predict(rows):
    return add_predictions(rows.withColumn("skew_probability", F.col("num_tasks") / F.lit(300.0)), "xgboost")


def drop_file(folder, name, rows, extra=()):
    folder.mkdir(exist_ok=True)
    with open(folder / f".{name}", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(LIVE_JOB.fieldNames())
        out.writerows([list(r) for r in rows])
        for line in extra:
            f.write(line + "\n")
    (folder / f".{name}").rename(folder / name)


def run(spark, tmp_path, mode, **more):
    rows = live.live_source(spark, str(tmp_path / "in"))
    q = live.score_stream(
        rows, predict, str(tmp_path / "out"), str(tmp_path / "mark"), mode, str(tmp_path / "bad"), trigger=NOW, **more
    )
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    jobs = generate_live_jobs(spark, 60).collect()
    drop_file(tmp_path / "in", "a.csv", jobs[:40])
    assert run(spark, tmp_path, live.ABSOLUTE).count() == 40
    drop_file(tmp_path / "in", "b.csv", jobs[40:])
    out = run(spark, tmp_path, live.ABSOLUTE)
    want = predict(spark.createDataFrame(jobs, LIVE_JOB))
    assert out.count() == 60
    cols = ["job_id", "predicted_skew", "skew_probability", "threshold_used", "prediction_confidence"]
    assert out.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_repeated_ids_are_all_scored(spark, tmp_path):
    jobs = generate_live_jobs(spark, 5).collect()
    drop_file(tmp_path / "in", "a.csv", jobs + jobs)
    drop_file(tmp_path / "in", "b.csv", jobs)
    assert run(spark, tmp_path, live.ABSOLUTE).count() == 15


def test_broken_rows_are_set_aside(spark, tmp_path):
    jobs = generate_live_jobs(spark, 5).collect()
    drop_file(tmp_path / "in", "a.csv", jobs, ["LIVE_X,not a number,1", "LIVE_Y,a,b,c,d,e,f,g,h,i,j"])
    assert run(spark, tmp_path, live.ABSOLUTE).count() == 5
    assert spark.read.json(str(tmp_path / "bad")).count() == 2


def test_history_bands(spark, tmp_path):
    jobs = generate_live_jobs(spark, 90).collect()
    drop_file(tmp_path / "in", "a.csv", jobs[:30])
    first = run(spark, tmp_path, live.HISTORY)
    counts = {r["prediction_confidence"]: r["count"] for r in first.groupBy("prediction_confidence").count().collect()}
    assert counts == {"low": 10, "medium": 10, "high": 10}
    drop_file(tmp_path / "in", "b.csv", jobs[30:])
    out = run(spark, tmp_path, live.HISTORY)
    assert out.count() == 90
    assert out.filter("batch_id = 0").select("job_id", "prediction_confidence").exceptAll(
        first.select("job_id", "prediction_confidence")
    ).count() == 0


def test_unknown_mode(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError):
        run(spark, tmp_path, "other")


def test_file_sink(spark, tmp_path):
    drop_file(tmp_path / "in", "a.csv", generate_live_jobs(spark, 7).collect())
    rows = live.live_source(spark, str(tmp_path / "in"))
    live.score_to_files(rows, predict, str(tmp_path / "out"), str(tmp_path / "mark"), trigger=NOW).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_paced_source(spark):
    df = live_job_stream(spark, 5)
    assert df.isStreaming and df.schema.fieldNames() == LIVE_JOB.fieldNames()


def test_wide_files_are_read_by_several_tasks(spark, tmp_path):
    """A file of 100 columns, cut into many splits, beside one of another column order."""
    jobs = generate_live_jobs(spark, 400).collect()
    names = LIVE_JOB.fieldNames()
    (tmp_path / "in").mkdir()
    more = [f"extra_{i}" for i in range(100 - len(names))]
    with open(tmp_path / "in" / "wide.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(more[:50] + list(reversed(names)) + more[50:])
        out.writerows([["x, y"] * 50 + list(reversed(j)) + [""] * (len(more) - 50) for j in jobs[:300]])
        f.write("a,b\n\n" + "," * 5000 + "\n")
    drop_file(tmp_path / "in", "plain.csv", jobs[300:])
    parts = []

    def watched(rows):
        parts.append(rows._jdf.queryExecution().toRdd().getNumPartitions())
        return predict(rows)

    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = live.live_source(spark, str(tmp_path / "in"))
        live.score_stream(rows, watched, str(tmp_path / "out"), str(tmp_path / "mark"), live.ABSOLUTE, trigger=NOW).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    out = spark.read.parquet(str(tmp_path / "out"))
    want = predict(spark.createDataFrame(jobs, LIVE_JOB))
    # "a,b" lacks its number only: a short row is a row of nulls, as before.
    assert parts[0] > 4 and out.filter("job_id is not null").count() == 400
    assert out.select(*names, "skew_probability").exceptAll(want.select(*names, "skew_probability")).filter("job_id is not null").count() == 0
    assert spark.read.json(str(tmp_path / "out_rejects")).count() == 1


def test_header_marks(spark, tmp_path):
    """A byte order mark, carriage returns, quotes in the header, files without rows or columns."""
    jobs = generate_live_jobs(spark, 3).collect()
    (tmp_path / "in").mkdir()
    head = "﻿" + ",".join(f'"{n}"' for n in LIVE_JOB.fieldNames())
    lines = [",".join(str(x) for x in j) for j in jobs]
    (tmp_path / "in" / "a.csv").write_bytes("\r\n".join([head, *lines, ""]).encode())
    (tmp_path / "in" / "b.csv").write_text(head + "\n")
    (tmp_path / "in" / "c.csv").write_text("")
    (tmp_path / "in" / "d.csv").write_text("job_id,other\nz,1\n")
    assert run(spark, tmp_path, live.ABSOLUTE).count() == 3
    assert [r["line"] for r in spark.read.json(str(tmp_path / "bad")).collect()] == ["z,1"]


def test_lines_are_parsed_once(spark, tmp_path, monkeypatch):
    parsed = spark.sparkContext.accumulator(0)

    def count(text):
        parsed.add(1)
        return text

    plain, counted = live.job_rows, F.udf(count, "string")
    monkeypatch.setattr(live, "job_rows", lambda lines, schema: plain(lines, schema).withColumn(live.CORRUPT, counted(live.CORRUPT)))
    jobs = generate_live_jobs(spark, 5).collect()
    drop_file(tmp_path / "in", "a.csv", jobs, extra=["LIVE_X,not a number"])
    assert run(spark, tmp_path, live.ABSOLUTE).count() == 5
    assert spark.read.json(str(tmp_path / "bad")).count() == 1
    assert parsed.value == 6
