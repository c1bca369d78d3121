"""Scans in every layout, marts and generated rows."""

import pytest
from pyspark.sql import functions as F

from laggard.operators.features import pre_exec_features
from laggard.plans.mart import job_mart
from laggard.sources import generate, mart, trace

EVENT_ROWS = [
    "0,0,1,0,5,0,ann,2,1,0.5,0.25,0.1,0",
    "10,0,1,0,5,4,ann,2,1,0.5,0.25,0.1,0",
    "0,0,1,1,5,0,ann,2,1,0.5,,0.1,1",
    "50,0,1,1,5,4,ann,2,1,0.5,0.25,0.1,1",
    "0,0,1,2,5,0,ann,2,1,0.5,0.25,0.1,0",
    "10,0,1,2,5,4,ann,2,1,0.5,0.25,0.1,0",
]
NAMES = "timestamp,missing_info,job_id,task_index,machine_id,event_type,user_name,scheduling_class,priority,cpu_request,memory_request,disk_space_request,different_machine_constraint"


def put(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_headerless_events(spark, tmp_path):
    df = trace.read_trace(spark, put(tmp_path, "plain.csv", EVENT_ROWS))
    assert df.count() == 6 and df.columns == NAMES.split(",")
    row = job_mart(df).first()
    assert (row.num_tasks, row.max_task_runtime, row.is_skewed, row.template_id) == (3, 50.0, 1, "ann")


def test_event_header_in_any_order(spark, tmp_path):
    flip = lambda line: ",".join(reversed(line.split(",")))
    df = trace.read_trace(spark, put(tmp_path, "head.csv", [flip(NAMES), *[flip(r) for r in EVENT_ROWS]]))
    plain = trace.read_trace(spark, put(tmp_path, "plain.csv", EVENT_ROWS))
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str) == sorted(
        map(tuple, plain.select(*sorted(plain.columns)).collect()), key=str
    )


def test_direct_trace(spark, tmp_path):
    lines = [
        "collection_id,instance_index,time,user,start_time,end_time,resource_request,constraint,scheduling_class,priority",
        "job_a,0,5,bob,0,10,\"{'cpus': 0.5, 'memory': 0.25}\",[],1,100",
        "job_a,1,7,bob,0,10,\"{'cpus': 1.5, 'memory': 0.25}\",\"[{'a': 1}]\",1,bad",
        "job_a,2,9,bob,0,90,,,0,300",
        "job_b,0,1,eve,5,5,{},[],0,1",
        ",0,1,eve,5,9,{},[],0,1",
    ]
    path = put(tmp_path, "direct.csv", lines)
    assert trace.detect_format(trace.header_fields(spark, path)) == trace.DIRECT
    jobs = job_mart(trace.read_trace(spark, path)).collect()
    assert len(jobs) == 1
    r = jobs[0]
    assert (r.job_id, r.num_tasks, r.scheduling_class, r.user_name, r.submit_time) == ("job_a", 3, 1.0, "bob", 5.0)
    assert (r.cpu_request_mean, r.memory_request_std, r.priority) == (1.0, 0.0, 200.0)
    assert (r.different_machine_constraint_mean, r.disk_space_request_mean) == (0.5, 0.0)
    assert (r.max_task_runtime, r.is_skewed) == (90.0, 1)


def test_row_limit(spark, tmp_path):
    path = put(tmp_path, "plain.csv", EVENT_ROWS)
    assert trace.sample_trace(spark, path, 2).count() == 2
    assert trace.sample_trace(spark, path).count() == 6


def test_empty_submits(spark, tmp_path):
    df = trace.read_trace(spark, put(tmp_path, "plain.csv", EVENT_ROWS)).filter("event_type = 4")
    with pytest.raises(ValueError):
        pre_exec_features(df, check_empty=True)


def test_seeded_sample_keeps_whole_jobs(spark):
    df = spark.range(2000).select((F.col("id") % 100).alias("job_id"))
    kept = trace.seeded_sample(df, 0.3)
    assert {r["count"] for r in kept.groupBy("job_id").count().collect()} == {20}
    assert 10 <= kept.select("job_id").distinct().count() <= 50


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_mart_round_trip(spark, jobs, tmp_path, fmt):
    path = str(tmp_path / fmt)
    mart.write_mart(jobs, path, fmt)
    back = mart.read_mart(spark, path, fmt, jobs.schema)
    assert back.select(*jobs.columns).exceptAll(jobs).count() == 0 and back.count() == jobs.count()


def test_generated_rows(spark):
    a, b = generate.generate_live_jobs(spark, 200), generate.generate_live_jobs(spark.newSession(), 200)
    assert a.orderBy("job_id").collect() == b.repartition(3).orderBy("job_id").collect()
    r = a.agg(F.min("num_tasks"), F.max("num_tasks"), F.min("priority"), F.max("priority"), F.min("job_id")).first()
    assert 5 <= r[0] and r[1] <= 300 and 1 <= r[2] and r[3] < 450 and r[4] == "LIVE_000001"
    assert a.filter("cpu_request_std > cpu_request_mean * 0.5 OR cpu_request_std < 0.01").count() == 0


def test_generated_labels(spark):
    df = generate.generate_labelled_jobs(spark, 4000)
    share = df.agg(F.avg("is_skewed")).first()[0]
    assert share == pytest.approx(0.15, abs=0.02)
    assert df.filter("(max_task_runtime >= 2 * avg_task_runtime) <> (is_skewed = 1)").count() == 0


def test_origins(spark):
    a = generate.generate_live_jobs(spark, 3)
    b = generate.generate_labelled_jobs(spark, 2)
    out = mart.with_origin({"live": a, "made": b})
    assert {r["origin"]: r["count"] for r in out.groupBy("origin").count().collect()} == {"live": 3, "made": 2}
