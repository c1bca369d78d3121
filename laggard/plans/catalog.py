"""Named queries over the star-schema and event tables, with their SQL counterparts.

Each query is ``fn(spark, folder) -> DataFrame``.  Where the result can be said
in SQL the text sits beside it and is compared row by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.coerce import micros
from ..functions.draws import draw
from ..operators import baseline, clean, early, explore, features, labels, metrics, policy, runtimes, scoring, smote, splits, train
from ..operators.neighbours import nearest
from ..operators.ordered import with_running_sums
from ..operators.quantiles import exact_quantiles
from ..operators.staging import dealt, stage, stage_root
from ..schemas import EVENT13
from ..sources.generate import jobs_for_keys, labelled_columns
from ..sources.mart import read_mart, write_mart
from ..sources.trace import read_trace
from ..sources.tables import EVENT_CODES, activity_trace, item_tasks, order_attributes, order_trace
from ..streaming import live
from . import pipeline
from .mart import direct_mart, event_mart

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


# ------------------------------------------------------------ shared inputs

ITEMS = """items AS (
  SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS task_index, l_extendedprice AS duration,
         l_discount AS cpu_request, l_tax AS memory_request, l_quantity AS disk_space_request,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS scheduling_class,
         (l_linestatus = 'O')::INTEGER::DOUBLE AS different_machine_constraint, epoch_us(l_shipdate) AS end_time
  FROM lineitem)"""

TRACE = ITEMS + """, trace AS (
  SELECT items.*, epoch_us(o_orderdate) AS "timestamp", epoch_us(o_orderdate) AS start_time,
         substr(o_orderpriority, 1, 1)::DOUBLE AS priority, o_custkey::VARCHAR AS user_name
  FROM items JOIN orders ON job_id = o_orderkey)"""

STATS = """stats AS (
  SELECT job_id, avg(duration) AS avg_task_runtime, max(duration) AS max_task_runtime,
         coalesce(stddev_samp(duration), 0) AS std_task_runtime
  FROM items WHERE duration > 0 GROUP BY job_id),
labelled AS (
  SELECT *, (max_task_runtime >= 2 * avg_task_runtime)::INTEGER AS is_skewed FROM stats)"""

JOBS = ITEMS + ", " + STATS + """,
sizes AS (SELECT job_id, count(DISTINCT task_index) AS num_tasks FROM items GROUP BY job_id),
jobs AS (
  SELECT l.*, s.num_tasks, epoch_us(o_orderdate)::DOUBLE AS submit_time,
         substr(o_orderpriority, 1, 1)::DOUBLE AS priority, o_custkey::VARCHAR AS template_id
  FROM labelled l JOIN sizes s USING (job_id) JOIN orders ON o_orderkey = l.job_id)"""


def sql_draw(seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || ({key})::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


SCORES = JOBS + f""",
rule AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (num_tasks - 1) / 10.0::DOUBLE)) AS s FROM jobs),
scores AS (
  SELECT 'logistic_regression' AS model, *, s AS score FROM rule
  UNION ALL SELECT 'random_forest', *, least(1.0::DOUBLE, num_tasks / 8.0::DOUBLE) FROM rule
  UNION ALL SELECT 'xgboost', *, {sql_draw(7, 'job_id')} FROM rule
  UNION ALL SELECT 'lightgbm', *, {sql_draw(8, 'job_id')} * s FROM rule)"""


def order_jobs(spark, folder) -> DataFrame:
    """Labelled jobs with size, submit time, priority and template, joined one to one with orders."""
    jobs = direct_mart(item_tasks(spark, folder), clean=False, template=False, staged=False)
    own = order_attributes(spark, folder).withColumnsRenamed({"timestamp": "submit_time", "user_name": "template_id"})
    jobs = jobs.select("job_id", "num_tasks", "avg_task_runtime", "max_task_runtime", "std_task_runtime", "is_skewed",
                       "scheduling_class", "cpu_request_std", "memory_request_std", "disk_space_request_std")
    return jobs.join(own.withColumn("submit_time", F.col("submit_time").cast("double")), "job_id")


def written_jobs(spark, folder) -> DataFrame:
    """The same table written once, for operators that read it more than once."""
    return stage(order_jobs(spark, folder))


def rule_scores(spark, folder, jobs: DataFrame | None = None) -> DataFrame:
    """Long (model, job) scores: two size rules with many ties, and two seeded draws with none."""
    jobs = order_jobs(spark, folder) if jobs is None else jobs
    key, size = F.col("job_id"), F.col("num_tasks")
    rule = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (size - 1) / F.lit(10.0)))
    by_model = {
        "logistic_regression": rule,
        "random_forest": F.least(F.lit(1.0), size / F.lit(8.0)),
        "xgboost": draw(7, key),
        "lightgbm": draw(8, key) * rule,
    }
    cells = F.array(*[F.struct(F.lit(m).alias("model"), s.alias("score")) for m, s in by_model.items()])
    long = jobs.withColumn("_s", F.explode(cells))
    return long.select(
        "_s.model", *jobs.columns, F.col("is_skewed").alias("label"), "_s.score", F.col("_s.score").alias("skew_probability")
    )


# ------------------------------------------------------------------- labels


@query(f"WITH {ITEMS}, {STATS} SELECT job_id, round(avg_task_runtime, 6) AS avg_task_runtime, max_task_runtime, "
       "round(std_task_runtime, 4) AS std_task_runtime FROM stats")
def job_runtime_stats(spark, folder):
    out = labels.job_runtime_stats(runtimes.direct_runtimes(item_tasks(spark, folder)))
    return rounded(rounded(out, 6, "avg_task_runtime"), 4, "std_task_runtime")


@query(f"WITH {ITEMS}, {STATS} SELECT job_id, round(avg_task_runtime, 6) AS avg_task_runtime, max_task_runtime, "
       "round(std_task_runtime, 4) AS std_task_runtime, is_skewed FROM labelled")
def skew_labels(spark, folder):
    out = labels.label_from_runtimes(runtimes.direct_runtimes(item_tasks(spark, folder)))
    return rounded(rounded(out, 6, "avg_task_runtime"), 4, "std_task_runtime")


@query(f"""WITH {ITEMS}, {STATS} SELECT count(*) AS total_jobs, count(*) FILTER (is_skewed = 1) AS skewed_jobs,
  count(*) FILTER (is_skewed = 0) AS non_skewed_jobs, round(avg(is_skewed), 6) AS skew_ratio,
  round(coalesce(avg(max_task_runtime) FILTER (is_skewed = 1), 0), 4) AS avg_max_runtime_skewed,
  round(coalesce(avg(max_task_runtime) FILTER (is_skewed = 0), 0), 4) AS avg_max_runtime_non_skewed FROM labelled""")
def skew_statistics(spark, folder):
    out = labels.skew_statistics(labels.label_from_runtimes(runtimes.direct_runtimes(item_tasks(spark, folder))))
    return rounded(rounded(out, 6, "skew_ratio"), 4, "avg_max_runtime_skewed", "avg_max_runtime_non_skewed")


@query(f"""WITH {ITEMS}, {STATS} SELECT is_skewed, count(*) AS jobs,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM labelled), 6) AS pct FROM labelled GROUP BY is_skewed""")
def label_distribution(spark, folder):
    return labels.label_distribution(labels.label_from_runtimes(runtimes.direct_runtimes(item_tasks(spark, folder))))


@query(f"""WITH {ITEMS}, {STATS}, m AS (SELECT unnest([1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0]::DOUBLE[]) AS multiplier)
SELECT multiplier, sum((max_task_runtime >= multiplier * avg_task_runtime)::INTEGER)::BIGINT AS skewed_jobs,
  round(avg((max_task_runtime >= multiplier * avg_task_runtime)::INTEGER), 6) AS skew_share
FROM stats, m GROUP BY multiplier""")
def skew_multiplier_sweep(spark, folder):
    stats = labels.job_runtime_stats(runtimes.direct_runtimes(item_tasks(spark, folder)))
    return rounded(labels.multiplier_sweep(stats), 6, "skew_share")


@query("SELECT count(DISTINCT l_orderkey) AS jobs FROM lineitem")
def distinct_jobs(spark, folder):
    return labels.distinct_jobs(item_tasks(spark, folder))


@query("SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS task_index, l_extendedprice AS runtime FROM lineitem "
       "WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2)")
def multi_task_jobs(spark, folder):
    rows = runtimes.direct_runtimes(item_tasks(spark, folder)).select("job_id", "task_index", "runtime")
    return features.keep_multi_task_jobs(rows)


# ----------------------------------------------------- events and cleaning

EVENTS = """raw AS (
  SELECT epoch_us(ts) AS "timestamp", 0 AS missing_info, user_id AS job_id,
         regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 END AS event_type,
         value FROM events),
acts AS (
  SELECT "timestamp", missing_info, job_id, k % 10 AS task_index, event_type,
         CASE WHEN k % 7 <> 0 THEN value END AS cpu_request, CASE WHEN k % 5 <> 0 THEN k / 100.0::DOUBLE END AS memory_request,
         (k % 4)::DOUBLE AS priority, CASE WHEN k % 3 <> 0 THEN (k % 4)::INTEGER END AS scheduling_class FROM raw),
med AS (
  SELECT quantile_cont(cpu_request, 0.5) AS mc, quantile_cont(memory_request, 0.5) AS mm, quantile_cont(priority, 0.5) AS mp,
         quantile_cont(scheduling_class::DOUBLE, 0.5) AS ms FROM acts
  WHERE missing_info = 0 AND job_id >= 0 AND task_index >= 0 AND "timestamp" >= 0),
cleaned AS (
  SELECT "timestamp", job_id, task_index, event_type, coalesce(cpu_request, mc) AS cpu_request,
         coalesce(memory_request, mm) AS memory_request, coalesce(priority, mp) AS priority,
         coalesce(scheduling_class::DOUBLE, ms) AS scheduling_class
  FROM acts, med WHERE missing_info = 0 AND job_id >= 0 AND task_index >= 0 AND "timestamp" >= 0 AND event_type BETWEEN 0 AND 8),
pairs AS (
  SELECT s.job_id, s.task_index, s."timestamp" AS start_time, s.scheduling_class, s.priority, f."timestamp" AS end_time,
         (f."timestamp" - s."timestamp")::DOUBLE AS runtime
  FROM cleaned s JOIN cleaned f USING (job_id, task_index)
  WHERE s.event_type = 0 AND f.event_type = 4 AND f."timestamp" > s."timestamp")"""

CLEAN_COLS = '"timestamp", job_id, task_index, event_type, cpu_request, memory_request, priority, scheduling_class'


@query(f"WITH {EVENTS} SELECT {CLEAN_COLS} FROM cleaned")
def clean_events(spark, folder):
    return clean.clean_events(activity_trace(spark, folder)).drop("missing_info")


@query(f"WITH {EVENTS} SELECT mc AS cpu_request, mm AS memory_request, mp AS priority, ms AS scheduling_class FROM med")
def imputed_medians(spark, folder):
    names = ["cpu_request", "memory_request", "priority", "scheduling_class"]
    long = exact_quantiles(activity_trace(spark, folder), names, [0.5])
    return long.groupBy().pivot("column", names).agg(F.first("value"))


@query(f"""WITH {EVENTS} SELECT count(*) AS rows_before, count(*) FILTER (missing_info <> 0) AS removed_missing_info,
  count(*) FILTER (job_id IS NULL OR task_index IS NULL) AS removed_null_id,
  count(*) FILTER (job_id < 0 OR task_index < 0) AS removed_negative_id,
  count(*) FILTER ("timestamp" < 0) AS removed_negative_time,
  count(*) FILTER (event_type IS NULL) AS removed_unknown_event, count(*) FILTER (event_type IS NOT NULL) AS rows_after,
  round((1 - count(*) FILTER (event_type IS NOT NULL) / count(*)::DOUBLE) * 100, 6) AS pct_removed FROM acts""")
def cleaning_report(spark, folder):
    return clean.cleaning_report(activity_trace(spark, folder))


ROUGH = EVENTS.replace("0 AS missing_info, user_id AS job_id,", "0 AS missing_info, user_id,").replace(
    'SELECT "timestamp", missing_info, job_id, k % 10 AS task_index, event_type,',
    """SELECT CASE WHEN k % 31 = 0 THEN -"timestamp" ELSE "timestamp" END AS "timestamp",
         CASE WHEN k % 13 = 0 THEN 1 WHEN k % 17 <> 0 THEN 0 END AS missing_info,
         CASE WHEN k % 23 = 0 THEN -user_id - 1 WHEN k % 19 <> 0 THEN user_id END AS job_id, k % 10 AS task_index,
         CASE WHEN k % 29 = 0 THEN 99 ELSE event_type END AS event_type,""",
)


@query(f"WITH {ROUGH} SELECT {CLEAN_COLS} FROM cleaned")
def clean_rough_events(spark, folder):
    """Cleaning of events of which every row rule drops some."""
    return clean.clean_events(activity_trace(spark, folder, rough=True)).drop("missing_info")


@query(f"""WITH {ROUGH}, s AS (SELECT coalesce(missing_info = 0, false) AS a, job_id IS NOT NULL AND task_index IS NOT NULL AS b,
  coalesce(job_id >= 0 AND task_index >= 0, false) AS c, coalesce("timestamp" >= 0, false) AS d, coalesce(event_type BETWEEN 0 AND 8, false) AS e FROM acts)
SELECT count(*) AS rows_before, count(*) FILTER (NOT a) AS removed_missing_info, count(*) FILTER (a AND NOT b) AS removed_null_id,
  count(*) FILTER (a AND b AND NOT c) AS removed_negative_id, count(*) FILTER (a AND b AND c AND NOT d) AS removed_negative_time,
  count(*) FILTER (a AND b AND c AND d AND NOT e) AS removed_unknown_event, count(*) FILTER (a AND b AND c AND d AND e) AS rows_after,
  round((1 - count(*) FILTER (a AND b AND c AND d AND e) / count(*)::DOUBLE) * 100, 6) AS pct_removed FROM s""")
def cleaning_report_rough(spark, folder):
    return clean.cleaning_report(activity_trace(spark, folder, rough=True))


def as_csv(df: DataFrame, header: bool = True) -> str:
    """Folder of CSV files with the rows, as another program might have left them."""
    path = f"{stage_root(df.sparkSession)}/laggard/{uuid.uuid4().hex}"
    df.write.option("header", header).csv(path)
    return path


@query("""WITH raw AS (SELECT epoch_us(ts) AS t, user_id, event_type, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k FROM events)
SELECT 'job_' || user_id AS job_id, k % 10 AS task_index, t AS "timestamp", CASE WHEN k % 11 > 0 THEN (k % 4)::DOUBLE END AS priority,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 END AS event_type FROM raw""")
def csv_event_trace(spark, folder):
    """An event log with shuffled columns, names as job ids, whole numbers written 3.0, and broken fields."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    rows = spark.read.parquet(f"{folder}/events.parquet").select(k.alias("k"), "user_id", "ts", "event_type")
    code = F.create_map(*[F.lit(x) for pair in EVENT_CODES.items() for x in pair])
    trace = rows.select(
        F.element_at(code, F.col("event_type")).alias("event_type"), F.concat(F.lit("job_"), "user_id").alias("job_id"),
        F.when(F.col("k") % 11 == 0, F.lit("broken")).otherwise((F.col("k") % 4).cast("string")).alias("priority"),
        micros(F.col("ts")).alias("timestamp"), F.concat((F.col("k") % 10).cast("string"), F.lit(".0")).alias("task_index"),
    )
    return read_trace(spark, as_csv(trace)).select("job_id", "task_index", "timestamp", "priority", "event_type")


@query(f"WITH {EVENTS} SELECT job_id::VARCHAR AS job_id, task_index, \"timestamp\", 0 AS missing_info, event_type, priority, scheduling_class FROM acts")
def csv_headerless_trace(spark, folder):
    """An event log without a header whose whole numbers are written 3.0."""
    have = activity_trace(spark, folder)
    point = ("missing_info", "task_index", "event_type", "scheduling_class")
    columns = [
        (F.concat(F.col(c).cast("string"), F.lit(".0")) if c in point else F.col(c) if c in have.columns else F.lit(None).cast("string")).alias(c)
        for c in EVENT13.names
    ]
    back = read_trace(spark, as_csv(have.select(*columns), header=False))
    return back.select("job_id", "task_index", "timestamp", "missing_info", "event_type", "priority", "scheduling_class")


@query("""SELECT CASE WHEN l_partkey % 19 = 0 THEN l_orderkey || '.5' ELSE l_orderkey::VARCHAR END AS job_id, l_linenumber::BIGINT AS task_index,
  l_extendedprice AS runtime FROM lineitem""")
def csv_direct_trace(spark, folder):
    """A direct trace whose ids come as 7, 7.0 and 7.5: the first two are one job."""
    key = F.col("l_orderkey").cast("string")
    name = F.when(F.col("l_partkey") % 19 == 0, F.concat(key, F.lit(".5"))).when(F.col("l_partkey") % 2 == 0, F.concat(key, F.lit(".0"))).otherwise(key)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_extendedprice").alias("duration"), name.alias("collection_id"), F.col("l_linenumber").alias("instance_index"))
    back = clean.clean_trace(read_trace(spark, as_csv(rows)))
    return runtimes.extract_runtimes(back).select("job_id", "task_index", "runtime")


@query(f"WITH {EVENTS} SELECT job_id || '_' || task_index AS task_id, job_id, task_index, start_time, scheduling_class, priority, "
       "end_time, runtime FROM pairs")
def task_runtimes_event(spark, folder):
    return runtimes.event_runtimes(clean.clean_events(activity_trace(spark, folder)))


@query(f"WITH {EVENTS} SELECT job_id || '_' || task_index AS task_id, job_id, task_index, start_time, end_time, runtime FROM pairs")
def task_runtimes_hot(spark, folder):
    """The same pairs with every task of more than one pair treated as a huge one."""
    pairs = runtimes.event_runtimes(clean.clean_events(activity_trace(spark, folder)), hot_pairs=1, block=2)
    return pairs.select("task_id", "job_id", "task_index", "start_time", "end_time", "runtime")


@query(f"""WITH {EVENTS}, st AS (SELECT job_id, avg(runtime) AS a, max(runtime) AS m, coalesce(stddev_samp(runtime), 0) AS s
  FROM pairs GROUP BY job_id) SELECT job_id, round(a / 1e6, 4) AS avg_task_runtime, m AS max_task_runtime, round(s / 1e6, 4) AS std_task_runtime,
  (m >= 2 * a)::INTEGER AS is_skewed FROM st""")
def event_skew_labels(spark, folder):
    out = labels.label_jobs(runtimes.event_job_stats(clean.clean_events(activity_trace(spark, folder))))
    return in_seconds(out)


def in_seconds(df: DataFrame) -> DataFrame:
    """Mean and spread in seconds at four digits; microseconds would end in the last bits of a double."""
    return df.withColumns({c: F.round(F.col(c) / 1e6, 4) for c in ("avg_task_runtime", "std_task_runtime")})


@query(f"WITH {EVENTS}, st AS (SELECT job_id, avg(runtime) AS a, max(runtime) AS m, coalesce(stddev_samp(runtime), 0) AS s "
       "FROM pairs GROUP BY job_id) SELECT job_id, round(a / 1e6, 4) AS avg_task_runtime, m AS max_task_runtime, "
       "round(s / 1e6, 4) AS std_task_runtime, (m >= 2 * a)::INTEGER AS is_skewed FROM st")
def event_stats_hot(spark, folder):
    """The same statistics with every task treated as a huge one."""
    events = clean.clean_events(activity_trace(spark, folder))
    return in_seconds(labels.label_jobs(runtimes.event_job_stats(events, hot_rows=1)))


@query("""WITH r AS (SELECT l_orderkey AS job_id, (l_partkey % 50)::DOUBLE AS gap FROM lineitem)
SELECT job_id, round(avg(gap), 2) AS mean_gap, round(coalesce(stddev_samp(gap), 0), 4) AS std_task_runtime FROM r GROUP BY job_id""")
def tight_runtimes(spark, folder):
    """Spread of runtimes near 1e12 that differ by less than 50."""
    task = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    items = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = dealt(items, items.count(), "l_orderkey")
    rows = stage(items.select(F.col("l_orderkey").alias("job_id"), task.alias("task_index"), "l_partkey"))
    submit = rows.select("job_id", "task_index", F.lit(0).alias("event_type"), F.lit(1_000_000).cast("bigint").alias("timestamp"))
    end = F.lit(1_000_001_000_000) + F.col("l_partkey") % 50
    finish = rows.select("job_id", "task_index", F.lit(4).alias("event_type"), end.alias("timestamp"))
    out = runtimes.event_job_stats(submit.union(finish))
    out = out.select("job_id", (F.col("avg_task_runtime") - 1e12).alias("mean_gap"), "std_task_runtime")
    return rounded(rounded(out, 2, "mean_gap"), 4, "std_task_runtime")


@query(f"""WITH {ITEMS}, cl AS (SELECT * FROM items WHERE job_id IS NOT NULL AND job_id >= 0)
SELECT job_id, task_index, duration AS runtime FROM cl WHERE duration > 0""")
def task_runtimes_direct(spark, folder):
    rows = runtimes.extract_runtimes(clean.clean_trace(item_tasks(spark, folder).drop("end_time")))
    return rows.select("job_id", "task_index", "runtime")


@query(f"""WITH {TRACE}, d AS (SELECT job_id, task_index, (end_time - start_time)::DOUBLE AS raw FROM trace)
SELECT job_id, task_index, CASE WHEN (SELECT max(raw) FROM d) > 1e10 THEN raw / 1e6 ELSE raw END AS runtime FROM d WHERE raw > 0""")
def unit_scaling(spark, folder):
    rows = runtimes.direct_runtimes(order_trace(spark, folder).drop("duration"))
    return rows.select("job_id", "task_index", "runtime")


@query(f"""WITH {ITEMS} SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY end_time, duration, disk_space_request,
  cpu_request, memory_request, scheduling_class, different_machine_constraint) - 1 AS task_index, duration AS runtime, 0.0::DOUBLE AS priority, scheduling_class::DOUBLE AS scheduling_class FROM items""")
def prepared_tasks(spark, folder):
    rows = runtimes.direct_runtimes(item_tasks(spark, folder).drop("task_index"))
    order = ["end_time", "duration", "disk_space_request", "cpu_request", "memory_request", "scheduling_class", "different_machine_constraint"]
    out = clean.prepare_for_aggregation(rows, order)
    return out.select("job_id", "task_index", "runtime", "priority", "scheduling_class")


# ----------------------------------------------------------------- features

FEATS = TRACE + """, base AS (
  SELECT job_id, count(DISTINCT task_index) AS num_tasks, coalesce(avg(priority), 0) AS priority,
         coalesce(avg(cpu_request), 0) AS cpu_request_mean, coalesce(stddev_samp(cpu_request), 0) AS cpu_request_std,
         coalesce(avg(memory_request), 0) AS memory_request_mean, coalesce(stddev_samp(memory_request), 0) AS memory_request_std,
         coalesce(avg(disk_space_request), 0) AS disk_space_request_mean, coalesce(stddev_samp(disk_space_request), 0) AS disk_space_request_std,
         coalesce(avg(different_machine_constraint), 0) AS different_machine_constraint_mean, min("timestamp")::DOUBLE AS submit_time
  FROM trace GROUP BY job_id),
cls AS (SELECT job_id, scheduling_class, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, scheduling_class) AS r
  FROM trace WHERE scheduling_class IS NOT NULL GROUP BY job_id, scheduling_class),
usr AS (SELECT job_id, user_name, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, user_name) AS r
  FROM trace WHERE user_name IS NOT NULL GROUP BY job_id, user_name),
feats AS (
  SELECT base.*, coalesce(cls.scheduling_class, 0)::DOUBLE AS scheduling_class, usr.user_name FROM base
  LEFT JOIN cls ON base.job_id = cls.job_id AND cls.r = 1 LEFT JOIN usr ON base.job_id = usr.job_id AND usr.r = 1)"""

MEANS = ["priority", "cpu_request_mean", "cpu_request_std", "memory_request_mean", "memory_request_std",
         "disk_space_request_mean", "disk_space_request_std", "different_machine_constraint_mean"]
FEAT_COLS = "job_id, num_tasks, scheduling_class, " + ", ".join(f"round({c}, 6) AS {c}" for c in MEANS) + ", submit_time, user_name"


@query(f"WITH {FEATS} SELECT {FEAT_COLS} FROM feats")
def pre_exec_features(spark, folder):
    out = features.encode_categories(features.pre_exec_features(order_trace(spark, folder)))
    return rounded(out, 6, *MEANS)


@query(f"WITH {FEATS}, {STATS} SELECT {FEAT_COLS}, round(avg_task_runtime, 6) AS avg_task_runtime, max_task_runtime, "
       "round(std_task_runtime, 4) AS std_task_runtime, is_skewed, user_name AS template_id FROM feats JOIN labelled USING (job_id)")
def job_mart(spark, folder):
    return rounded(rounded(direct_mart(order_trace(spark, folder)), 6, *MEANS, "avg_task_runtime"), 4, "std_task_runtime")


@query(f"""WITH {EVENTS}, sub AS (SELECT * FROM cleaned WHERE event_type = 0),
base AS (SELECT job_id, count(DISTINCT task_index) AS num_tasks, avg(priority) AS priority, avg(cpu_request) AS cm,
  coalesce(stddev_samp(cpu_request), 0) AS cs, avg(memory_request) AS mm, coalesce(stddev_samp(memory_request), 0) AS ms,
  min("timestamp")::DOUBLE AS submit_time FROM sub GROUP BY job_id),
cls AS (SELECT job_id, scheduling_class, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, scheduling_class) AS r
  FROM sub GROUP BY job_id, scheduling_class),
st AS (SELECT job_id, avg(runtime) AS a, max(runtime) AS m FROM pairs GROUP BY job_id)
SELECT job_id, num_tasks, scheduling_class, round(priority, 6) AS priority, round(cm, 6) AS cpu_request_mean, round(cs, 6) AS cpu_request_std,
  round(base.mm, 6) AS memory_request_mean, round(base.ms, 6) AS memory_request_std, submit_time, m AS max_task_runtime, (m >= 2 * a)::INTEGER AS is_skewed
FROM base JOIN cls USING (job_id) JOIN st USING (job_id) WHERE r = 1""")
def event_job_mart(spark, folder):
    out = event_mart(clean.clean_events(activity_trace(spark, folder)))
    names = ["priority", "cpu_request_mean", "cpu_request_std", "memory_request_mean", "memory_request_std"]
    return rounded(out.select("job_id", "num_tasks", "scheduling_class", *names, "submit_time", "max_task_runtime", "is_skewed"), 6, *names)


@query(f"""WITH {ITEMS} SELECT job_id, count(*) AS num_tasks, round(avg(duration), 6) AS avg_task_runtime, max(duration) AS max_task_runtime,
  round(coalesce(stddev_samp(duration), 0), 4) AS std_task_runtime,
  arg_min(scheduling_class, (end_time, scheduling_class))::DOUBLE AS scheduling_class, 0.0::DOUBLE AS priority FROM items GROUP BY job_id""")
def aggregate_job_level(spark, folder):
    rows = runtimes.direct_runtimes(item_tasks(spark, folder))
    return rounded(rounded(features.aggregate_job_level(rows, "end_time"), 6, "avg_task_runtime"), 4, "std_task_runtime")


@query(f"""WITH {ITEMS}, p AS (SELECT quantile_cont(cpu_request, 0.99::DOUBLE) AS c, quantile_cont(memory_request, 0.99::DOUBLE) AS m,
  quantile_cont(disk_space_request, 0.99::DOUBLE) AS d FROM items)
SELECT job_id, task_index, round(least(cpu_request, c), 6) AS cpu_request, round(least(memory_request, m), 6) AS memory_request,
  round(least(disk_space_request, d), 6) AS disk_space_request FROM items, p""")
def capped_requests(spark, folder):
    rows = item_tasks(spark, folder).select("job_id", "task_index", *features.REQUESTS)
    return rounded(features.cap_requests(rows), 6, *features.REQUESTS)


BUCKETS = """, q AS (SELECT quantile_cont(priority, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS p,
  quantile_cont(num_tasks::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS n FROM jobs),
e AS (SELECT list_sort(list_distinct(p)) AS p, list_sort(list_distinct(n)) AS n FROM q),
b AS (SELECT job_id, len(list_filter(p[2:len(p) - 1], lambda x: x < priority))::INTEGER AS priority_bucket,
  len(list_filter(n[2:len(n) - 1], lambda x: x < num_tasks))::INTEGER AS num_tasks_bucket FROM jobs, e)"""


@query(f"WITH {JOBS}{BUCKETS} SELECT * FROM b")
def quantile_buckets(spark, folder):
    jobs = written_jobs(spark, folder)
    buckets = splits.quantile_buckets(jobs, ["priority", "num_tasks"])
    return jobs.select("job_id", *[b.alias(f"{c}_bucket") for c, b in buckets.items()])


@query(f"""WITH {JOBS}{BUCKETS}, cls AS (SELECT job_id, scheduling_class, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, scheduling_class) AS r
  FROM items WHERE scheduling_class IS NOT NULL GROUP BY job_id, scheduling_class)
SELECT job_id, scheduling_class || '|' || priority_bucket || '|' || num_tasks_bucket AS template_id FROM b JOIN cls USING (job_id) WHERE r = 1""")
def template_id(spark, folder):
    jobs = written_jobs(spark, folder).select("job_id", F.col("scheduling_class").cast("int"), "priority", "num_tasks")
    return splits.add_template_id(jobs).select("job_id", "template_id")


@query("""SELECT l_orderkey AS job_id, l_linenumber AS task_index, l_partkey, l_suppkey,
  CASE l_partkey % 6 WHEN 3 THEN 0.25::DOUBLE WHEN 4 THEN 0.5::DOUBLE WHEN 5 THEN 1.0::DOUBLE ELSE l_discount END AS cpu_request,
  CASE l_partkey % 6 WHEN 2 THEN l_tax WHEN 4 THEN 0.25::DOUBLE END AS memory_request, NULL::DOUBLE AS disk_space_request FROM lineitem""")
def parse_resource_literals(spark, folder):
    """Mapping literals that are no JSON: constants, tuples, a closing comma, ``.25``, line breaks."""
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    n, cpu, mem = F.col("l_partkey") % 6, F.col("l_discount").cast("string"), F.col("l_tax").cast("string")
    text = (
        F.when(n == 0, F.concat(F.lit("{'cpus': "), cpu, F.lit(", 'ok': True}")))
        .when(n == 1, F.concat(F.lit("{'cpus': "), cpu, F.lit(", 'shape': (1, None, 'a'), 'memory': (2,)}")))
        .when(n == 2, F.concat(F.lit("{'cpus': "), cpu, F.lit(", 'memory': "), mem, F.lit(", }")))
        .when(n == 3, F.lit("{'cpus': .25}"))
        .when(n == 4, F.lit("{'cpus': 0.5,\n 'memory': (0.25)}"))
        .otherwise(F.lit("{'cpus': True, 'cpu': 3.}"))
    )
    rows = rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("task_index"), "l_partkey", "l_suppkey", text.alias("resource_request"))
    return features.submit_rows(rows).select("job_id", "task_index", "l_partkey", "l_suppkey", *features.REQUESTS)


# Text columns built from lineitem as direct traces carry them.
def resource_texts(spark, folder) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    n = F.col("l_linenumber") % 6
    cpu, mem, disk = (F.col(c).cast("string") for c in ("l_discount", "l_tax", "l_quantity"))
    text = (
        F.when(n == 0, F.concat(F.lit("{'cpus': "), cpu, F.lit(", 'memory': "), mem, F.lit("}")))
        .when(n == 1, F.concat(F.lit("{'cpu': "), cpu, F.lit(", 'mem': "), mem, F.lit(", 'disk': "), disk, F.lit("}")))
        .when(n == 2, F.concat(F.lit("{'cpus': None, 'cpu': "), cpu, F.lit("}")))
        .when(n == 3, F.concat(F.lit(" {'memory': "), mem, F.lit(", 'disk_space': "), disk, F.lit("} ")))
        .when(n == 4, F.lit("not a mapping"))
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("resource_request"), "l_returnflag", "l_linestatus")


@query("""SELECT l_orderkey AS job_id, l_linenumber AS task_index, l_partkey, l_suppkey,
  CASE l_linenumber % 6 WHEN 0 THEN l_discount WHEN 1 THEN l_discount END AS cpu_request,
  CASE l_linenumber % 6 WHEN 0 THEN l_tax WHEN 1 THEN l_tax WHEN 3 THEN l_tax END AS memory_request,
  CASE l_linenumber % 6 WHEN 1 THEN l_quantity WHEN 3 THEN l_quantity END AS disk_space_request FROM lineitem""")
def parse_resource_request(spark, folder):
    rows = resource_texts(spark, folder)
    parsed = features.submit_rows(rows.withColumnsRenamed({"l_orderkey": "job_id", "l_linenumber": "task_index"}))
    return parsed.select("job_id", "task_index", "l_partkey", "l_suppkey", *features.REQUESTS)


@query("""SELECT l_orderkey AS job_id, l_linenumber AS task_index, l_partkey, l_suppkey,
  CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN 1.0::DOUBLE WHEN 4 THEN 0.0::DOUBLE
  WHEN 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag FROM lineitem""")
def constraint_flag(spark, folder):
    from ..functions.parse import constraint_flag as flag

    n, part = F.col("l_linenumber") % 7, F.col("l_partkey").cast("string")
    text = (
        F.when(n == 1, F.lit("  "))
        .when(n == 2, F.lit("[]"))
        .when(n == 3, F.concat(F.lit("[{'machine': "), part, F.lit("}]")))
        .when(n == 4, F.concat(F.lit("("), part, F.lit(")")))
        .when(n == 5, F.concat(F.lit("("), part, F.lit(",)")))
        .when(n == 6, F.concat(F.lit("machine "), part))
    )
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("task_index"), "l_partkey", "l_suppkey", flag(text).alias("flag"))


# ------------------------------------------------------------- early slices

EARLY = ITEMS + """, ks AS (SELECT unnest({ks}::DOUBLE[]) AS k),
ranked AS (SELECT job_id, duration, row_number() OVER (PARTITION BY job_id ORDER BY end_time, task_index, duration) AS rn,
  count(*) OVER (PARTITION BY job_id) AS n FROM items WHERE duration > 0),
cut AS (SELECT * FROM ranked, ks WHERE rn <= least(n, greatest(5, ceil(k * n)::BIGINT)))
SELECT job_id, {key}count(*) AS early_num_tasks, round(avg(duration), 6) AS early_avg_task_runtime,
  max(duration) AS early_max_task_runtime, round(stddev_pop(duration), 4) AS early_std_task_runtime FROM cut GROUP BY job_id{group}"""


@query("WITH " + EARLY.format(ks="[0.1]", key="", group=""))
def early_features(spark, folder):
    out = early.early_features(runtimes.direct_runtimes(item_tasks(spark, folder)))
    return rounded(rounded(out, 6, "early_avg_task_runtime"), 4, "early_std_task_runtime")


@query("WITH " + EARLY.format(ks="[0.1]", key="", group=""))
def early_features_hot(spark, folder):
    """The same slices with nearly every job cut into ranges, and a NULL job that is left out."""
    rows = runtimes.direct_runtimes(item_tasks(spark, folder))
    nobody = rows.filter("task_index = 1").withColumn("job_id", F.lit(None).cast("bigint"))
    out = early.early_features(rows.unionByName(nobody), hot_rows=2)
    return rounded(rounded(out, 6, "early_avg_task_runtime"), 4, "early_std_task_runtime")


@query("WITH " + EARLY.format(ks="[0.05, 0.1, 0.2, 0.5, 1.0]", key="k, ", group=", k"))
def early_features_sweep(spark, folder):
    rows = runtimes.direct_runtimes(item_tasks(spark, folder))
    out = early.early_features_sweep(rows, (0.05, 0.1, 0.2, 0.5, 1.0))
    return rounded(rounded(out, 6, "early_avg_task_runtime"), 4, "early_std_task_runtime")


# ------------------------------------------------------------------- splits

RANKED = ", o AS (SELECT *, row_number() OVER (ORDER BY submit_time NULLS LAST, job_id) - 1 AS r, count(*) OVER () AS n FROM jobs)"


@query(f"WITH {JOBS}{RANKED} SELECT job_id, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM o")
def time_split(spark, folder):
    return splits.time_split(written_jobs(spark, folder)).select("job_id", "split")


FOLDS = RANKED + """, f AS (SELECT *, greatest(1, floor(n * 0.2::DOUBLE)) AS w, greatest(1, floor(n * 0.4::DOUBLE)) AS s, fold
  FROM o, (SELECT unnest([0, 1, 2]) AS fold)),
rolled AS (SELECT job_id, is_skewed, fold, CASE WHEN r < s + fold * w THEN 'train' ELSE 'test' END AS split FROM f
  WHERE r < s + (fold + 1) * w AND s + (fold + 1) * w <= n)"""


@query(f"WITH {JOBS}{FOLDS} SELECT job_id, fold, split FROM rolled")
def rolling_splits(spark, folder):
    return splits.rolling_split(written_jobs(spark, folder)).select("job_id", "fold", "split")


@query(f"""WITH {JOBS}{FOLDS}, c AS (SELECT fold, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows,
  count(*) FILTER (split = 'train' AND is_skewed = 1) AS train_pos, count(*) FILTER (split = 'test' AND is_skewed = 1) AS test_pos
  FROM rolled GROUP BY fold) SELECT *, train_pos >= 6 AND test_pos > 0 AS valid FROM c""")
def rolling_fold_validity(spark, folder):
    return splits.fold_validity(splits.rolling_split(written_jobs(spark, folder)))


@query(f"""WITH {JOBS}, t AS (SELECT DISTINCT template_id FROM jobs),
d AS (SELECT template_id, row_number() OVER (ORDER BY {sql_draw(42, 'template_id')}, template_id) AS r, count(*) OVER () AS g FROM t)
SELECT job_id, template_id, CASE WHEN r <= ceil(0.2::DOUBLE * g) THEN 'test' ELSE 'train' END AS split FROM jobs JOIN d USING (template_id)""")
def template_split(spark, folder):
    return splits.template_split(written_jobs(spark, folder)).select("job_id", "template_id", "split")


STRATA = f""", c AS (SELECT is_skewed, count(*) AS c FROM jobs GROUP BY 1),
tot AS (SELECT ceil(sum(c) * 0.2::DOUBLE) AS total, sum(c) AS n FROM c),
ex AS (SELECT is_skewed, c, c * total / n::DOUBLE AS x, floor(c * total / n::DOUBLE) AS base, total FROM c, tot),
al AS (SELECT *, base + (row_number() OVER (ORDER BY base - x, is_skewed) <= total - sum(base) OVER ())::INTEGER AS take FROM ex),
rk AS (SELECT job_id, is_skewed, row_number() OVER (PARTITION BY is_skewed ORDER BY {sql_draw(42, 'job_id')}, job_id) - 1 AS r FROM jobs)"""


@query(f"WITH {JOBS}{STRATA} SELECT job_id, CASE WHEN r < take THEN 'test' ELSE 'train' END AS split FROM rk JOIN al USING (is_skewed)")
def stratified_split(spark, folder):
    return splits.stratified_split(written_jobs(spark, folder)).select("job_id", "split")


@query(f"WITH {JOBS}{STRATA} SELECT job_id, is_skewed FROM rk JOIN al USING (is_skewed) WHERE r < take")
def calibration_holdout(spark, folder):
    return splits.calibration_holdout(written_jobs(spark, folder))[1].select("job_id", "is_skewed")


@query(f"""WITH {JOBS}{STRATA} SELECT job_id, ((r >= c * 1 // 5)::INTEGER + (r >= c * 2 // 5)::INTEGER + (r >= c * 3 // 5)::INTEGER
  + (r >= c * 4 // 5)::INTEGER) AS fold FROM rk JOIN c USING (is_skewed)""")
def cv_folds(spark, folder):
    return splits.stratified_folds(written_jobs(spark, folder)).select("job_id", "fold")


@query(f"WITH {JOBS} SELECT job_id, num_tasks, is_skewed FROM jobs ORDER BY {sql_draw(42, 'job_id')}, job_id LIMIT 10")
def random_jobs(spark, folder):
    return splits.random_rows(order_jobs(spark, folder)).select("job_id", "num_tasks", "is_skewed")


# ------------------------------------------------------------------ metrics

CONF = """, cm AS (SELECT model, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM called GROUP BY model),
cls AS (SELECT model, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS "precision",
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1_score FROM cm)"""

CALLED = SCORES + ", called AS (SELECT *, is_skewed AS label, (score > 0.5::DOUBLE)::INTEGER AS pred FROM scores)"

RANK = """, steps AS (SELECT model, score, count(*) FILTER (is_skewed = 1) AS pos, count(*) FILTER (is_skewed = 0) AS neg FROM scores GROUP BY 1, 2),
run AS (SELECT *, (sum(pos) OVER w)::DOUBLE AS tp, (sum(neg) OVER w)::DOUBLE AS fp FROM steps WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
rnk AS (SELECT model, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS pr_auc,
  round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS roc_auc FROM run GROUP BY model)"""

EDGES = "list_transform(range(1, 11), lambda i: CASE WHEN i = 10 THEN 1.0::DOUBLE ELSE i * 0.1::DOUBLE END)"
BINS = f""", binned AS (SELECT *, len(list_filter({EDGES}, lambda e: e <= score))::INTEGER AS bin FROM scores)"""
ECE = BINS + """, bs AS (SELECT model, bin, count(*) AS n, sum(is_skewed)::DOUBLE AS y, sum(score) AS p FROM binned GROUP BY 1, 2),
ec AS (SELECT model, round(sum(CASE WHEN bin < 10 THEN abs(y - p) ELSE 0 END) / sum(n), 6) AS ece FROM bs GROUP BY model),
br AS (SELECT model, round(avg((score - is_skewed) * (score - is_skewed)), 6) AS brier FROM scores GROUP BY model)"""


def called(spark, folder, jobs: DataFrame | None = None) -> DataFrame:
    return rule_scores(spark, folder, jobs).withColumn("prediction", (F.col("score") > 0.5).cast("int"))


@query(f"WITH {CALLED}{CONF} SELECT * FROM cls")
def class_metrics(spark, folder):
    return rounded(metrics.class_metrics(called(spark, folder)), 6, *metrics.CLASS_METRICS)


@query(f"WITH {CALLED} SELECT model, y AS label, p AS prediction, count(*) FILTER (label = y AND pred = p) AS n "
       "FROM called, (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(p) GROUP BY 1, 2, 3")
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(called(spark, folder), ["model"])


@query(f"WITH {SCORES}{ECE} SELECT * FROM br")
def brier(spark, folder):
    return rounded(metrics.brier_score(rule_scores(spark, folder)), 6, "brier")


@query(f"WITH {SCORES}{ECE} SELECT * FROM ec")
def ece(spark, folder):
    return rounded(metrics.calibration_error(rule_scores(spark, folder)), 6, "ece")


@query(f"WITH {SCORES}{BINS} SELECT model, bin, count(*) AS n, round(avg(is_skewed), 6) AS accuracy, round(avg(score), 6) AS confidence "
       "FROM binned GROUP BY 1, 2")
def reliability_bins(spark, folder):
    return rounded(metrics.reliability_bins(rule_scores(spark, folder)), 6, "accuracy", "confidence")


@query(f"WITH {SCORES}{RANK} SELECT model, pr_auc FROM rnk")
def average_precision(spark, folder):
    return rounded(metrics.ranking_metrics(rule_scores(spark, folder)).select("model", "pr_auc"), 6, "pr_auc")


@query(f"WITH {SCORES}{RANK} SELECT model, roc_auc FROM rnk")
def roc_auc(spark, folder):
    return rounded(metrics.ranking_metrics(rule_scores(spark, folder)).select("model", "roc_auc"), 6, "roc_auc")


EVALUATED = CALLED + CONF + RANK + ECE


@query(f"WITH {EVALUATED} SELECT cls.*, pr_auc, roc_auc, brier, ece FROM cls JOIN rnk USING (model) JOIN br USING (model) JOIN ec USING (model)")
def evaluate_models(spark, folder):
    out = metrics.evaluate_scores(rule_scores(spark, folder))
    return rounded(out, 6, *metrics.CLASS_METRICS, *metrics.PROBA_METRICS)


@query(f"""WITH {SCORES}{FOLDS}, fs AS (SELECT model, fold, is_skewed, score FROM scores JOIN rolled r USING (job_id, is_skewed) WHERE split = 'test'),
cm AS (SELECT model, fold, count(*) FILTER (is_skewed = 1 AND score > 0.5) AS tp, count(*) FILTER (is_skewed = 0 AND score > 0.5) AS fp,
  count(*) FILTER (is_skewed = 1 AND score <= 0.5) AS fn, count(*) FILTER (is_skewed = 0 AND score <= 0.5) AS tn FROM fs GROUP BY 1, 2),
m AS (SELECT model, unnest([{{'m': 'accuracy', 'v': (tp + tn) / (tp + fp + fn + tn)::DOUBLE}},
  {{'m': 'precision', 'v': CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END}},
  {{'m': 'recall', 'v': CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END}},
  {{'m': 'f1_score', 'v': CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END}}]) AS x FROM cm)
SELECT model, x.m AS metric, round(avg(x.v), 6) AS mean, round(stddev_pop(x.v), 6) AS std FROM m GROUP BY 1, 2""")
def rolling_summary(spark, folder):
    tests = splits.rolling_split(written_jobs(spark, folder)).filter("split = 'test'")
    rows = called(spark, folder, tests)
    per_fold = metrics.long_metrics(metrics.class_metrics(rows, ["model", "fold"]), ["model", "fold"])
    return rounded(metrics.rolling_summary(per_fold), 6, "mean", "std")


SWEEP = """, lim AS (SELECT min(num_tasks)::DOUBLE AS lo, max(num_tasks)::DOUBLE AS hi FROM jobs),
cuts AS (SELECT i AS cut, CASE WHEN i = 99 THEN hi ELSE i * ((hi - lo) / 99) + lo END AS threshold FROM lim, (SELECT unnest(range(100))::INTEGER AS i)),
sw AS (SELECT cut, threshold, count(*) FILTER (num_tasks > threshold AND is_skewed = 1) AS tp, count(*) FILTER (num_tasks > threshold AND is_skewed = 0) AS fp,
  count(*) FILTER (num_tasks <= threshold AND is_skewed = 1) AS fn, count(*) FILTER (num_tasks <= threshold AND is_skewed = 0) AS tn FROM jobs, cuts GROUP BY 1, 2),
swept AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score FROM sw),
best AS (SELECT threshold, f1_score FROM swept ORDER BY f1_score DESC, cut LIMIT 1)"""


@query(f"WITH {JOBS}{SWEEP} SELECT cut, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(f1_score, 6) AS f1_score FROM swept")
def baseline_sweep(spark, folder):
    return rounded(baseline.baseline_sweep(written_jobs(spark, folder)), 6, "threshold", "f1_score")


@query(f"WITH {JOBS}{SWEEP} SELECT round(threshold, 6) AS threshold, round(f1_score, 6) AS f1_score FROM best")
def baseline_best_threshold(spark, folder):
    return rounded(baseline.best_threshold(written_jobs(spark, folder)), 6, "threshold", "f1_score")


@query(f"""WITH {JOBS}, m AS (SELECT quantile_cont(num_tasks::DOUBLE, 0.5) AS t FROM jobs)
SELECT job_id, t AS baseline_threshold, (num_tasks > t)::INTEGER AS baseline_prediction FROM jobs, m""")
def baseline_median(spark, folder):
    return baseline.baseline_predict(written_jobs(spark, folder)).select("job_id", "baseline_threshold", "baseline_prediction")


BASE = SWEEP + """, bm AS (SELECT count(*) FILTER (is_skewed = 1 AND num_tasks > threshold) AS tp, count(*) FILTER (is_skewed = 0 AND num_tasks > threshold) AS fp,
  count(*) FILTER (is_skewed = 1 AND num_tasks <= threshold) AS fn, count(*) FILTER (is_skewed = 0 AND num_tasks <= threshold) AS tn,
  any_value(threshold) AS threshold FROM jobs, best),
bl AS (SELECT 'baseline' AS model, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS "precision",
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1_score, threshold FROM bm)"""


@query(f"WITH {JOBS}{BASE} SELECT model, accuracy, \"precision\", recall, f1_score, round(threshold, 6) AS threshold FROM bl")
def baseline_evaluation(spark, folder):
    return rounded(baseline.evaluate_baseline(written_jobs(spark, folder)), 6, *metrics.CLASS_METRICS, "threshold")


@query(f"""WITH {EVALUATED}{BASE} SELECT cls.*, pr_auc, roc_auc, brier, ece FROM cls JOIN rnk USING (model) JOIN br USING (model) JOIN ec USING (model)
UNION ALL SELECT model, accuracy, "precision", recall, f1_score, NULL, NULL, NULL, NULL FROM bl""")
def model_comparison(spark, folder):
    jobs = written_jobs(spark, folder)
    rule = baseline.evaluate_baseline(jobs).drop("threshold")
    out = metrics.comparison_table(metrics.evaluate_scores(rule_scores(spark, folder, jobs)), rule)
    return rounded(out, 6, *metrics.CLASS_METRICS, *metrics.PROBA_METRICS)


GRID = """, g AS (SELECT i, CASE WHEN i = 100 THEN 1.0::DOUBLE ELSE i * 0.01::DOUBLE END AS threshold FROM (SELECT unnest(range(101)) AS i)),
ts AS (SELECT model, threshold, count(*) FILTER (score >= threshold AND is_skewed = 1) AS tp, count(*) FILTER (score >= threshold AND is_skewed = 0) AS fp,
  count(*) FILTER (score < threshold AND is_skewed = 1) AS fn, count(*) FILTER (score < threshold AND is_skewed = 0) AS tn FROM scores, g GROUP BY 1, 2),
tm AS (SELECT *, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS prec,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS rec, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM ts)"""


@query(f"""WITH {SCORES}{GRID} SELECT model, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(accuracy, 6) AS accuracy,
  round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1_score FROM tm""")
def threshold_sweep(spark, folder):
    return rounded(metrics.threshold_sweep(rule_scores(spark, folder)), 6, "threshold", *metrics.CLASS_METRICS)


@query(f"""WITH {SCORES}{RANK}{GRID},
a AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS r FROM tm),
b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold DESC) AS r FROM tm WHERE rec >= 0.8::DOUBLE)
SELECT rnk.*, round(a.threshold, 6) AS best_f1_threshold, round(a.f1, 6) AS best_f1, round(a.prec, 6) AS precision_at_best_f1, round(a.rec, 6) AS recall_at_best_f1,
  round(b.threshold, 6) AS threshold_recall_ge, round(b.prec, 6) AS precision_recall_ge, round(b.rec, 6) AS recall_recall_ge, round(b.f1, 6) AS f1_recall_ge
FROM rnk JOIN a ON rnk.model = a.model AND a.r = 1 LEFT JOIN b ON rnk.model = b.model AND b.r = 1""")
def best_thresholds(spark, folder):
    out = metrics.best_thresholds(rule_scores(spark, folder))
    return rounded(out, 6, *[c for c in out.columns if c != "model"])


@query(f"WITH {EVALUATED} SELECT model, f1_score, CASE WHEN f1_score > 0.7 THEN 'good' WHEN f1_score > 0.5 THEN 'moderate' ELSE 'poor' END AS quality FROM cls")
def quality_bands(spark, folder):
    out = metrics.class_metrics(called(spark, folder)).select("model", F.round("f1_score", 6).alias("f1_score"))
    return out.withColumn("quality", metrics.quality_band(F.col("f1_score")))


# -------------------------------------------------------- scores and policy

CUTS = """, th AS (SELECT * FROM (VALUES ('logistic_regression', 0.10::DOUBLE, 0.03::DOUBLE, 0.08::DOUBLE), ('random_forest', 0.08, 0.025, 0.07),
  ('xgboost', 0.07, 0.025, 0.07), ('lightgbm', 0.23, 0.04, 0.10)) t(model, cut, low, high)),
pr AS (SELECT s.model, job_id, is_skewed, max_task_runtime, score, (score >= cut)::INTEGER AS predicted_skew, cut,
  CASE WHEN score <= 0.02::DOUBLE OR score >= 0.98::DOUBLE OR abs(score - cut) >= high THEN 'high' WHEN abs(score - cut) >= low THEN 'medium' ELSE 'low' END AS conf
  FROM scores s JOIN th USING (model))"""


@query(f"WITH {SCORES}{CUTS} SELECT model, job_id, predicted_skew, round(score, 9) AS skew_probability, cut AS threshold_used, conf AS prediction_confidence FROM pr")
def score_bands(spark, folder):
    out = scoring.add_predictions_by_model(rule_scores(spark, folder))
    return rounded(out.select("model", "job_id", "predicted_skew", "skew_probability", "threshold_used", "prediction_confidence"), 9, "skew_probability")


@query(f"""WITH {SCORES}{CUTS} SELECT model, job_id, predicted_skew AS prediction, round(score, 9) AS skew_probability, predicted_skew = 1 AS is_skewed, cut AS threshold_used, conf AS confidence,
  CASE WHEN predicted_skew = 1 AND score > 0.8::DOUBLE THEN 'HIGH RISK: Job likely to be skewed. Consider increasing parallelism or enabling skew handling.'
  WHEN predicted_skew = 1 THEN 'MODERATE RISK: Job may be skewed. Monitor closely during execution.'
  WHEN score < 0.2::DOUBLE THEN 'LOW RISK: Job appears balanced. Normal execution expected.'
  ELSE 'LOW-MODERATE RISK: Job likely balanced but monitor for unexpected skew.' END AS recommendation FROM pr""")
def recommendations(spark, folder):
    out = scoring.score_report(scoring.add_predictions_by_model(rule_scores(spark, folder)))
    return rounded(out, 9, "skew_probability")


@query(f"WITH {SCORES}{CUTS} SELECT round(avg((is_skewed = predicted_skew)::INTEGER), 6) AS accuracy FROM pr")
def batch_accuracy(spark, folder):
    out = metrics.prediction_accuracy(scoring.add_predictions_by_model(rule_scores(spark, folder)))
    return rounded(out, 6, "accuracy")


POLICY = """, co AS (SELECT *, CASE WHEN predicted_skew = 1 AND is_skewed = 1 THEN max_task_runtime * (1 - 0.3::DOUBLE)
  WHEN predicted_skew = 1 THEN max_task_runtime * (1 + 0.05::DOUBLE) ELSE max_task_runtime END AS adj FROM pr),
po AS (SELECT model, cut, count(*) AS jobs, sum(predicted_skew)::BIGINT AS mitigations, sum(is_skewed)::BIGINT AS true_skewed,
  count(*) FILTER (predicted_skew = 1 AND is_skewed = 1) AS true_mitigated, count(*) FILTER (predicted_skew = 1 AND is_skewed = 0) AS false_mitigated,
  round(sum(max_task_runtime), 4) AS baseline_total, round(sum(adj), 4) AS adjusted_total,
  round((sum(max_task_runtime) - sum(adj)) / sum(max_task_runtime), 9) AS relative_improvement FROM co GROUP BY model, cut)"""
POLICY_COLS = "jobs, mitigations, true_skewed, true_mitigated, false_mitigated, baseline_total, adjusted_total, relative_improvement"
POLICY_RATES = """round(mitigations / jobs::DOUBLE, 9) AS mitigation_rate, round(true_mitigated / greatest(mitigations, 1)::DOUBLE, 9) AS precision_mitigation,
  round(true_mitigated / greatest(true_skewed, 1)::DOUBLE, 9) AS recall_on_skew"""


def _policy_digits(df: DataFrame) -> DataFrame:
    rates = [c for c in ("relative_improvement", "mitigation_rate", "precision_mitigation", "recall_on_skew") if c in df.columns]
    return rounded(rounded(df, 4, "baseline_total", "adjusted_total"), 9, *rates)


@query(f"WITH {SCORES}{CUTS}{POLICY} SELECT {POLICY_COLS} FROM po WHERE model = 'logistic_regression'")
def policy_impact(spark, folder):
    one = rule_scores(spark, folder).filter("model = 'logistic_regression'")
    return _policy_digits(policy.policy_impact(one, "logistic_regression"))


@query(f"WITH {SCORES}{CUTS}{POLICY} SELECT model, cut AS threshold, {POLICY_COLS}, {POLICY_RATES} FROM po")
def policy_comparison(spark, folder):
    return _policy_digits(policy.compare_policies(rule_scores(spark, folder)))


@query(f"""WITH {SCORES}{RANKED}, late AS (SELECT job_id FROM o WHERE r >= floor(n * 0.8::DOUBLE)){CUTS.replace('FROM scores s', 'FROM (SELECT * FROM scores WHERE job_id IN (SELECT job_id FROM late)) s')}{POLICY}
SELECT model, cut AS threshold, {POLICY_COLS}, {POLICY_RATES} FROM po""")
def policy_on_test_jobs(spark, folder):
    late = splits.time_split(written_jobs(spark, folder)).filter("split = 'test'")
    return _policy_digits(policy.compare_policies(rule_scores(spark, folder, late)))


@query(f"""WITH {SCORES}{RANKED}, dev AS (SELECT job_id, coalesce(stddev_samp(cpu_request), 0) AS c, coalesce(stddev_samp(memory_request), 0) AS m,
  coalesce(stddev_samp(disk_space_request), 0) AS d FROM items GROUP BY job_id),
h AS (SELECT o.job_id, (r >= floor(n * 0.8::DOUBLE))::INTEGER AS is_new, s.score, o.num_tasks, o.priority, c, m, d
  FROM o JOIN dev ON o.job_id = dev.job_id JOIN scores s ON s.job_id = o.job_id AND s.model = 'xgboost'),
lim AS (SELECT min(num_tasks) AS a0, max(num_tasks) AS a1, min(priority) AS b0, max(priority) AS b1, min(c) AS c0, max(c) AS c1, min(m) AS m0, max(m) AS m1,
  min(d) AS d0, max(d) AS d1 FROM h),
dm AS (SELECT job_id, is_new, score * 0.6::DOUBLE + (num_tasks - a0) / (a1 - a0)::DOUBLE * 0.15::DOUBLE + (priority - b0) / (b1 - b0) * 0.1::DOUBLE
  + (c - c0) / (c1 - c0) * 0.05::DOUBLE + (m - m0) / (m1 - m0) * 0.05::DOUBLE + (d - d0) / (d1 - d0) * 0.05::DOUBLE AS demo FROM h, lim),
rk AS (SELECT job_id, is_new, row_number() OVER (ORDER BY demo, is_new, job_id) / count(*) OVER ()::DOUBLE AS pct FROM dm)
SELECT job_id, CASE WHEN pct <= 1.0::DOUBLE / 3 THEN 'low' WHEN pct <= 2.0::DOUBLE / 3 THEN 'medium' ELSE 'high' END AS prediction_confidence FROM rk WHERE is_new = 1""")
def history_confidence(spark, folder):
    jobs = splits.time_split(rule_scores(spark, folder, written_jobs(spark, folder)).filter("model = 'xgboost'"))
    old, new = jobs.filter("split = 'train'"), jobs.filter("split = 'test'")
    return scoring.history_confidence(new, old).select("job_id", "prediction_confidence")


# ---------------------------------------------------------------- summaries


def _describe_sql(by: str, source: str, names: list[str]) -> str:
    cells = ", ".join(f"{{'c': '{c}', 'x': {c}::DOUBLE}}" for c in names)
    key = f"{by}, " if by else ""
    return f"""WITH {JOBS}, u AS (SELECT {key}unnest([{cells}]) AS z FROM {source})
SELECT {key}z.c AS "column", count(z.x) AS "count", round(avg(z.x), 4) AS mean, round(stddev_samp(z.x), 4) AS std, min(z.x) AS "min", max(z.x) AS "max",
  round(quantile_cont(z.x, 0.25::DOUBLE), 4) AS p25, round(quantile_cont(z.x, 0.5::DOUBLE), 4) AS p50, round(quantile_cont(z.x, 0.75::DOUBLE), 4) AS p75
FROM u GROUP BY {key}z.c"""


DESCRIBED = ["num_tasks", "avg_task_runtime", "max_task_runtime", "std_task_runtime", "priority"]
DIGITS = ("mean", "std", "p25", "p50", "p75")


@query(_describe_sql("", "jobs", DESCRIBED))
def describe_jobs(spark, folder):
    return rounded(explore.describe(written_jobs(spark, folder), DESCRIBED), 4, *DIGITS)


@query(_describe_sql("is_skewed", "jobs", DESCRIBED))
def describe_by_label(spark, folder):
    return rounded(explore.describe(written_jobs(spark, folder), DESCRIBED, ["is_skewed"]), 4, *DIGITS)


@query(f"""WITH {JOBS}, g AS (SELECT CASE WHEN num_tasks % 3 > 0 THEN num_tasks % 3 END AS grp, max_task_runtime AS x FROM jobs)
SELECT grp, prob, round(quantile_cont(x, [0.1, 0.5, 0.99]::DOUBLE[])[i], 4) AS "value"
FROM g, (VALUES (1, 0.1::DOUBLE), (2, 0.5::DOUBLE), (3, 0.99::DOUBLE)) v(i, prob) GROUP BY grp, prob, i""")
def quantile_ranges(spark, folder):
    """Quantiles per group, one of them NULL, with all values cut into ranges."""
    size = F.col("num_tasks") % 3
    jobs = written_jobs(spark, folder).select(F.when(size > 0, size).alias("grp"), "max_task_runtime")
    out = exact_quantiles(jobs, ["max_task_runtime"], [0.1, 0.5, 0.99], ["grp"], few_values=0)
    return rounded(out.select("grp", "prob", "value"), 4, "value")


@query(f"""WITH {JOBS}, g AS (SELECT job_id, CASE WHEN num_tasks % 3 > 0 THEN num_tasks % 3 END AS grp, num_tasks FROM jobs)
SELECT job_id, grp, sum(num_tasks) OVER (PARTITION BY grp ORDER BY job_id)::BIGINT AS upto FROM g""")
def running_sum_ranges(spark, folder):
    """Running sums per group, one of them NULL, over rows cut into ranges."""
    size = F.col("num_tasks") % 3
    jobs = order_jobs(spark, folder).select("job_id", F.when(size > 0, size).alias("grp"), "num_tasks")
    return with_running_sums(jobs, ["grp"], [F.col("job_id")], {"upto": "num_tasks"}, few_rows=0).select("job_id", "grp", "upto")


@query(f"WITH {JOBS} SELECT num_tasks, count(*) AS n FROM jobs GROUP BY num_tasks")
def size_counts(spark, folder):
    return explore.value_counts(order_jobs(spark, folder), "num_tasks")


@query(f"""WITH {JOBS}, lim AS (SELECT is_skewed, min(max_task_runtime) AS lo, (max(max_task_runtime) - min(max_task_runtime)) / 50 AS w, count(*) AS t FROM jobs GROUP BY 1)
SELECT l.is_skewed, i::INTEGER AS bin, round(l.lo + i * w, 4) AS "left",
  count(*) FILTER (x >= l.lo + i * w AND (x < l.lo + (i + 1) * w OR i = 49)) AS n,
  round(count(*) FILTER (x >= l.lo + i * w AND (x < l.lo + (i + 1) * w OR i = 49)) / (any_value(t) * w), 9) AS density
FROM lim l CROSS JOIN range(50) r(i) JOIN (SELECT is_skewed, max_task_runtime AS x FROM jobs) v USING (is_skewed) GROUP BY l.is_skewed, i, l.lo, w""")
def runtime_histogram(spark, folder):
    out = explore.histogram(written_jobs(spark, folder), "max_task_runtime", "is_skewed")
    return rounded(rounded(out, 4, "left"), 9, "density")


CORR = ["num_tasks", "avg_task_runtime", "max_task_runtime", "std_task_runtime", "priority", "is_skewed"]


def _corr_sql(names: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr FROM jobs" for a in names for b in names
    )
    return f"WITH {JOBS} {rows}"


@query(_corr_sql(CORR))
def correlation_matrix(spark, folder):
    return rounded(explore.correlations(order_jobs(spark, folder), CORR), 6, "corr")


@query(f"WITH {FEATS}, {STATS}, m AS (SELECT * FROM feats JOIN labelled USING (job_id)) "
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, is_skewed), 6) AS corr FROM m" for c in features.PRE_EXEC_FEATURES))
def label_correlations(spark, folder):
    return rounded(explore.label_correlations(direct_mart(order_trace(spark, folder))), 6, "corr")


BOXED = ["num_tasks", "avg_task_runtime", "max_task_runtime", "std_task_runtime", "priority"]


@query(f"""WITH {JOBS}, u AS (SELECT is_skewed, unnest([{', '.join(f"{{'c': '{c}', 'x': {c}::DOUBLE}}" for c in BOXED)}]) AS z FROM jobs),
q AS (SELECT is_skewed, z.c AS c, quantile_cont(z.x, 0.25::DOUBLE) AS q1, quantile_cont(z.x, 0.5::DOUBLE) AS q2, quantile_cont(z.x, 0.75::DOUBLE) AS q3 FROM u GROUP BY 1, 2)
SELECT u.is_skewed, c AS "column", round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
  round(min(z.x) FILTER (z.x >= q1 - 1.5::DOUBLE * (q3 - q1) AND z.x <= q3 + 1.5::DOUBLE * (q3 - q1)), 4) AS whisker_low,
  round(max(z.x) FILTER (z.x >= q1 - 1.5::DOUBLE * (q3 - q1) AND z.x <= q3 + 1.5::DOUBLE * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (z.x < q1 - 1.5::DOUBLE * (q3 - q1) OR z.x > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers
FROM u JOIN q ON u.is_skewed = q.is_skewed AND u.z.c = q.c GROUP BY 1, 2""")
def box_stats(spark, folder):
    out = explore.box_stats(written_jobs(spark, folder), BOXED)
    return rounded(out, 4, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(f"WITH {ITEMS}, {STATS} SELECT job_id, is_skewed, round(avg_task_runtime, 6) AS avg_task_runtime, max_task_runtime, "
       "round(max_task_runtime / avg_task_runtime, 6) AS max_over_avg FROM labelled")
def avg_max_points(spark, folder):
    out = explore.avg_max_points(labels.label_from_runtimes(runtimes.direct_runtimes(item_tasks(spark, folder))))
    return rounded(out, 6, "avg_task_runtime", "max_over_avg")


@query("""SELECT c AS "column", n AS non_null, t AS "rows", k AS type, 6 AS "columns" FROM (
  SELECT unnest([{'c': 'event_id', 'n': count(event_id), 'k': 'bigint'}, {'c': 'ts', 'n': count(ts), 'k': 'timestamp_ntz'},
  {'c': 'user_id', 'n': count(user_id), 'k': 'bigint'}, {'c': 'event_type', 'n': count(event_type), 'k': 'string'},
  {'c': 'value', 'n': count(value), 'k': 'double'}, {'c': 'props', 'n': count(props), 'k': 'string'}], recursive := true), count(*) AS t FROM events)""")
def table_shape(spark, folder):
    return explore.shape(spark.read.parquet(f"{folder}/events.parquet"))


# ------------------------------------------------- oversampling and learning

def trained_jobs(spark, folder) -> DataFrame:
    """Written job mart of the full order trace."""
    return stage(direct_mart(order_trace(spark, folder)))


VEC = "[num_tasks::DOUBLE, scheduling_class, priority, cpu_request_mean, cpu_request_std, memory_request_mean, memory_request_std, disk_space_request_mean, disk_space_request_std, different_machine_constraint_mean]"


@query(f"""WITH {FEATS}, {STATS}, p AS (SELECT job_id, {VEC} AS v FROM feats JOIN labelled USING (job_id) WHERE is_skewed = 1),
d AS (SELECT a.job_id, list_distance(a.v, b.v) AS dist FROM p a JOIN p b ON a.job_id <> b.job_id),
r AS (SELECT job_id, dist, row_number() OVER (PARTITION BY job_id ORDER BY dist) AS nth FROM d)
SELECT job_id::VARCHAR AS id, nth::INTEGER AS nth, round(dist, 6) AS dist FROM r WHERE nth <= 5""")
def minority_neighbours(spark, folder):
    frame = features.training_frame(trained_jobs(spark, folder)).filter("label = 1")
    points = frame.select(F.col("job_id").alias("id"), vector_to_array("features").alias("vec"), F.lit(1).alias("copies"))
    return rounded(nearest(points).select("id", "nth", "dist"), 6, "dist")


@query(f"WITH {ITEMS}, {STATS}, c AS (SELECT greatest(count(*) FILTER (is_skewed = 1), count(*) FILTER (is_skewed = 0)) AS n FROM labelled) "
       "SELECT unnest([0, 1]) AS label, n FROM c")
def smote_balance(spark, folder):
    out = smote.balance_classes(features.training_frame(trained_jobs(spark, folder)))
    return out.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


_NAMES = ("num_tasks", "scheduling_class", "priority", "cpu_request_mean", "cpu_request_std", "memory_request_mean", "memory_request_std",
          "disk_space_request_mean", "disk_space_request_std", "different_machine_constraint_mean")


@query(f"""WITH {FEATS}, {STATS}, f AS (SELECT is_skewed, [floor(x * 1000 + 0.2718::DOUBLE) / 1000.0::DOUBLE FOR x IN {VEC}] AS v FROM feats JOIN labelled USING (job_id)),
n AS (SELECT count(*) FILTER (is_skewed = 1) AS few, count(*) FILTER (is_skewed = 0) AS many FROM f),
p AS (SELECT v, count(*) AS copies, sha256(array_to_string([x::VARCHAR FOR x IN v], ',')) AS id FROM f WHERE is_skewed = 1 GROUP BY v),
near AS (SELECT a.id, b.v AS ov, b.copies AS oc, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS nth FROM p a JOIN p b ON a.id <> b.id),
g AS (SELECT id, flatten(list([ov FOR x IN range(least(oc, 5))] ORDER BY nth)) AS others FROM near WHERE nth <= 5 GROUP BY id),
s AS (SELECT p.*, others, sum(copies) OVER (ORDER BY id)::BIGINT AS upto FROM p LEFT JOIN g USING (id)),
z AS (SELECT id, v, list_concat([v FOR x IN range(least(copies - 1, 5))], others)[1:5] AS slots, (upto * (many - few)) // few - ((upto - copies) * (many - few)) // few AS made FROM s, n),
e AS (SELECT id, v, slots, unnest(range(made)) AS i FROM z),
d AS (SELECT id, i, v, {sql_draw('42-gap', "id || ':' || i")} AS gap, slots[floor({sql_draw('42-slot', "id || ':' || i")} * len(slots))::INTEGER + 1] AS t FROM e)
SELECT 'synthetic-' || id || '-' || i AS id, {", ".join(f"round(v[{i}] + gap * (t[{i}] - v[{i}]), 6) AS {c}" for i, c in enumerate(_NAMES, 1))} FROM d""")
def smote_rows(spark, folder):
    """The synthetic jobs that balance the skewed ones: every vector, not their number only.

    Features are cut to three digits, off the ties of short decimal fractions, so that two engines have the same points.
    """
    frame = features.training_frame(trained_jobs(spark, folder))
    jobs = stage(frame.select("label", F.transform(vector_to_array("features"), lambda x: F.floor(x * 1000 + F.lit(0.2718)).cast("double") / F.lit(1000.0)).alias("vec")))
    sizes = jobs.agg(F.count_if(F.col("label") == 1).alias("few"), F.count_if(F.col("label") == 0).alias("many")).first()
    made = smote.synthetic_rows(jobs.filter("label = 1").select("vec"), sizes["many"] - sizes["few"])
    return rounded(made.select("id", *[F.col("vec")[i].alias(c) for i, c in enumerate(_NAMES)]), 6, *_NAMES)


def _fitted(spark, folder, name: str) -> DataFrame:
    """Predictions of one calibrated model on the late jobs, trained on the early ones."""
    parts = stage(splits.time_split(trained_jobs(spark, folder)))
    early_jobs, late = (parts.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    model = train.train_models(early_jobs, [name], use_smote=False)[name]
    out = model.predict(late)
    return out.select("job_id", "is_skewed", "skew_probability", "predicted_skew", "threshold_used", "prediction_confidence")


@query()
def fit_lr(spark, folder):
    return _fitted(spark, folder, "logistic_regression")


@query()
def fit_rf(spark, folder):
    return _fitted(spark, folder, "random_forest")


@query()
def fit_gbt_a(spark, folder):
    return _fitted(spark, folder, "xgboost")


@query()
def fit_gbt_b(spark, folder):
    return _fitted(spark, folder, "lightgbm")


@query()
def trained_evaluation(spark, folder):
    """All four models with oversampling and calibration, evaluated beside the rule baseline."""
    parts = stage(splits.time_split(trained_jobs(spark, folder)))
    early_jobs, late = (parts.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    models = train.train_models(early_jobs, use_smote=True, all_must_fit=True)
    return metrics.comparison_table(train.evaluate_models(models, late), baseline.evaluate_baseline(late).drop("threshold"))


@query()
def feature_importance(spark, folder):
    frame = features.training_frame(trained_jobs(spark, folder))
    return train.feature_importance(train.fit_model("random_forest", frame))


@query()
def cross_validation(spark, folder):
    return train.cross_validate(trained_jobs(spark, folder))


@query()
def early_exec_model(spark, folder):
    """All four models on early-execution features."""
    rows = runtimes.direct_runtimes(item_tasks(spark, folder))
    jobs = stage(trained_jobs(spark, folder).join(early.early_features(rows), "job_id"))
    out = None
    for name, model in train.train_models(jobs, mode="early_exec", all_must_fit=True).items():
        part = model.predict(jobs).select(F.lit(name).alias("model"), "job_id", "is_skewed", "skew_probability", "predicted_skew")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def transfer_matrix(spark, folder):
    """Real jobs and rows generated from their keys, each as training and test source, and both together."""
    real = trained_jobs(spark, folder)
    made = stage(real.select(*[c.alias(n) for n, c in labelled_columns(F.col("job_id")).items()]))
    names = ["job_id", *features.PRE_EXEC_FEATURES, "is_skewed", "submit_time"]
    origins = {"real": real.withColumn("job_id", F.col("job_id").cast("string")).select(*names), "generated": made.select(*names)}
    return pipeline.transfer_matrix(origins, hybrid=("real", "generated"))


# ------------------------------------------------ learning beside a formula


@query(f"""WITH {SCORES}, steps AS (
  SELECT score, sum(is_skewed)::DOUBLE AS y, count(*)::DOUBLE AS n FROM scores WHERE model = 'random_forest' GROUP BY score),
blocks AS (
  SELECT a.score AS low, b.score AS high, sum(s.y) / sum(s.n) AS m
  FROM steps a JOIN steps b ON a.score <= b.score JOIN steps s ON s.score BETWEEN a.score AND b.score GROUP BY a.score, b.score),
least_after AS (
  SELECT x.score, k.low, min(k.m) AS m FROM steps x JOIN blocks k ON k.low <= x.score AND k.high >= x.score GROUP BY x.score, k.low)
SELECT score, round(max(m), 9) AS calibrated FROM least_after GROUP BY score""")
def isotonic_calibration(spark, folder):
    """The isotonic curve through a score, at each of its values; SQL has the max-min formula."""
    rows = rule_scores(spark, folder).filter("model = 'random_forest'").select(F.col("score").alias("_raw"), "label")
    curve = train.isotonic_curve(rows)
    return rounded(curve.transform(rows.select("_raw").distinct()).select(F.col("_raw").alias("score"), F.col("_calibrated").alias("calibrated")), 9, "calibrated")


@query(f"""WITH {FEATS}, {STATS}, c AS (
  SELECT count(*)::DOUBLE AS n, count(*) FILTER (is_skewed = 1)::DOUBLE AS pos FROM feats JOIN labelled USING (job_id))
SELECT round((n - pos) / pos, 9) AS ratio, round(n / (2 * pos), 9) AS weight_1, round(n / (2 * (n - pos)), 9) AS weight_0, n AS weight_sum FROM c""")
def class_ratio(spark, folder):
    """Ratio of the classes and their balanced weights."""
    weighted, ratio, total = train.class_weights(features.training_frame(trained_jobs(spark, folder)))
    of = lambda label: F.max(F.when(F.col("label") == label, F.col("weight")))
    out = weighted.agg(F.lit(ratio).alias("ratio"), of(1).alias("weight_1"), of(0).alias("weight_0"), F.sum("weight").alias("weight_sum"))
    return rounded(rounded(out, 9, "ratio", "weight_1", "weight_0"), 3, "weight_sum")


@query("SELECT unnest(['num_tasks', 'scheduling_class', 'priority', 'cpu_request_mean', 'cpu_request_std', 'memory_request_mean', 'memory_request_std', "
       "'disk_space_request_mean', 'disk_space_request_std', 'different_machine_constraint_mean', 'intercept']) AS feature, 0.0::DOUBLE AS slope")
def logistic_optimum(spark, folder):
    """Slope of the penalised loss at the fitted logistic regression; at its minimum all are 0."""
    frame = features.training_frame(trained_jobs(spark, folder))
    slopes = train.logistic_slopes(train.fit_model("logistic_regression", frame), frame)
    # Adding 0 turns a rounded -0.0 into 0.0.
    return slopes.select("feature", (F.round("slope", 5) + F.lit(0.0)).alias("slope"))


@query(f"""WITH {FEATS}, {STATS} SELECT job_id, num_tasks, is_skewed FROM feats JOIN labelled USING (job_id)""")
def stored_mart(spark, folder):
    """The job mart written to storage and read back."""
    path = f"{stage_root(spark)}/laggard/{uuid.uuid4().hex}"
    write_mart(direct_mart(order_trace(spark, folder)), path)
    return read_mart(spark, path).select("job_id", "num_tasks", "is_skewed")


def _live_sql() -> str:
    def u(low, high, name):
        d = sql_draw(0, "o_orderkey").replace("md5('0:'", f"md5('42-{name}:'")
        return f"({low} + ({high} - {low}) * {d})"

    cols = [f"'LIVE_' || lpad(o_orderkey::VARCHAR, greatest(6, length(o_orderkey::VARCHAR))::INTEGER, '0') AS job_id",
            f"(5 + floor({u('0.0::DOUBLE', '1.0::DOUBLE', 'tasks')} * 296))::BIGINT AS num_tasks",
            f"floor({u('0.0::DOUBLE', '1.0::DOUBLE', 'class')} * 4)::DOUBLE AS scheduling_class",
            f"round({u('1.0::DOUBLE', '450.0::DOUBLE', 'priority')}, 9) AS priority"]
    for name, low, high, least in (("cpu_request", 0.1, 2.5, 0.01), ("memory_request", 0.1, 3.0, 0.01), ("disk_space_request", 0.05, 2.0, 0.005)):
        mean = u(f"{low}::DOUBLE", f"{high}::DOUBLE", name)
        cols += [f"round({mean}, 9) AS {name}_mean", f"round({u(f'{least}::DOUBLE', f'({mean} * 0.5::DOUBLE)', name + '-std')}, 9) AS {name}_std"]
    pick = u("0.0::DOUBLE", "1.0::DOUBLE", "constraint")
    cols.append(f"([0.0, 0.1, 0.2, 0.3, 0.5]::DOUBLE[])[floor({pick} * 5)::INTEGER + 1] AS different_machine_constraint_mean")
    return "SELECT " + ", ".join(cols) + " FROM orders"


@query(_live_sql())
def generate_jobs(spark, folder):
    """One generated job row per order, drawn from the order's key."""
    made = jobs_for_keys(spark.read.parquet(f"{folder}/orders.parquet"), "o_orderkey")
    return rounded(made, 9, *[c for c in made.columns if c.endswith(("_mean", "_std", "priority")) and "constraint" not in c])


@query(f"WITH {SCORES}{CUTS} SELECT job_id::VARCHAR AS job_id, predicted_skew, round(score, 9) AS skew_probability, cut AS threshold_used, conf AS prediction_confidence FROM pr WHERE model = 'logistic_regression'")
def live_scoring(spark, folder):
    """The job mart replayed as arriving files and scored by a stream; the result is the stream's output."""
    jobs = trained_jobs(spark, folder).select(F.col("job_id").cast("string"), *features.PRE_EXEC_FEATURES)
    inbox, out, mark = (f"{stage_root(spark)}/laggard/{uuid.uuid4().hex}" for _ in range(3))
    jobs.repartition(4).write.parquet(inbox)

    def predict(rows: DataFrame) -> DataFrame:
        rule = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("num_tasks") - 1) / F.lit(10.0)))
        return scoring.add_predictions(rows.withColumn("skew_probability", rule), "logistic_regression")

    rows = live.live_source(spark, inbox, "parquet", jobs.schema, files_per_batch=2)
    live.score_stream(rows, predict, out, mark, mode=live.ABSOLUTE, trigger={"availableNow": True}).awaitTermination()
    columns = ["job_id", "predicted_skew", "skew_probability", "threshold_used", "prediction_confidence"]
    return rounded(spark.read.parquet(out).select(*columns), 9, "skew_probability")


@query(f"""WITH {SCORES} SELECT job_id::VARCHAR AS job_id, CASE WHEN job_id % 97 = 0 THEN 'rejected' ELSE 'scored' END AS status,
  CASE WHEN job_id % 97 > 0 THEN round(score, 9) END AS skew_probability FROM scores WHERE model = 'logistic_regression'""")
def live_csv_scoring(spark, folder):
    """Arriving CSV files with two column orders and broken rows: the stream's output and its quarantine."""
    jobs = trained_jobs(spark, folder).select(F.col("job_id").cast("string"), *features.PRE_EXEC_FEATURES)
    jobs = stage(jobs.withColumn("num_tasks", F.when(F.col("job_id").cast("bigint") % 97 == 0, F.lit("broken")).otherwise(F.col("num_tasks").cast("string"))))
    inbox, out, mark = (f"{stage_root(spark)}/laggard/{uuid.uuid4().hex}" for _ in range(3))
    half = F.col("job_id").cast("bigint") % 2
    jobs.filter(half == 0).select(*reversed(jobs.columns)).write.option("header", True).csv(inbox)
    jobs.filter(half == 1).withColumn("remark", F.lit("x")).write.mode("append").option("header", True).csv(inbox)

    def predict(rows: DataFrame) -> DataFrame:
        rule = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("num_tasks") - 1) / F.lit(10.0)))
        return scoring.add_predictions(rows.withColumn("skew_probability", rule), "logistic_regression")

    rows = live.live_source(spark, inbox, files_per_batch=5)
    live.score_stream(rows, predict, out, mark, mode=live.ABSOLUTE, trigger={"availableNow": True}).awaitTermination()
    scored = spark.read.parquet(out).select("job_id", F.lit("scored").alias("status"), F.round("skew_probability", 9).alias("skew_probability"))
    kept_back = spark.read.schema("job_id string").json(f"{out}_rejects")
    return scored.union(kept_back.select("job_id", F.lit("rejected"), F.lit(None).cast("double")))


@query(f"""WITH {FEATS}, {STATS}, j AS (SELECT job_id, job_id % 3 AS b, {sql_draw(7, 'job_id')} AS score, num_tasks AS a, priority AS p, cpu_request_std AS c,
  memory_request_std AS m, disk_space_request_std AS d FROM feats JOIN labelled USING (job_id)),
h AS (SELECT seen, (b = seen)::INTEGER AS is_new, j.* FROM j JOIN (SELECT unnest([0, 1, 2]) AS seen) AS k ON b <= seen),
lim AS (SELECT seen, min(a) AS a0, max(a) AS a1, min(p) AS p0, max(p) AS p1, min(c) AS c0, max(c) AS c1, min(m) AS m0, max(m) AS m1, min(d) AS d0, max(d) AS d1 FROM h GROUP BY seen),
dm AS (SELECT seen, job_id, is_new, score, score * 0.6::DOUBLE + coalesce((a - a0) / nullif(a1 - a0, 0)::DOUBLE * 0.15::DOUBLE, 0) + coalesce((p - p0) / nullif(p1 - p0, 0) * 0.1::DOUBLE, 0)
  + coalesce((c - c0) / nullif(c1 - c0, 0) * 0.05::DOUBLE, 0) + coalesce((m - m0) / nullif(m1 - m0, 0) * 0.05::DOUBLE, 0) + coalesce((d - d0) / nullif(d1 - d0, 0) * 0.05::DOUBLE, 0) AS demo
  FROM h JOIN lim USING (seen)),
rk AS (SELECT *, row_number() OVER (PARTITION BY seen ORDER BY demo, is_new, job_id) / count(*) OVER (PARTITION BY seen)::DOUBLE AS pct FROM dm)
SELECT job_id::VARCHAR AS job_id, round(score, 9) AS skew_probability, CASE WHEN pct <= 1.0::DOUBLE / 3 THEN 'low' WHEN pct <= 2.0::DOUBLE / 3 THEN 'medium' ELSE 'high' END AS prediction_confidence
FROM rk WHERE is_new = 1""")
def live_history_scoring(spark, folder):
    """History-relative confidence of jobs that arrive in three batches, by the remainder of their id; the stream is started anew for each."""
    jobs = stage(trained_jobs(spark, folder).select(F.col("job_id").cast("string"), *features.PRE_EXEC_FEATURES))
    inbox, out, mark = (f"{stage_root(spark)}/laggard/{uuid.uuid4().hex}" for _ in range(3))

    def predict(rows: DataFrame) -> DataFrame:
        return scoring.add_predictions(rows.withColumn("skew_probability", draw(7, F.col("job_id"))), "xgboost")

    for turn in range(3):
        jobs.filter(F.col("job_id").cast("bigint") % 3 == turn).write.mode("append").parquet(inbox)
        # All files of a turn are one batch.
        rows = live.live_source(spark, inbox, "parquet", jobs.schema, files_per_batch=1_000_000)
        live.score_stream(rows, predict, out, mark, trigger={"availableNow": True}).awaitTermination()
    return rounded(spark.read.parquet(out).select("job_id", "skew_probability", "prediction_confidence"), 9, "skew_probability")
