"""Views of star-schema and event tables as task traces.

An order is a job and its line items are the tasks; a user's activity log is an
event trace.  They let every operator run on ordinary tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.coerce import micros

# Activity names as trace event codes.
EVENT_CODES = {"view": 0, "click": 1, "error": 3, "purchase": 4, "signup": 5}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def item_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Line items alone as a direct-runtime trace: all a label or a request feature needs."""
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").cast("bigint").alias("task_index"),
        F.col("l_extendedprice").alias("duration"),
        F.col("l_discount").alias("cpu_request"),
        F.col("l_tax").alias("memory_request"),
        F.col("l_quantity").alias("disk_space_request"),
        F.when(flag == "A", 0).when(flag == "N", 1).when(flag == "R", 2).alias("scheduling_class"),
        (F.col("l_linestatus") == "O").cast("double").alias("different_machine_constraint"),
        micros(F.col("l_shipdate")).alias("end_time"),
    )


def order_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """What an order gives its tasks: submit time, priority and user."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        micros(F.col("o_orderdate")).alias("timestamp"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        F.col("o_custkey").cast("string").alias("user_name"),
    )


def order_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their order's attributes: the full direct-runtime trace."""
    rows = item_tasks(spark, folder).join(order_attributes(spark, folder), "job_id")
    return rows.withColumn("start_time", F.col("timestamp"))


def activity_trace(spark: SparkSession, folder: str, rough: bool = False) -> DataFrame:
    """The activity log as an event trace: the user is the job, ``k % 10`` the task.

    ``rough`` spoils some rows by ``k``: flagged or unknown completeness, missing
    or negative ids, negative times, event codes that do not exist.
    """
    events = table(spark, folder, "events")
    code = F.create_map(*[F.lit(x) for pair in EVENT_CODES.items() for x in pair])
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    time, flag, job, kind = micros(F.col("ts")), F.lit(0), F.col("user_id"), F.try_element_at(code, F.col("event_type"))
    if rough:
        time = F.when(k % 31 == 0, -time).otherwise(time)
        flag = F.when(k % 13 == 0, 1).when(k % 17 != 0, 0)
        job = F.when(k % 23 == 0, -job - 1).when(k % 19 != 0, job)
        kind = F.when(k % 29 == 0, 99).otherwise(kind)
    return events.select(
        time.alias("timestamp"),
        flag.alias("missing_info"),
        job.alias("job_id"),
        (k % 10).alias("task_index"),
        kind.alias("event_type"),
        F.when(k % 7 != 0, F.col("value")).alias("cpu_request"),
        F.when(k % 5 != 0, k / 100.0).alias("memory_request"),
        (k % 4).cast("double").alias("priority"),
        F.when(k % 3 != 0, k % 4).cast("int").alias("scheduling_class"),
    )
