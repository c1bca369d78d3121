"""End-to-end job marts: features, labels and template of every job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.coerce import number
from ..operators.clean import clean_direct, clean_trace
from ..operators.features import encode_categories, finish_features, job_distincts, job_means, pre_exec_features, submit_rows
from ..operators.labels import job_runtime_stats, label_jobs
from ..operators.runtimes import event_job_stats, extract_runtimes, scale_runtimes
from ..operators.splits import add_template_id
from ..operators.staging import stage
from ..schemas import EVENT13, REQUESTS

MART_COLUMNS = {
    "job_id", "task_index", "timestamp", "start_time", "runtime", "scheduling_class", "priority", "user_name",
    "different_machine_constraint", *REQUESTS,
}
EVENT_COLUMNS = {*EVENT13.names, "resource_request", "constraint", "collection_id", "instance_index", "user", "time"}


def direct_mart(trace: DataFrame, unit: str = "auto", clean: bool = True, template: bool = True, staged: bool = True) -> DataFrame:
    """Job mart of a direct-runtime trace.

    Features and labels come from the same rows, so one aggregate computes both
    and the join of the two disappears.  Jobs without a positive runtime drop out.
    The rows are needed for the largest runtime, the means and the distinct
    values; ``staged`` writes their narrow form once, so that the trace, and any
    join it is made of, is read once.
    """
    rows = submit_rows(clean_direct(trace) if clean else trace)
    runtime = number(rows, "duration") if "duration" in rows.columns else number(rows, "end_time") - number(rows, "start_time")
    rows = rows.withColumn("runtime", runtime)
    if staged:
        rows = stage(rows.select(*[c for c in rows.columns if c in MART_COLUMNS]))
    rows = scale_runtimes(rows, unit)
    ran = F.when(F.col("runtime") > 0, F.col("runtime"))
    labels = [
        F.avg(ran).alias("avg_task_runtime"),
        F.max(ran).alias("max_task_runtime"),
        F.coalesce(F.stddev_samp(ran), F.lit(0.0)).alias("std_task_runtime"),
    ]
    means = job_means(rows, labels).filter("max_task_runtime IS NOT NULL")
    distincts = job_distincts(rows)
    jobs = finish_features(means if distincts is None else means.join(distincts, "job_id"))
    jobs = label_jobs(encode_categories(jobs))
    return add_template_id(jobs) if template else jobs


def event_mart(cleaned: DataFrame) -> DataFrame:
    """Job mart of a cleaned event trace: submit features joined with labels from the event pairs."""
    events = stage(cleaned.select(*[c for c in cleaned.columns if c in EVENT_COLUMNS]))
    features = encode_categories(pre_exec_features(events, staged=False))
    return add_template_id(features.join(label_jobs(event_job_stats(events)), "job_id"))


def job_mart(trace: DataFrame, unit: str = "auto", approx_medians: bool = False) -> DataFrame:
    """Clean a raw trace of any known format and build its job mart."""
    have = set(trace.columns)
    direct = "duration" in have or {"start_time", "end_time"} <= have
    if direct and "event_type" not in have:
        return direct_mart(trace, unit)
    cleaned = clean_trace(trace, approx=approx_medians)
    if not direct:
        return event_mart(cleaned)
    # Event columns and runtimes in one file: cleaned as events, timed as direct rows.
    features = encode_categories(pre_exec_features(cleaned))
    labels = label_jobs(job_runtime_stats(extract_runtimes(cleaned, unit)))
    return add_template_id(features.join(labels, "job_id"))
