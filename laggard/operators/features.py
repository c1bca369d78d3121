"""Job-level features known at submit time."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..functions.coerce import SUBMIT_ALIASES, alias_columns, coerce_numbers, number
from ..functions.parse import constraint_flag, resource_requests
from ..schemas import PRE_EXEC_FEATURES, REQUESTS, SUBMIT, feature_columns, require_columns
from .staging import stage

NUMERIC = (*REQUESTS, "priority", "scheduling_class", "different_machine_constraint")
MODES = ("scheduling_class", "user_name")


def submit_rows(df: DataFrame) -> DataFrame:
    """Rows that describe a submit, with standard names and numeric request columns."""
    df = alias_columns(df, SUBMIT_ALIASES)
    have = set(df.columns)
    if "resource_request" in have and not {"cpu_request", "memory_request"} <= have:
        parsed = resource_requests(F.col("resource_request"))
        df = df.withColumns({c: v for c, v in parsed.items() if c not in have})
    if "constraint" in have and "different_machine_constraint" not in have:
        df = df.withColumn("different_machine_constraint", constraint_flag(F.col("constraint")))
    if "event_type" in have:
        df = df.filter(F.col("event_type") == SUBMIT)
    require_columns(df, ["job_id"], "trace")
    df = df.filter(F.col("job_id").isNotNull())
    return coerce_numbers(df, NUMERIC)


def job_means(rows: DataFrame, extra=()) -> DataFrame:
    """Per-job means, sample deviations and submit time: one aggregate with map-side partials."""
    have, aggs = set(rows.columns), list(extra)
    for c in REQUESTS:
        if c in have:
            aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    if "different_machine_constraint" in have:
        aggs.append(F.avg("different_machine_constraint").alias("different_machine_constraint_mean"))
    if "priority" in have:
        aggs.append(F.avg("priority").alias("priority"))
    clock = next((c for c in ("timestamp", "start_time") if c in have), None)
    if clock:
        aggs.append(F.min(number(rows, clock)).alias("submit_time"))
    if "task_index" not in have:
        aggs.append(F.count("*").alias("num_tasks"))
    return rows.groupBy("job_id").agg(*aggs) if aggs else rows.select("job_id").distinct()


def job_distincts(rows: DataFrame) -> DataFrame | None:
    """Per-job distinct task count and most frequent values (ties: the smallest).

    One grouping-sets pass counts (job, task), (job, class) and (job, user)
    together.  The first shuffle is keyed by job and value, so a job with very
    many rows is spread over tasks, and what reaches the per-job step is one
    row per distinct value with a constant-size state.
    """
    have = set(rows.columns)
    values = [c for c in ("task_index", *MODES) if c in have]
    if not values:
        return None
    counts = rows.groupingSets([["job_id", v] for v in values], "job_id", *values).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("_n")
    )
    # grouping_id has one bit per key (job first); a set bit means the key is left out.
    full = (1 << len(values)) - 1
    set_of = {v: full & ~(1 << (len(values) - 1 - i)) for i, v in enumerate(values)}

    def mode(v: str):
        ranked = F.struct((-F.col("_n")).alias("n"), F.col(v).alias("v"))
        return F.min(F.when((F.col("_set") == set_of[v]) & F.col(v).isNotNull(), ranked))["v"].alias(v)

    aggs = [mode(v) for v in values if v in MODES]
    if "task_index" in have:
        in_set = (F.col("_set") == set_of["task_index"]) & F.col("task_index").isNotNull()
        aggs.insert(0, F.count_if(in_set).alias("num_tasks"))
    return counts.groupBy("job_id").agg(*aggs)


def finish_features(features: DataFrame) -> DataFrame:
    """Missing and NULL features become 0; ``num_tasks`` is whole."""
    have = set(features.columns)
    filled = {
        c: F.coalesce(number(features, c), F.lit(0.0)) if c in have else F.lit(0.0) for c in PRE_EXEC_FEATURES
    }
    filled["num_tasks"] = filled["num_tasks"].cast("bigint")
    optional = [c for c in ("submit_time", "user_name") if c in have]
    rest = [c for c in features.columns if c not in {"job_id", *PRE_EXEC_FEATURES, *optional}]
    return features.select("job_id", *[v.alias(c) for c, v in filled.items()], *optional, *rest)


def pre_exec_features(df: DataFrame, check_empty: bool = False, staged: bool = True) -> DataFrame:
    """One row per job with the submit-time features, ``submit_time`` and ``user_name``.

    The submit rows are read twice, for means and for distinct values; ``staged``
    writes them once before, so that scans and joins below them run once.
    """
    rows = submit_rows(df)
    wanted = {"job_id", "task_index", "timestamp", "start_time", "different_machine_constraint", *REQUESTS, *NUMERIC, *MODES}
    rows = rows.select(*[c for c in rows.columns if c in wanted])
    rows = stage(rows) if staged else rows
    if check_empty and rows.isEmpty():
        raise ValueError("the trace has no submit rows, so there is nothing to build features from")
    means, distincts = job_means(rows), job_distincts(rows)
    return finish_features(means if distincts is None else means.join(distincts, "job_id"))


def encode_categories(df: DataFrame) -> DataFrame:
    """Numeric ``scheduling_class``, 0 where it does not parse."""
    if "scheduling_class" not in df.columns:
        return df
    return df.withColumn("scheduling_class", F.coalesce(number(df, "scheduling_class"), F.lit(0.0)))


def training_frame(df: DataFrame, mode: str = "pre_exec", keep=("job_id",)) -> DataFrame:
    """Key columns, a ``features`` vector (NULL as 0) and, when labelled, a double ``label``."""
    names = feature_columns(mode)
    require_columns(df, names, "job table")
    vector = array_to_vector(F.array(*[F.coalesce(number(df, c), F.lit(0.0)) for c in names])).alias("features")
    label = [F.col("is_skewed").cast("double").alias("label")] if "is_skewed" in df.columns else []
    return df.select(*[c for c in keep if c in df.columns], vector, *label)


def aggregate_job_level(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Size and runtime statistics per job in one aggregate.

    ``num_tasks`` counts all rows, the rest only rows with a numeric runtime.
    ``scheduling_class`` is that of the first row along ``order_col``
    (the smallest value when no order column is given).
    """
    require_columns(df, ["job_id", "runtime"], "task runtimes")
    have, runtime = set(df.columns), number(df, "runtime")
    ok = runtime.isNotNull()
    aggs = [
        F.count("*").alias("num_tasks"),
        F.avg(runtime).alias("avg_task_runtime"),
        F.max(runtime).alias("max_task_runtime"),
        F.coalesce(F.stddev_samp(runtime), F.lit(0.0)).alias("std_task_runtime"),
    ]
    if "scheduling_class" in have:
        cls = F.coalesce(number(df, "scheduling_class"), F.lit(0.0))
        first = F.min_by(F.when(ok, cls), F.when(ok, F.struct(order_col, cls))) if order_col else F.min(F.when(ok, cls))
        aggs.append(first.alias("scheduling_class"))
    if "priority" in have:
        aggs.append(F.avg(F.when(ok, F.coalesce(number(df, "priority"), F.lit(0.0)))).alias("priority"))
    jobs = df.filter("job_id IS NOT NULL").groupBy("job_id").agg(*aggs)
    jobs = jobs.withColumns({c: F.lit(0.0) for c in ("scheduling_class", "priority") if c not in have})
    return jobs.filter("num_tasks > 0 AND avg_task_runtime > 0 AND max_task_runtime > 0")


def keep_multi_task_jobs(task_runtimes: DataFrame, least: int = 2) -> DataFrame:
    """Rows of jobs with at least ``least`` finished tasks (off by default in every plan)."""
    big = task_runtimes.groupBy("job_id").count().filter(F.col("count") >= least)
    return task_runtimes.join(big.select("job_id"), "job_id", "left_semi")


def cap_requests(df: DataFrame, columns=REQUESTS, prob: float = 0.99) -> DataFrame:
    """Cap columns at their exact quantile (off by default in every plan)."""
    from .quantiles import quantile_values

    names = [c for c in columns if c in df.columns]
    caps = quantile_values(df, names, [prob])
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(caps[c][0]))) for c in caps})
