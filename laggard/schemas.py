"""Schemas and fixed names of the trace, job and prediction tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Event codes of a task event trace.
SUBMIT, SCHEDULE, EVICT, FAIL, FINISH, KILL, LOST, UPDATE_PENDING, UPDATE_RUNNING = range(9)

# The 13 columns of a headerless task event trace, in file order.
EVENT13 = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("missing_info", T.IntegerType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("task_index", T.LongType()),
        T.StructField("machine_id", T.LongType()),
        T.StructField("event_type", T.IntegerType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("scheduling_class", T.IntegerType()),
        T.StructField("priority", T.DoubleType()),
        T.StructField("cpu_request", T.DoubleType()),
        T.StructField("memory_request", T.DoubleType()),
        T.StructField("disk_space_request", T.DoubleType()),
        T.StructField("different_machine_constraint", T.DoubleType()),
    ]
)

# Types of the columns a direct-runtime trace may carry; anything else stays text.
DIRECT_TYPES = {
    "collection_id": T.StringType(),
    "job_id": T.StringType(),
    "instance_index": T.LongType(),
    "task_index": T.LongType(),
    "time": T.LongType(),
    "timestamp": T.LongType(),
    "start_time": T.LongType(),
    "end_time": T.LongType(),
    "duration": T.DoubleType(),
    "scheduling_class": T.IntegerType(),
    "priority": T.DoubleType(),
    "cpu_request": T.DoubleType(),
    "memory_request": T.DoubleType(),
    "disk_space_request": T.DoubleType(),
    "different_machine_constraint": T.DoubleType(),
}

# Columns that tell the formats apart.
EVENT_REQUIRED = ("timestamp", "job_id", "task_index", "event_type")
DIRECT_MARKERS = ("start_time", "duration", "end_time")

REQUESTS = ("cpu_request", "memory_request", "disk_space_request")

# Model inputs known before a job runs, in model order.
PRE_EXEC_FEATURES = [
    "num_tasks",
    "scheduling_class",
    "priority",
    "cpu_request_mean",
    "cpu_request_std",
    "memory_request_mean",
    "memory_request_std",
    "disk_space_request_mean",
    "disk_space_request_std",
    "different_machine_constraint_mean",
]

# Model inputs once the first tasks have finished, in model order.
EARLY_EXEC_FEATURES = [
    "early_num_tasks",
    "early_avg_task_runtime",
    "early_max_task_runtime",
    "early_std_task_runtime",
    "num_tasks",
    "scheduling_class",
    "priority",
    "cpu_request_mean",
    "memory_request_mean",
    "disk_space_request_mean",
]

FEATURE_MODES = {"pre_exec": PRE_EXEC_FEATURES, "early_exec": EARLY_EXEC_FEATURES}


def feature_columns(mode: str = "pre_exec") -> list[str]:
    """Model input columns for a feature mode."""
    if mode not in FEATURE_MODES:
        raise ValueError(f"Unknown feature mode: {mode}")
    return list(FEATURE_MODES[mode])


# Job rows awaiting a prediction: the id and the submit-time features.
LIVE_JOB = T.StructType(
    [T.StructField("job_id", T.StringType()), T.StructField("num_tasks", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in PRE_EXEC_FEATURES[1:]]
)

PREDICTION_COLUMNS = ("predicted_skew", "skew_probability", "threshold_used", "prediction_confidence")


def require_columns(df, columns, what: str = "input") -> None:
    """Fail while the plan is being built when a needed column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns in {what}: {missing}. Available: {df.columns}")
