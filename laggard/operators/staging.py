"""Staged tables: results written once so that later stages agree on them.

Range partition bounds are sampled, so a plan that is evaluated twice may cut
the data in two different ways.  Operators that number rows across partitions
therefore write the partitioned rows to the shared checkpoint folder and read
them back.  The files also survive the loss of executors.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Most rows a side may have to be broadcast after its size was counted.
BROADCAST_ROWS = 200_000
# Rows one task gets to sort or to group, so that its memory does not grow with the table.
TASK_ROWS = 500_000

_STAGED: list[str] = []
_SCOPE: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="laggard-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/laggard/{uuid.uuid4().hex}"
    df.write.parquet(path)
    scope = _SCOPE.get()
    (_STAGED if scope is None else scope).append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a folder on whatever file system it lies; False if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


@contextmanager
def staged_here(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged inside; nothing staged elsewhere is touched."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            delete_folder(spark, path)


def release_staged(spark: SparkSession) -> int:
    """Delete the tables this process staged; call it when their results are written."""
    done = 0
    while _STAGED:
        done += delete_folder(spark, _STAGED.pop())
    return done


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when a count shows at most ``limit`` rows; otherwise a plain join side."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def dealt(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """``df`` of ``rows`` rows dealt by ``keys`` to tasks of about ``TASK_ROWS`` rows; a table of one such task comes back as it is.

    Windows and aggregates on the keys then need no further shuffle, and their tasks
    are as large for a large table as for a small one.
    """
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)), *keys)
