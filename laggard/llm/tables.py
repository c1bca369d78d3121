"""Intermediate tables that go when they have been used."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame

from ..operators.staging import stage_root


class Table:
    """Rows written once below the shared checkpoint folder, and read back as ``rows``; ``by`` names columns whose values get a folder each."""

    def __init__(self, df: DataFrame, *by: str):
        spark = df.sparkSession
        self.path = f"{stage_root(spark)}/laggard/{uuid.uuid4().hex}"
        df.write.parquet(self.path, partitionBy=list(by) or None)
        self.rows = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        spark = self.rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(df: DataFrame) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nobody holds any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
