"""Job mart and result tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_mart(jobs: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the job table; CSV gets a header."""
    writer = jobs.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def read_mart(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read the job table; CSV needs its schema."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("A CSV mart needs an explicit schema")
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def write_comparison(table: DataFrame, path: str) -> None:
    """Write a small result table as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").parquet(path)


def with_origin(frames: dict[str, DataFrame]) -> DataFrame:
    """Union job tables of several origins (say real and generated) with an ``origin`` column."""
    out = None
    for origin, df in frames.items():
        part = df.withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("No frames given")
    return out
