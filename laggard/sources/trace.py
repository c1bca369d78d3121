"""Trace scans with explicit schemas and format detection from the header line."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.coerce import number
from ..functions.draws import draw
from ..schemas import DIRECT_MARKERS, DIRECT_TYPES, EVENT13, EVENT_REQUIRED

DIRECT, EVENT_HEADER, EVENT_PLAIN = "direct", "event-header", "event-headerless"


def header_fields(spark: SparkSession, path: str) -> list[str]:
    """Fields of the first line; the scan stops after one row."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"Empty trace: {path}")
    return next(csv.reader([first[0].lstrip("﻿")]), [])


def detect_format(fields) -> str:
    """Direct columns win, then a full event header; anything else is a headerless event log."""
    have = set(fields)
    if have & set(DIRECT_MARKERS):
        return DIRECT
    return EVENT_HEADER if set(EVENT_REQUIRED) <= have else EVENT_PLAIN


def _typed(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Cast text columns by name; what does not parse becomes NULL.

    Job ids stay text: they may be names.
    """
    out = {}
    for c in df.columns:
        kind = types.get(c)
        if isinstance(kind, T.DoubleType):
            out[c] = number(df, c)
        elif isinstance(kind, T.IntegralType):
            # '3.0' is a whole number too.
            out[c] = F.coalesce(F.col(c).try_cast("bigint"), number(df, c).try_cast("bigint")).cast(kind)
    return df.withColumns(out)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Task trace from parquet or CSV, in any of the three known layouts.

    CSV columns are matched by position in Spark, so the schema is built in
    header order and typed by name afterwards.
    """
    if str(path).rstrip("/").endswith((".parquet", ".orc")):
        return spark.read.format(str(path).rstrip("/").rsplit(".", 1)[1]).load(path)
    fields = header_fields(spark, path)
    kind = detect_format(fields)
    plain = kind == EVENT_PLAIN
    text = T.StructType([T.StructField(c, T.StringType()) for c in (EVENT13.names if plain else fields)])
    raw = spark.read.option("header", not plain).option("enforceSchema", True).schema(text).csv(path)
    if kind == DIRECT:
        return _typed(raw, DIRECT_TYPES)
    return _typed(raw, {f.name: f.dataType for f in EVENT13.fields if f.name != "job_id"})


def sample_trace(spark: SparkSession, path: str, n_rows: int | None = None) -> DataFrame:
    """The first ``n_rows`` of a trace (all when None); the limit stops the scan early."""
    df = read_trace(spark, path)
    return df if n_rows is None else df.limit(n_rows)


def seeded_sample(df: DataFrame, fraction: float, seed: int = 42, key: str = "job_id") -> DataFrame:
    """Whole jobs kept with probability ``fraction``: unbiased, unlike the first rows of a file."""
    return df.filter(draw(seed, F.col(key)) < fraction)
