"""Cleaning of raw task traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.coerce import ID_ALIASES, alias_columns, coerce_numbers, number
from ..schemas import DIRECT_MARKERS, require_columns
from .early import sequential_index
from .quantiles import approx_medians, quantile_values

IMPUTED = ("cpu_request", "memory_request", "disk_space_request", "priority", "scheduling_class")


def _not_negative(df: DataFrame, name: str) -> Column:
    """``name >= 0``; kept on the bare column for whole numbers, so that the scan can use it."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType) and name == "job_id":
        # An id may be a name; only numbers can be negative.
        return F.coalesce(number(df, name) >= 0, F.lit(True))
    return (F.col(name) if isinstance(kind, T.IntegralType) else number(df, name)) >= 0


def _event_rules(df: DataFrame) -> list[tuple[str, Column]]:
    """Row rules of the event format, in the order they apply."""
    rules = []
    if "missing_info" in df.columns:
        whole = isinstance(df.schema["missing_info"].dataType, T.IntegralType)
        rules.append(("missing_info", (F.col("missing_info") if whole else number(df, "missing_info")) == 0))
    rules += [
        ("null_id", F.col("job_id").isNotNull() & F.col("task_index").isNotNull()),
        ("negative_id", _not_negative(df, "job_id") & _not_negative(df, "task_index")),
    ]
    if "timestamp" in df.columns:
        rules.append(("negative_time", _not_negative(df, "timestamp")))
    return rules


def _valid_event(df: DataFrame) -> Column:
    whole = isinstance(df.schema["event_type"].dataType, T.IntegralType)
    return F.col("event_type").isin(list(range(9))) if whole else number(df, "event_type").isin([float(c) for c in range(9)])


def impute_medians(df: DataFrame, columns=IMPUTED, approx: bool = False) -> DataFrame:
    """NULL and unparsable values become the column's median, or 0 when it has no values."""
    names = [c for c in columns if c in df.columns]
    if not names:
        return df
    if approx:
        medians = approx_medians(df, names)
    else:
        medians = {c: v[0] for c, v in quantile_values(df, names, [0.5]).items()}
    return df.withColumns({c: F.coalesce(number(df, c), F.lit(float(medians.get(c, 0.0)))) for c in names})


def clean_events(df: DataFrame, approx: bool = False) -> DataFrame:
    """Clean an event trace: drop bad rows, fill numbers with medians, keep known event codes.

    The medians are those of the rows with valid ids and times, whatever their
    event code.
    """
    for _, rule in _event_rules(df):
        df = df.filter(rule)
    df = _numeric_ids(df, drop_negative=False)
    return impute_medians(df, approx=approx).filter(_valid_event(df))


def _canonical_id(column: str) -> Column:
    """One text form per whole-number id, so that '7', '07' and '7.0' are one job; other ids stay as they are."""
    text = F.trim(column)
    whole = F.when(text.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_replace(text, r"\.0*$", ""))
    spelled = F.col(column).try_cast("double")
    # Exponents: doubles up to 2^53 are whole numbers exactly.
    spelled = F.when((spelled == F.floor(spelled)) & (F.abs(spelled) <= float(1 << 53)), spelled)
    return F.coalesce(whole.try_cast("decimal(38,0)").cast("string"), spelled.try_cast("bigint").cast("string"), F.col(column))


def _numeric_ids(df: DataFrame, drop_negative: bool) -> DataFrame:
    """When over half of the ids are numbers, unify them and optionally drop negative ones."""
    if not isinstance(df.schema["job_id"].dataType, T.StringType):
        return df.filter(_not_negative(df, "job_id")) if drop_negative else df
    value = number(df, "job_id")
    seen = df.agg(F.count(value).alias("parsed"), F.count("*").alias("n")).first()
    if seen["parsed"] <= 0.5 * seen["n"]:
        return df
    if drop_negative:
        df = df.filter(value.isNull() | (value >= 0))
    return df.withColumn("job_id", F.when(value.isNotNull(), _canonical_id("job_id")).otherwise(F.col("job_id")))


def clean_direct(df: DataFrame) -> DataFrame:
    """Clean a direct-runtime trace: alias ids, drop NULL ids and negative numeric ids."""
    df = alias_columns(df, ID_ALIASES)
    if "job_id" not in df.columns:
        return df
    return _numeric_ids(df.filter(F.col("job_id").isNotNull()), drop_negative=True)


def clean_basic(df: DataFrame) -> DataFrame:
    """Fallback for unknown formats: drop NULL job ids and unify numeric ones."""
    if "job_id" not in df.columns:
        return df
    return _numeric_ids(df.filter(F.col("job_id").isNotNull()), drop_negative=False)


def clean_trace(df: DataFrame, approx: bool = False) -> DataFrame:
    """Pick the cleaning by the columns present; event columns win over direct ones."""
    if "event_type" in df.columns:
        return clean_events(df, approx=approx)
    if any(c in df.columns for c in DIRECT_MARKERS):
        return clean_direct(df)
    return clean_basic(df)


def cleaning_report(df: DataFrame) -> DataFrame:
    """Rows before and after, rows removed by each event rule, and percent removed; one pass."""
    rules = [*_event_rules(df), ("unknown_event", _valid_event(df))]
    alive, aggs = F.lit(True), [F.count("*").alias("rows_before")]
    for name, rule in rules:
        passes = F.coalesce(rule, F.lit(False))
        aggs.append(F.count_if(alive & ~passes).alias(f"removed_{name}"))
        alive = alive & passes
    aggs.append(F.count_if(alive).alias("rows_after"))
    removed = (1 - F.col("rows_after") / F.nullif(F.col("rows_before"), F.lit(0))) * 100
    return df.agg(*aggs).withColumn("pct_removed", F.round(removed, 6))


def prepare_for_aggregation(df: DataFrame, order_cols=()) -> DataFrame:
    """Add the optional columns a job aggregate reads and keep rows with a positive runtime.

    A missing ``task_index`` is numbered per job along ``order_cols``.
    """
    df = alias_columns(df, ID_ALIASES)
    require_columns(df, ["job_id", "runtime"], "task runtimes")
    if "task_index" not in df.columns:
        df = sequential_index(df, order_cols)
    for name in ("scheduling_class", "priority"):
        df = df.withColumn(name, F.coalesce(number(df, name), F.lit(0.0)) if name in df.columns else F.lit(0.0))
    df = _numeric_ids(df, drop_negative=False)
    return coerce_numbers(df, ["runtime"]).filter("runtime > 0")
