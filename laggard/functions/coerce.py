"""Tolerant text-to-number conversion: what does not parse becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Java's parser also takes hex floats and a trailing d/f; a CSV reader does not.
_JAVA_ONLY = r"[xX]|[0-9.][dDfF]\s*$"


def number(df: DataFrame, name: str) -> Column:
    """``name`` as DOUBLE; unparsable text and NaN give NULL."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.StringType):
        value = F.when(~col.rlike(_JAVA_ONLY), col.try_cast("double"))
        return F.when(~F.isnan(value), value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col.cast("double"))
    return col.cast("double")


def coerce_numbers(df: DataFrame, names) -> DataFrame:
    """Apply :func:`number` to those of ``names`` the frame has."""
    return df.withColumns({c: number(df, c) for c in names if c in df.columns})


def alias_columns(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Copy ``source`` to ``target`` where the target is absent; the source stays."""
    have = set(df.columns)
    return df.withColumns(
        {target: F.col(source) for source, target in aliases.items() if source in have and target not in have}
    )


ID_ALIASES = {"collection_id": "job_id", "instance_index": "task_index"}
SUBMIT_ALIASES = ID_ALIASES | {"user": "user_name", "time": "timestamp"}


def micros(column: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    seconds = F.hour(column) * 3600 + F.minute(column) * 60
    whole = F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
    return whole + seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint")
