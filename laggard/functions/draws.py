"""Seeded pseudo-random draws that depend on the row's key only.

A draw does not change when the data is repartitioned, re-read or recomputed
after a lost executor, and any SQL engine with ``md5`` can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STEPS = float(1 << 52)


def draw(seed: int | str, *keys: Column) -> Column:
    """Uniform DOUBLE in [0, 1) from the seed and the key columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(_STEPS)


def uniform(low, high, seed: int | str, *keys: Column) -> Column:
    """Uniform DOUBLE in [low, high); the bounds may be columns."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return low + (high - low) * draw(seed, *keys)


def pick(values, seed: int | str, *keys: Column) -> Column:
    """One of a short list of literals, all equally likely."""
    index = F.floor(draw(seed, *keys) * len(values)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)
