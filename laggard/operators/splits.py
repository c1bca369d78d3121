"""Leakage-aware train/test splits.

A split is decided by a few cut keys of the wanted order (time, or a seeded
draw).  Finding them moves only the order keys; assigning the rows is then a
comparison with literals, so the job table itself is never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import draw
from ..schemas import require_columns
from .ordered import keys_at
from .quantiles import quantile_values

TRAIN, TEST = "train", "test"


# ---------------------------------------------------------------- templates


def quantile_buckets(df: DataFrame, columns: Sequence[str], buckets: int = 5) -> dict[str, Column]:
    """Ordinal of the right-closed quantile interval each value falls in, per column.

    Repeated edges are merged; a constant column has no interval and gives NULL.
    The edges of all columns are found together.
    """
    found = quantile_values(df, columns, [i / buckets for i in range(buckets + 1)])
    out = {}
    for c in columns:
        edges = sorted(set(found.get(c, [])))
        if len(edges) < 2:
            out[c] = F.lit(None).cast("int")
            continue
        above = sum(((F.col(c) > F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
        out[c] = F.when(F.col(c).isNotNull(), above)
    return out


def add_template_id(df: DataFrame) -> DataFrame:
    """``template_id``: the user, else class, priority bucket and size bucket joined by a pipe."""
    if "user_name" in df.columns:
        return df.withColumn("template_id", F.coalesce(F.col("user_name").cast("string"), F.lit("nan")))
    for name in ("scheduling_class", "priority", "num_tasks"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0))
    buckets = quantile_buckets(df, ["priority", "num_tasks"])
    df = df.withColumns({f"{c}_bucket": b for c, b in buckets.items()})
    parts = ("scheduling_class", "priority_bucket", "num_tasks_bucket")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in parts]
    return df.withColumn("template_id", F.concat_ws("|", *text))


# --------------------------------------------------------------- time order


def _time_key(df: DataFrame, time_col: str, key: str) -> DataFrame:
    """Order keys: time with NULLs last, then the unique key."""
    clock = F.col(time_col) if time_col in df.columns else F.lit(None).cast("double")
    return df.select(clock.isNull().cast("int").alias("_late"), clock.alias("_t"), F.col(key).alias("_k"))


def _after(row, time_col: str, key: str, df: DataFrame) -> Column:
    """Whether a row comes at or after the cut row in time order."""
    k = F.col(key) >= F.lit(row["_k"])
    if time_col not in df.columns:
        return k
    t = F.col(time_col)
    if row["_late"]:
        return t.isNull() & k
    cut = F.lit(row["_t"])
    return t.isNull() | (t > cut) | ((t == cut) & k)


def _cuts(df: DataFrame, time_col: str, key: str, positions) -> tuple[int, dict[int, Column]]:
    keys = _time_key(df, time_col, key)
    n, rows = keys_at(keys, [F.col("_late"), F.col("_t"), F.col("_k")], positions)
    return n, {p: _after(r, time_col, key, df) for p, r in rows.items()}


def time_split(df: DataFrame, time_col: str = "submit_time", test_size: float = 0.2, key: str = "job_id") -> DataFrame:
    """Add ``split``: the first int(n * (1 - test_size)) rows by time train, the rest test.

    ``key`` must be unique; it breaks ties and is the order when there is no time.
    """
    n, cuts = _cuts(df, time_col, key, lambda n: [int(n * (1 - test_size))])
    late = cuts.get(int(n * (1 - test_size)), F.lit(False))
    return df.withColumn("split", F.when(late, TEST).otherwise(TRAIN))


def rolling_folds(n: int, n_splits: int = 3, test_size: float = 0.2, min_train_ratio: float = 0.4) -> list[tuple[int, int]]:
    """(test start, test end) positions of the expanding-window folds of n rows."""
    win, start = max(1, int(n * test_size)), max(1, int(n * min_train_ratio))
    starts = [start + i * win for i in range(n_splits)]
    return [(s, s + win) for s in starts if s + win <= n]


def rolling_split(
    df: DataFrame,
    n_splits: int = 3,
    test_size: float = 0.2,
    min_train_ratio: float = 0.4,
    time_col: str = "submit_time",
    key: str = "job_id",
) -> DataFrame:
    """One row per (job, fold) with ``fold`` and ``split``; each fold trains on all that came before its window."""

    def folds(n: int):
        return rolling_folds(n, n_splits, test_size, min_train_ratio)

    n, cuts = _cuts(df, time_col, key, lambda n: [p for fold in folds(n) for p in fold])
    parts = []
    for i, (start, end) in enumerate(folds(n)):
        after_end = cuts.get(end, F.lit(False))
        part = F.when(~cuts[start], TRAIN).when(~after_end, TEST)
        parts.append(F.struct(F.lit(i).alias("fold"), part.alias("split")))
    if not parts:
        return df.withColumns({"fold": F.lit(None).cast("int"), "split": F.lit(None).cast("string")}).limit(0)
    out = df.withColumn("_f", F.explode(F.array(*parts))).filter(F.col("_f.split").isNotNull())
    return out.withColumns({"fold": F.col("_f.fold"), "split": F.col("_f.split")}).drop("_f")


def fold_validity(folds: DataFrame, min_train_pos: int = 6) -> DataFrame:
    """Rows and positives per fold, and whether the fold can be fitted and tested."""
    train, pos = F.col("split") == TRAIN, F.col("is_skewed") == 1
    counts = folds.groupBy("fold").agg(
        F.count_if(train).alias("train_rows"),
        F.count_if(~train).alias("test_rows"),
        F.count_if(train & pos).alias("train_pos"),
        F.count_if(~train & pos).alias("test_pos"),
    )
    return counts.withColumn("valid", (F.col("train_pos") >= min_train_pos) & (F.col("test_pos") > 0))


# ------------------------------------------------------------ seeded splits


def template_split(df: DataFrame, template_col: str = "template_id", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole templates go to test: ceil(test_size * templates) of them, by seeded draw.

    The cut draw is found among the distinct templates, so no join brings the
    assignment back to the rows and a template of any size costs the same.
    """
    require_columns(df, [template_col], "job table")
    names = df.select(F.col(template_col).alias("_k")).filter("_k IS NOT NULL").distinct()
    names = names.withColumn("_d", draw(seed, F.col("_k")))

    def last(n: int) -> list[int]:
        return [math.ceil(test_size * n) - 1]

    n, rows = keys_at(names, [F.col("_d"), F.col("_k")], last)
    if not rows:
        return df.withColumn("split", F.lit(TRAIN))
    cut = rows[last(n)[0]]
    d, k = draw(seed, F.col(template_col)), F.col(template_col)
    chosen = (d < F.lit(cut["_d"])) | ((d == F.lit(cut["_d"])) & (k <= F.lit(cut["_k"])))
    return df.withColumn("split", F.when(chosen, TEST).otherwise(TRAIN))


def allocate(counts: Sequence[int], total: int) -> list[int]:
    """Share ``total`` among classes in proportion to ``counts``; the largest remainders round up."""
    n = sum(counts)
    if n == 0:
        return [0] * len(counts)
    exact = [c * total / n for c in counts]
    out = [int(math.floor(x)) for x in exact]
    order = sorted(range(len(counts)), key=lambda i: (out[i] - exact[i], i))
    for i in order[: total - sum(out)]:
        out[i] += 1
    return out


def _class_counts(df: DataFrame, label: str, limit: int = 1000) -> list[tuple]:
    rows = df.groupBy(label).count().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{label} has more than {limit} classes")
    return sorted((r[label], r["count"]) for r in rows if r[label] is not None)


def _draw_cuts(df: DataFrame, label: str, key: str, seed, wanted: dict) -> dict:
    """For each class the cut rows at the wanted in-class positions of the seeded order."""
    classes = _class_counts(df, label)
    starts, start = {}, 0
    for value, n in classes:
        starts[value] = start
        start += n
    keys = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_c"), draw(seed, F.col(key)).alias("_d"), F.col(key).alias("_k"))
    at = [starts[v] + p for v, ps in wanted.items() for p in ps]
    _, rows = keys_at(keys, [F.col("_c"), F.col("_d"), F.col("_k")], lambda _: at)
    return {v: [rows.get(starts[v] + p) for p in ps] for v, ps in wanted.items()}


def _before(row, key: str, seed) -> Column:
    d = draw(seed, F.col(key))
    return (d < F.lit(row["_d"])) | ((d == F.lit(row["_d"])) & (F.col(key) < F.lit(row["_k"])))


def stratified_split(df: DataFrame, label: str = "is_skewed", test_size: float = 0.2, seed: int = 42, key: str = "job_id") -> DataFrame:
    """Add ``split`` with exactly ceil(n * test_size) test rows, shared among the classes in proportion."""
    classes = _class_counts(df, label)
    total = math.ceil(sum(n for _, n in classes) * test_size)
    takes = allocate([n for _, n in classes], total)
    wanted = {v: [t] for (v, n), t in zip(classes, takes) if 0 < t < n}
    cuts = _draw_cuts(df, label, key, seed, wanted) if wanted else {}
    part = F.when(F.col(label).isNull(), TRAIN)
    for (value, n), take in zip(classes, takes):
        inside = F.lit(take >= n) if value not in cuts else _before(cuts[value][0], key, seed)
        part = part.when((F.col(label) == value) & inside, TEST)
    return df.withColumn("split", part.otherwise(TRAIN))


def stratified_folds(df: DataFrame, n_folds: int = 5, label: str = "is_skewed", seed: int = 42, key: str = "job_id") -> DataFrame:
    """Add ``fold`` 0..n_folds-1; each class is cut into equal runs of the seeded order."""
    classes = _class_counts(df, label)
    wanted = {v: [n * i // n_folds for i in range(1, n_folds)] for v, n in classes}
    cuts = _draw_cuts(df, label, key, seed, wanted)
    fold = F.when(F.col(label).isNull(), F.lit(None).cast("int"))
    for value, rows in cuts.items():
        passed = sum(((~_before(r, key, seed)).cast("int") for r in rows if r is not None), F.lit(0))
        fold = fold.when(F.col(label) == value, passed)
    return df.withColumn("fold", fold)


def calibration_holdout(
    df: DataFrame, label: str = "is_skewed", size: float = 0.2, seed: int = 42, key: str = "job_id"
) -> tuple[DataFrame, DataFrame | None]:
    """(fit, calibration) frames; calibration is None when either side would lack a class.

    A class too small to be stratified makes the draw ignore the classes.
    """
    classes = _class_counts(df, label)
    if len(classes) < 2:
        return df, None
    if min(n for _, n in classes) >= 2:
        parts = stratified_split(df, label, size, seed, key)
    else:
        one = df.withColumn("_one", F.lit(0))
        parts = stratified_split(one, "_one", size, seed, key).drop("_one")
    calib = parts.filter(F.col("split") == TEST).drop("split")
    if len(_class_counts(calib, label)) < 2:
        return df, None
    return parts.filter(F.col("split") == TRAIN).drop("split"), calib


def random_rows(df: DataFrame, n: int = 10, seed: int = 42, key: str = "job_id") -> DataFrame:
    """The n rows with the smallest seeded draws: a top-k, not a full sort."""
    return df.withColumn("_d", draw(seed, F.col(key))).orderBy("_d", key).limit(n).drop("_d")
