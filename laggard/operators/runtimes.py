"""Task runtimes from direct traces and from SUBMIT/FINISH events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.coerce import ID_ALIASES, alias_columns, coerce_numbers, number
from ..schemas import FINISH, SUBMIT, require_columns
from .ordered import hot_keys, with_global_rank, with_running_sums
from .staging import broadcast_if_small, dealt, stage

MICROS_CUTOFF = 1e10  # a larger maximum means the runtimes are microseconds
TASK = ["job_id", "task_index"]
HOT_TASK_ROWS = 1_000_000
HOT_PAIRS = 10_000_000  # submits x finishes of one task from which they are joined in blocks
PAIR_BLOCK = 2_000  # events of one side in a block


def scale_runtimes(df: DataFrame, unit: str = "auto") -> DataFrame:
    """Runtimes in seconds.

    ``auto`` looks at the largest runtime of the whole input: above 1e10 all
    rows are taken as microseconds.  Name the unit ('us' or 's') where parts of
    one dataset are processed separately.
    """
    if unit not in ("auto", "us", "s"):
        raise ValueError(f"Unknown runtime unit: {unit}")
    if unit == "s":
        return df
    seconds = F.col("runtime") / 1e6
    if unit == "auto":
        # A scalar subquery: the maximum is found when the plan runs, not while it is built.
        largest = df.agg(F.max("runtime")).scalar()
        seconds = F.when(largest > MICROS_CUTOFF, seconds).otherwise(F.col("runtime"))
    return df.withColumn("runtime", seconds)


def direct_runtimes(df: DataFrame, unit: str = "auto") -> DataFrame:
    """Positive runtimes from ``duration``, else from ``end_time - start_time``."""
    df = alias_columns(df, ID_ALIASES)
    if "duration" in df.columns:
        if isinstance(df.schema["duration"].dataType, T.NumericType):
            df = df.filter(F.col("duration") > 0)  # on the bare column, so that the scan can use it
        df = df.withColumn("runtime", number(df, "duration"))
    else:
        require_columns(df, ["start_time", "end_time"], "direct trace")
        df = coerce_numbers(df, ["start_time", "end_time"])
        df = df.withColumn("runtime", F.col("end_time") - F.col("start_time"))
    return scale_runtimes(df, unit).filter("runtime > 0")


def event_runtimes(df: DataFrame, hot_pairs: int = HOT_PAIRS, block: int = PAIR_BLOCK) -> DataFrame:
    """One row per (submit, later finish) of the same task.

    A task submitted s times and finished f times gives up to s*f rows; the job
    columns come from the SUBMIT side.  Tasks with s*f over ``hot_pairs`` are
    counted first and joined in blocks of ``block`` events a side, so that no
    task of the cluster makes more than block * block pairs of one key.  Use
    :func:`event_job_stats` when only the per-job statistics are needed: it
    never forms the pairs.
    """
    df = alias_columns(df, ID_ALIASES)
    require_columns(df, [*TASK, "event_type", "timestamp"], "event trace")
    extra = [c for c in ("scheduling_class", "priority") if c in df.columns]
    submits = df.filter(F.col("event_type") == SUBMIT).select(*TASK, F.col("timestamp").alias("start_time"), *extra)
    finishes = df.filter(F.col("event_type") == FINISH).select(*TASK, F.col("timestamp").alias("end_time"))
    sides = [F.count_if(F.col("event_type") == code) for code in (SUBMIT, FINISH)]
    sizes = df.groupBy(*TASK).agg(*[n.alias(f"_n{i}") for i, n in enumerate(sides)])
    # A task of null ids has no pairs.
    hot = stage(sizes.filter(F.col("_n0") * F.col("_n1") > hot_pairs).select(*TASK).dropna())
    later = F.col("end_time") > F.col("start_time")
    if hot.isEmpty():
        pairs = submits.join(finishes, TASK).filter(later)
    else:
        few = broadcast_if_small(hot)
        plain = [side.join(few, TASK, "left_anti") for side in (submits, finishes)]
        pairs = plain[0].join(plain[1], TASK).filter(later)
        hot_sides = [side.join(few, TASK, "left_semi") for side in (submits, finishes)]
        pairs = pairs.unionByName(_pairs_in_blocks(*hot_sides, block))
    return pairs.select(
        F.concat_ws("_", *[F.col(c).cast("string") for c in TASK]).alias("task_id"),
        *TASK,
        "start_time",
        *extra,
        "end_time",
        (F.col("end_time") - F.col("start_time")).cast("double").alias("runtime"),
    )


def _pairs_in_blocks(submits: DataFrame, finishes: DataFrame, block: int) -> DataFrame:
    """Pairs of a submit and a later finish, block of submits by block of finishes in time order.

    Two blocks meet only if the second one's last finish comes after the first one's first submit.
    """

    def blocked(side: DataFrame, time: str, name: str) -> DataFrame:
        ranked = with_global_rank(side, [*[F.col(c) for c in TASK], F.col(time)], "_rank")
        return ranked.withColumn(name, F.floor(F.col("_rank") / block)).drop("_rank")

    left, right = blocked(submits, "start_time", "_sb"), blocked(finishes, "end_time", "_fb")
    first = left.groupBy(*TASK, "_sb").agg(F.min("start_time").alias("_first"))
    last = right.groupBy(*TASK, "_fb").agg(F.max("end_time").alias("_last"))
    cells = stage(first.join(last, TASK).filter(F.col("_last") > F.col("_first")).drop("_first", "_last"))
    cell = [*TASK, "_sb", "_fb"]
    met = left.join(cells, [*TASK, "_sb"]).join(right.join(cells, [*TASK, "_fb"]), cell)
    return met.filter(F.col("end_time") > F.col("start_time")).drop("_sb", "_fb")


def extract_runtimes(df: DataFrame, unit: str = "auto") -> DataFrame:
    """Runtimes by the columns present: duration, then start/end, then events."""
    have = set(df.columns)
    if "duration" in have or {"start_time", "end_time"} <= have:
        return direct_runtimes(df, unit)
    if "event_type" in have:
        return event_runtimes(df)
    raise ValueError("Cannot extract runtime: need 'duration', 'start_time'/'end_time' or 'event_type'")


def event_job_stats(df: DataFrame, hot_rows: int = HOT_TASK_ROWS) -> DataFrame:
    """Per-job count, mean, max and sample std of the pair runtimes, without forming the pairs.

    For a finish at f with k earlier submits of sum S1 and square sum S2 the
    pairs add k, k*f - S1 and k*f^2 - 2*f*S1 + S2, so running sums over each
    task's events give the totals in linear work.  Tasks with over ``hot_rows``
    events are cut into ranges.
    """
    df = alias_columns(df, ID_ALIASES)
    events = df.filter(F.col("event_type").isin(SUBMIT, FINISH)).filter(
        F.col("job_id").isNotNull() & F.col("task_index").isNotNull() & F.col("timestamp").isNotNull()
    )
    # Times count from the earliest event: the exact integer sums stay far from 38 digits.
    first, n_events = events.agg(F.min("timestamp"), F.count(F.lit(1))).first()
    origin = first or 0
    wide = "decimal(38,0)"
    t = F.col("t").cast("decimal(18,0)")
    sums = {"c0": "s0", "c1": "s1", "c2": "s2"}

    def moments(part: DataFrame) -> DataFrame:
        out = part.groupBy(*TASK, (F.col("timestamp") - F.lit(origin)).cast("bigint").alias("t")).agg(
            F.count_if(F.col("event_type") == SUBMIT).alias("s0"), F.count_if(F.col("event_type") == FINISH).alias("f0")
        )
        return out.withColumns({"s1": (t * F.col("s0")).cast(wide), "s2": ((t * t).cast(wide) * F.col("s0")).cast(wide)})

    def windowed(part: DataFrame) -> DataFrame:
        """Sums within tasks of few events: dealt by task once, for counting, sums and totals alike."""
        upto = Window.partitionBy(*TASK).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        return moments(dealt(part, n_events, *TASK)).withColumns({dst: F.sum(src).over(upto) for dst, src in sums.items()})

    narrow = events.select(*TASK, "timestamp", "event_type")
    hot = hot_keys(narrow, TASK, hot_rows)
    if hot is None:
        run = windowed(narrow)
    else:
        ranged = with_running_sums(moments(narrow.join(hot, TASK, "left_semi")), TASK, [F.col("t")], sums, hot_rows)
        run = windowed(narrow.join(hot, TASK, "left_anti")).unionByName(ranged)

    # Submits at the very time of the finish give runtime 0 and do not count.
    k, a, b = F.col("c0") - F.col("s0"), F.col("c1") - F.col("s1"), F.col("c2") - F.col("s2")
    f, n = F.col("t").cast("decimal(18,0)"), F.col("f0")
    terms = run.filter((n > 0) | (F.col("s0") > 0)).select(
        *TASK,
        F.when(n > 0, n * k).alias("pairs"),
        F.when(n > 0, (n * (k * f - a)).cast(wide)).alias("total"),
        F.when(n > 0, (n * ((k * (f * f).cast(wide)).cast(wide) - (2 * f * a).cast(wide) + b)).cast(wide)).alias("squares"),
        F.when(F.col("s0") > 0, F.col("t")).alias("submit_t"),
        F.when(n > 0, F.col("t")).alias("finish_t"),
    )
    tasks = terms.groupBy(*TASK).agg(
        F.sum("pairs").alias("pairs"),
        F.sum("total").alias("total"),
        F.sum("squares").alias("squares"),
        (F.max("finish_t") - F.min("submit_t")).alias("longest"),
    )
    jobs = tasks.filter("pairs > 0").groupBy("job_id").agg(
        F.sum("pairs").alias("runtimes"),
        F.sum("total").alias("_total"),
        F.sum("squares").alias("_squares"),
        F.max("longest").cast("double").alias("max_task_runtime"),
    )
    # Squared gaps to the whole part m of the mean are exact: squares - 2 m total + n m m.
    # What is left of the mean is below 1, so that doubles do from here on.
    n = F.col("runtimes").cast("decimal(18,0)")
    m = F.floor(F.col("_total") / n).cast("decimal(20,0)")
    gaps = F.col("_squares") - (2 * m * F.col("_total")).cast(wide) + (n * (m * m).cast(wide)).cast(wide)
    rest = (F.col("_total") - (n * m).cast(wide)).cast("double") / F.col("runtimes")
    mean = m.cast("double") + rest
    spread = F.greatest(gaps.cast("double") - F.col("runtimes") * rest * rest, F.lit(0.0))
    return jobs.select(
        "job_id",
        mean.alias("avg_task_runtime"),
        "max_task_runtime",
        F.when(F.col("runtimes") > 1, F.sqrt(spread / (F.col("runtimes") - 1))).otherwise(0.0).alias("std_task_runtime"),
    )
