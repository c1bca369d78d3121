"""Live scoring of arriving job rows with Structured Streaming.

Contract with producers: every write is a new file in the input folder.  A
file source does not see rows appended to a file it has already listed.
Progress lives in the checkpoint, so a restarted query goes on where it stopped
and nothing has to be counted or re-read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import history_confidence
from ..operators.staging import stage, staged_here
from ..schemas import LIVE_JOB, PRE_EXEC_FEATURES, require_columns
from .history import ARRIVAL, History

ABSOLUTE, HISTORY = "absolute", "demo-mix"
CORRUPT = "_corrupt_record"
POLL = "2 seconds"


_LINE, _FILE, _START, _NTH = "_line", "_file", "_start", "_nth"


def live_source(
    spark: SparkSession, folder: str, fmt: str = "csv", schema: T.StructType = LIVE_JOB, files_per_batch: int = 1000
) -> DataFrame:
    """Stream of the job files landing in ``folder``.

    A CSV stream has lines with their file, so that a large file is read by
    several tasks; ``job_rows`` turns the lines of a batch into rows, and
    ``score_stream`` does so by itself.
    """
    reader = spark.readStream.format("text" if fmt == "csv" else fmt).option("maxFilesPerTrigger", files_per_batch)
    if fmt != "csv":
        return reader.schema(schema).load(folder)
    return reader.load(folder).select(F.col("value").alias(_LINE), F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_START))


def is_lines(rows: DataFrame) -> bool:
    """Whether a frame has the lines of a CSV stream, not job rows."""
    return {_LINE, _FILE, _START} <= set(rows.columns)


def _fields(line: Column, n: int, most: int) -> Column:
    """The first n fields of a CSV line of at most ``most`` as texts, NULL where there is none."""
    row = F.from_csv(line, ", ".join(f"f{i} string" for i in range(n)), {"mode": "PERMISSIVE", "maxColumns": str(most)})
    # Taken out of one parsed row; naming its fields one by one would parse the line for each.
    return F.transform(F.array(row), lambda r: F.array(*[r[f"f{i}"] for i in range(n)]))[0]


def job_rows(lines: DataFrame, schema: T.StructType = LIVE_JOB) -> DataFrame:
    """Rows of ``schema`` from the CSV lines of a batch.

    Columns are found by the names in each file's own header (its first line),
    whatever their order and number; other columns are ignored.  A row is broken,
    and keeps its text in the column ``_corrupt_record``, when its file lacks a
    column, when it has more fields than the header, or when a number does not
    parse.  Blank lines are no rows; a field holds no line break.
    """
    numbered = lines.withColumn(_NTH, F.monotonically_increasing_id())
    # The first block of a file is read in line order by one task.  One short row per file of the batch.
    firsts = numbered.filter(F.col(_START) == 0).groupBy(_FILE).agg(F.min(_NTH).alias(_NTH))
    heads = stage(numbered.join(F.broadcast(firsts), [_FILE, _NTH]).select(_FILE, _NTH, F.regexp_replace(_LINE, "^\ufeff", "").alias("_head")))
    # A header has at most one field more than commas; one more field tells rows that are too long.
    width = (heads.agg(F.max(F.size(F.split("_head", ",")))).first()[0] or 0) + 1
    most = 2 * width + 1000  # the parser keeps room for as many; a row of more commas is broken without being parsed
    names = heads.withColumn("_names", F.transform(F.filter(_fields(F.col("_head"), width, most), lambda n: n.isNotNull()), lambda n: F.trim(n)))
    places = F.array(*[F.array_position("_names", f.name).cast("int") for f in schema.fields])
    files = names.select(_FILE, F.col(_NTH).alias("_first"), F.size("_names").alias("_n_names"), F.coalesce(places, F.array()).alias("_places"))
    rows = numbered.join(F.broadcast(files), _FILE).filter((F.col(_NTH) != F.col("_first")) & (F.trim(_LINE) != ""))
    endless = F.length(_LINE) - F.length(F.replace(_LINE, F.lit(","))) >= most
    rows = rows.withColumn("_values", _fields(F.when(~endless, F.col(_LINE)), width, most))
    columns, broken = {}, endless | F.get("_values", "_n_names").isNotNull()
    for i, field in enumerate(schema.fields):
        at = F.get("_places", F.lit(i))
        text = F.when(at > 0, F.get("_values", at - 1))
        value = text
        if not isinstance(field.dataType, T.StringType):
            plain = F.when(F.trim(text) != "", F.trim(text))
            value = plain.try_cast("double")
            value = value.try_cast(field.dataType) if isinstance(field.dataType, T.DoubleType) else F.when(value == F.floor(value), value.try_cast(field.dataType))
            broken = broken | (plain.isNotNull() & value.isNull())
        broken = broken | F.coalesce(at == 0, F.lit(True))
        columns[field.name] = value.alias(field.name)
    return rows.select(*columns.values(), F.when(broken, F.col(_LINE)).alias(CORRUPT))


def split_corrupt(batch: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(good rows, rejected rows); a row without a job id is good."""
    if CORRUPT not in batch.columns:
        return batch, None
    bad = F.col(CORRUPT).isNotNull()
    return batch.filter(~bad).drop(CORRUPT), batch.filter(bad).select(F.col(CORRUPT).alias("line"), "job_id")


def _latest(spark: SparkSession, path: str, batch_id: int, batches: int) -> DataFrame | None:
    """Predictions of the latest earlier batches; a retried batch does not see its own first try."""
    try:
        past = spark.read.parquet(path)
    except AnalysisException:  # nothing written yet
        return None
    past = past.filter((F.col("batch_id") < batch_id) & (F.col("batch_id") >= batch_id - batches))
    # Ties among earlier rows may fall either way; a number keeps equal rows apart.
    return past.withColumn(ARRIVAL, F.monotonically_increasing_id())


def score_stream(
    rows: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    mode: str = HISTORY,
    rejects: str | None = None,
    trigger: dict | None = None,
    history_batches: int | None = None,
    fmt: str = "parquet",
    schema: T.StructType = LIVE_JOB,
    state: str | None = None,
) -> StreamingQuery:
    """Score every arriving row once and append it to ``output``.

    ``predict`` adds the prediction columns (for example ``SkewModel.predict``).
    In ``absolute`` mode its confidence is kept; in ``demo-mix`` mode new rows
    get their tertile among the rows of earlier batches (the latest
    ``history_batches``, all by default) and their own batch.  All earlier rows
    are kept as counts and stored rows in ``state`` (by default the output's path
    with ``_history``), of which a batch reads a small part (``streaming.history``).
    Repeated job ids are scored again, as rows, not jobs, arrive.  Each batch
    overwrites its own ``batch_id`` folder, so a retry leaves no duplicates.
    Broken rows go to ``rejects`` (by default the output's path with ``_rejects``)
    with their text in ``line``.
    """
    if mode not in (ABSOLUTE, HISTORY):
        raise ValueError(f"Unknown confidence mode: {mode}")
    require_columns(rows.sparkSession.createDataFrame([], schema) if is_lines(rows) else rows, ["job_id", *PRE_EXEC_FEATURES], "live jobs")
    beside = output.rstrip("/")
    rejects, state = rejects or f"{beside}_rejects", state or f"{beside}_history"

    def write(batch: DataFrame, batch_id: int) -> None:
        with staged_here(batch.sparkSession):
            # Lines are parsed once; the scored rows and the broken ones are both read from the parsed ones.
            good, bad = split_corrupt(stage(job_rows(batch, schema)) if is_lines(batch) else batch)
            predicted = predict(good)
            if mode == HISTORY:
                predicted = relative(stage(predicted.withColumn(ARRIVAL, F.monotonically_increasing_id())), batch_id).drop(ARRIVAL)
            predicted.write.mode("overwrite").format(fmt).save(f"{output}/batch_id={batch_id}")
            if bad is not None and not bad.isEmpty():
                bad.write.mode("overwrite").json(f"{rejects}/batch_id={batch_id}")

    def relative(kept: DataFrame, batch_id: int) -> DataFrame:
        spark = kept.sparkSession
        if history_batches is None:
            return History(spark, state, output).confidence(kept, batch_id)
        return history_confidence(kept, _latest(spark, output, batch_id, history_batches), arrival=(ARRIVAL,))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": POLL})).start()


def score_to_files(
    rows: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    fmt: str = "parquet",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Absolute-confidence scoring into a folder of files, with the same rules for broken rows."""
    return score_stream(rows, predict, output, checkpoint, ABSOLUTE, trigger=trigger, fmt=fmt)
