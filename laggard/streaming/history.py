"""History-relative confidence of a stream, with work per batch that follows the batch.

A row's score lies in [0, 1] and depends on the limits of the weighted columns
over all rows so far.  While no limit moves, earlier scores stay as they are, so
it is enough to know how many earlier rows fall into each of ``SLOTS`` equal
intervals: the counts name the two intervals that hold the tertile cuts, and
only rows of these are read.  When a batch moves a limit, earlier rows are scored
and stored anew, once; limits of rows in no special order move about as often as
the logarithm of their number.

Below the state folder

* ``rows/epoch=E/batch_id=B`` has the weighted columns and the interval of the
  rows of batch B under the limits set by batch E, sorted by interval so that a
  scan skips the others;
* ``counts/batch_id=B`` has one row: limits, epoch and counts after batch B.

Each batch overwrites its own folders and reads those of batches before it, so a
retry does not see its own first try.  Lost state is rebuilt from the output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordered import keys_at
from ..operators.scoring import HISTORY_WEIGHTS, Limits, band_ends, demo_score, history_limits
from ..operators.staging import delete_folder, stage

SLOTS = 4096
#: Row number of a batch; equal scores of one batch rank by it.
ARRIVAL = "_arrival"

_COUNTS = "epoch bigint, limits map<string, array<double>>, counts map<int, bigint>"


@dataclass
class State:
    """What is known of the rows of earlier batches."""

    epoch: int
    limits: Limits
    counts: dict[int, int]
    batch_id: int


def slot(score: Column) -> Column:
    """Interval of a score; it never falls as the score rises."""
    return F.greatest(F.lit(0), F.least(F.lit(SLOTS - 1), F.floor(score * SLOTS))).cast("int")


def _counted(slots: DataFrame) -> dict[int, int]:
    # At most SLOTS rows.
    return {r["slot"]: r["count"] for r in slots.groupBy("slot").count().collect()}


def _joined(a: Limits, b: Limits) -> Limits:
    return {c: (min(x[c][0] for x in (a, b) if c in x), max(x[c][1] for x in (a, b) if c in x)) for c in {**a, **b}}


def _read(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(path).filter(F.col("batch_id") < batch_id)
    except AnalysisException:  # nothing written yet
        return None


class History:
    """The earlier rows of one stream: ``output`` has the predictions, ``folder`` the state."""

    def __init__(self, spark: SparkSession, folder: str, output: str) -> None:
        self.spark, self.folder, self.output = spark, folder, output

    def load(self, batch_id: int) -> State | None:
        """State before a batch."""
        past = _read(self.spark, f"{self.folder}/counts", batch_id)
        row = None if past is None else past.orderBy(F.desc("batch_id")).first()
        if row is None:
            return None
        return State(row["epoch"], {c: tuple(v) for c, v in row["limits"].items()}, row["counts"], row["batch_id"])

    def _rows(self, state: State, batch_id: int) -> DataFrame | None:
        return _read(self.spark, f"{self.folder}/rows/epoch={state.epoch}", batch_id)

    def _store(self, rows: DataFrame, limits: Limits, path: str, by_batch: bool) -> None:
        names = [c for c in ("skew_probability", *HISTORY_WEIGHTS) if c in rows.columns]
        batch = ["batch_id"] if by_batch else []
        slotted = rows.select(*names, *batch, slot(demo_score(rows, limits)).alias("slot"))
        # Written by interval: a third of all rows may share one, which ranges may not cut.
        write = slotted.sortWithinPartitions(*batch, "slot").write.mode("overwrite")
        (write.partitionBy("batch_id") if by_batch else write).parquet(path)

    def confidence(self, new: DataFrame, batch_id: int) -> DataFrame:
        """``new`` rows with their band in ``prediction_confidence``; the state goes on to this batch.

        ``new`` must be stored and number its rows in ``_arrival``.  Bands equal
        those of ``history_confidence`` over all earlier rows and the new ones.
        """
        state = self.load(batch_id)
        past = self._rows(state, batch_id) if state else _read(self.spark, self.output, batch_id)
        if past is not None and "skew_probability" not in past.columns:
            past = None
        found = history_limits(new)
        limits = _joined(state.limits if state else history_limits(past) if past is not None else {}, found)
        counts = state.counts if state else {}
        epoch = state.epoch if state else batch_id
        if past is not None and (state is None or limits != state.limits):
            epoch = batch_id
            path = f"{self.folder}/rows/epoch={epoch}"
            self._store(past.drop("slot"), limits, path, by_batch=True)
            past = _read(self.spark, path, batch_id)
            counts = _counted(past) if past is not None else {}
        path = f"{self.folder}/rows/epoch={epoch}"
        self._store(new, limits, f"{path}/batch_id={batch_id}", by_batch=False)
        scored = new.withColumn("_score", demo_score(new, limits)).withColumn("_slot", slot(F.col("_score")))
        here = _counted(scored.select(F.col("_slot").alias("slot")))
        total = {s: counts.get(s, 0) + here.get(s, 0) for s in sorted({*counts, *here})}
        band = self._band(scored, past, limits, counts, total)
        self._commit(batch_id, epoch, limits, total, state)
        return scored.withColumn("prediction_confidence", band).drop("_score", "_slot")

    def _band(self, scored: DataFrame, past: DataFrame | None, limits: Limits, counts: dict[int, int], total: dict[int, int]) -> Column:
        band = F.lit("high")
        for name, at in zip(("medium", "low"), reversed(band_ends(sum(total.values())))):
            below = 0
            for s, n in total.items():
                if below <= at < below + n:
                    cut = self._cut(scored, past if counts.get(s) else None, limits, s, at - below)
                    band = F.when((F.col("_slot") < s) | ((F.col("_slot") == s) & cut), name).otherwise(band)
                below += n
        return band

    def _cut(self, scored: DataFrame, past: DataFrame | None, limits: Limits, at_slot: int, position: int) -> Column:
        """Whether a new row of an interval stands at its ``position`` or before; earlier rows come first among equals."""
        rows = scored.filter(F.col("_slot") == at_slot).select("_score", F.lit(1).alias("_new"), ARRIVAL)
        if past is not None:
            inside = past.filter(F.col("slot") == at_slot)
            rows = rows.union(inside.select(demo_score(inside, limits), F.lit(0), F.lit(-1).cast("bigint")))
        order = ("_score", "_new", ARRIVAL)
        _, found = keys_at(rows, [F.col(c) for c in order], lambda n: [position])
        last = found[position]
        if last["_new"] == 0:
            return F.col("_score") < F.lit(last["_score"])
        return (F.col("_score") < F.lit(last["_score"])) | ((F.col("_score") == F.lit(last["_score"])) & (F.col(ARRIVAL) <= F.lit(last[ARRIVAL])))

    def _commit(self, batch_id: int, epoch: int, limits: Limits, counts: dict[int, int], before: State | None) -> None:
        row = (epoch, {c: [float(x) for x in v] for c, v in limits.items()}, counts)
        one = self.spark.createDataFrame([row], _COUNTS).coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.folder}/counts/batch_id={batch_id}")
        # A batch runs only when those before it are done: what their successors replaced is not read again.
        if before is not None:
            self._forget("counts", "batch_id", before.batch_id)
            self._forget("rows", "epoch", before.epoch)

    def _forget(self, table: str, key: str, first_needed: int) -> None:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        for status in base.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(base):
            name = status.getPath().getName()
            if name.startswith(f"{key}=") and int(name.partition("=")[2]) < first_needed:
                delete_folder(self.spark, status.getPath().toString())
