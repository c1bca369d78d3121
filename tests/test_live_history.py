"""History-relative confidence: equal to a ranking of all rows, with little read per batch."""

import random

import pytest
from pyspark.sql import functions as F

from laggard.operators import scoring, staging
from laggard.operators.scoring import HISTORY_WEIGHTS
from laggard.streaming import history
from laggard.streaming.history import ARRIVAL, History

SCHEMA = "job_id string, skew_probability double, " + ", ".join(f"{c} double" for c in HISTORY_WEIGHTS) + f", {ARRIVAL} bigint"


def batch(rng, n, name, spread=1.0, probabilities=None):
    pick = (lambda: rng.choice(probabilities)) if probabilities else rng.random
    return [(f"{name}-{i}", pick(), *[round(rng.random() * spread, 2) if not probabilities else 0.5 for _ in HISTORY_WEIGHTS], i) for i in range(n)]


def ranked(seen, new):
    """Bands of the new rows by sorting everything in plain Python."""
    rows = [(r, 0) for r in seen] + [(r, 1) for r in new]
    columns = list(zip(*[r for r, _ in rows]))
    def scaled(c, x):
        low, high = min(columns[c]), max(columns[c])
        return (x - low) / (high - low) if high > low else 0.0
    def score(r):
        total = r[1] * scoring.PROBABILITY_WEIGHT
        for c, w in enumerate(HISTORY_WEIGHTS.values(), start=2):
            total += scaled(c, r[c]) * w
        return total
    order = sorted(rows, key=lambda x: (score(x[0]), x[1], x[0][-1]))
    n = len(order)
    return {r[0]: "low" if (i + 1) / n <= 1 / 3 else "medium" if (i + 1) / n <= 2 / 3 else "high" for i, (r, is_new) in enumerate(order) if is_new}


def play(spark, tmp_path, batches, retry=()):
    out, state, got, seen = str(tmp_path / "out"), str(tmp_path / "state"), [], []
    for b, rows in enumerate(batches):
        for _ in range(2 if b in retry else 1):
            with staging.staged_here(spark):
                new = staging.stage(spark.createDataFrame(rows, SCHEMA))
                History(spark, state, out).confidence(new, b).drop(ARRIVAL).write.mode("overwrite").parquet(f"{out}/batch_id={b}")
        found = {r["job_id"]: r["prediction_confidence"] for r in spark.read.parquet(f"{out}/batch_id={b}").collect()}
        assert found == ranked(seen, rows), b
        seen += rows
        got.append(found)
    return got


def test_limits_that_move(spark, tmp_path):
    rng = random.Random(1)
    play(spark, tmp_path, [batch(rng, n, f"b{i}", spread) for i, (n, spread) in enumerate([(1, 1), (40, 1), (30, 3), (2, 1), (50, 2)])], retry=(1, 2, 4))


def test_equal_scores(spark, tmp_path):
    """Very few different scores: ranks inside one interval go by arrival, earlier rows first."""
    rng = random.Random(2)
    play(spark, tmp_path, [batch(rng, 60, f"b{i}", probabilities=[0.2, 0.2, 0.7]) for i in range(4)])


def test_empty_batches(spark, tmp_path):
    rng = random.Random(3)
    play(spark, tmp_path, [[], batch(rng, 5, "a"), [], batch(rng, 4, "b")])


def test_state_is_rebuilt_from_the_output(spark, tmp_path):
    rng = random.Random(4)
    first, second = batch(rng, 30, "a"), batch(rng, 30, "b", 2.0)
    play(spark, tmp_path, [first])
    staging.delete_folder(spark, str(tmp_path / "state"))
    new = spark.createDataFrame(second, SCHEMA)
    found = History(spark, str(tmp_path / "state"), str(tmp_path / "out")).confidence(new, 1).collect()
    assert {r["job_id"]: r["prediction_confidence"] for r in found} == ranked(first, second)


def test_rows_read_stay_few(spark, tmp_path, monkeypatch):
    """While limits stand, twenty batches read only rows of the cut intervals and rewrite nothing."""
    rng = random.Random(5)
    ends = [(f"end-{x}", x, *[x for _ in HISTORY_WEIGHTS], 1000 + int(x)) for x in (0.0, 1.0)]
    read, real = [], history.keys_at

    def watched(rows, order, positions):
        read.append(rows.filter("_new = 0").count())
        return real(rows, order, positions)

    monkeypatch.setattr(history, "keys_at", watched)
    monkeypatch.setattr(history, "SLOTS", 256)
    play(spark, tmp_path, [batch(rng, 50, "b0") + ends, *[batch(rng, 50, f"b{i}") for i in range(1, 20)]])
    assert max(read) <= 30  # of up to 952 earlier rows
    assert [p.name for p in (tmp_path / "state" / "rows").iterdir() if p.is_dir()] == ["epoch=0"]
    assert sum(p.is_dir() for p in (tmp_path / "state" / "counts").iterdir()) == 2
