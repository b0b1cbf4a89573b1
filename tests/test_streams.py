"""Streams folded batch by batch: all windows come out, late rows go aside, windows close, and a batch may run again."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.feedback import confidence_fold
from plumbline.streaming import streams
from plumbline.streaming.folds import ConfidenceFold, WindowFold

SCHEMA = "ts timestamp, quality_score double"


def day(n, hour=12):
    return dt.datetime(2024, 1, n, hour)


def files(spark, folder, batches, schema):
    """A stream with one batch for each list of rows."""
    source = f"{folder}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{i:03}")
        for root, _, names in os.walk(f"{source}/{i:03}"):
            for n in names:
                os.utime(f"{root}/{n}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")


def run(fold):
    fold.write().trigger(availableNow=True).start().awaitTermination()
    return fold


BATCHES = [
    [(day(1), 10.0), (day(1), 30.0), (None, 5.0)],
    [(day(2), 50.0), (day(1, 23), 90.0)],  # a day that is still open
    [(day(4), 70.0), (day(4), None)],
    [(day(1), 0.0), (day(5), 100.0)],  # the first day closed when day 4 came in
]
WANT = {1: (3, (10 + 30 + 90) / 3), 2: (1, 50.0), 4: (2, 70.0), 5: (1, 100.0)}


@pytest.fixture
def fold(spark, tmp_path):
    return run(WindowFold(spark, f"{tmp_path}/fold", streams.dashboard_by_day(files(spark, tmp_path, BATCHES, SCHEMA))))


def days(fold):
    return {r["window_start"].day: (r["sessions"], r["avg_quality_score"]) for r in fold.result().collect()}


def test_windows_late_rows_and_state(fold):
    assert days(fold) == {k: (n, pytest.approx(s)) for k, (n, s) in WANT.items()}
    late = [(r["ts"], r["quality_score"], r["batch_id"]) for r in fold.late().orderBy("batch_id").collect()]
    assert late == [(None, 5.0, 0), (day(1), 0.0, 3)]
    assert [r["window_start"].day for r in fold.state().orderBy("window_start").collect()] == [4, 5]


def test_a_batch_that_runs_again_changes_nothing(spark, fold):
    before = (days(fold), fold.late().count(), sorted(map(tuple, fold.state().collect())))
    for _ in range(2):
        fold.batch(spark.createDataFrame(BATCHES[-1], SCHEMA), len(BATCHES) - 1)
    assert (days(fold), fold.late().count(), sorted(map(tuple, fold.state().collect()))) == before


def test_state_does_not_grow(spark, tmp_path):
    batches = [[(day(n), float(n))] for n in range(1, 13)]
    fold = run(WindowFold(spark, f"{tmp_path}/fold", streams.dashboard_by_day(files(spark, tmp_path, batches, SCHEMA))))
    assert len(days(fold)) == 12 and fold.state().count() <= 3
    assert len(os.listdir(f"{tmp_path}/fold/state")) <= 3  # a folder for each of the last two batches


def test_an_empty_batch(spark, tmp_path):
    fold = WindowFold(spark, f"{tmp_path}/fold", streams.dashboard_by_day(spark.createDataFrame([], SCHEMA)))
    fold.batch(spark.createDataFrame([], SCHEMA), 0)
    fold.batch(spark.createDataFrame([(day(1), 1.0)], SCHEMA), 1)
    fold.batch(spark.createDataFrame([], SCHEMA), 2)
    assert days(fold) == {1: (1, 1.0)}


FEEDBACK = "feedback_id long, ts timestamp, target_type string, is_correct boolean"


def test_confidence_over_batches(spark, tmp_path):
    """One check holds most of the feedback; batches in time order give what one fold of everything gives."""
    rng = random.Random(3)
    rows = [(i, day(1) + dt.timedelta(seconds=i), "issue" if i % 10 else rng.choice(["proposal", "decision"]), rng.choice([True, False, False, None])) for i in range(400)]
    cuts = [0, 3, 10, 11, 200, 400]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    fold = run(ConfidenceFold(spark, f"{tmp_path}/fold", files(spark, tmp_path, batches, FEEDBACK)))
    want = sorted(map(tuple, confidence_fold(spark.createDataFrame(rows, FEEDBACK)).collect()))
    assert sorted(map(tuple, fold.result().collect())) == [pytest.approx(w) if not isinstance(w[0], str) else w for w in want]
    fold.batch(spark.createDataFrame(batches[-1], FEEDBACK), len(batches) - 1)
    assert sorted(map(tuple, fold.result().collect())) == want


def test_confidence_equals_a_loop(spark):
    rng = random.Random(8)
    rows = [(i, day(1) + dt.timedelta(seconds=rng.randrange(50)), rng.choice("ab"), rng.random() < 0.4) for i in range(120)]
    before = {"a": (0.62, 3, 1), "c": (0.7, 9, 9)}
    state = {k: list(v) for k, v in before.items()} | {"b": [1.0, 0, 0]}
    for _, _, check, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        s = state[check]
        s[1 if not ok else 2] += 1
        s[0] = min(0.99, s[0] + 0.02) if ok else max(0.5, s[0] - 0.05) if s[1] > 5 else s[0]
    got = confidence_fold(spark.createDataFrame(rows, FEEDBACK), before=spark.createDataFrame([(k, *v) for k, v in before.items()], "check_type string, confidence double, false_positives long, confirmations long"))
    assert {r["check_type"]: tuple(r)[1:] for r in got.collect()} == {k: (pytest.approx(v[0]), v[1], v[2]) for k, v in state.items()}


def test_quality_and_drift_folds(spark, tmp_path):
    rows = [(day(1), "N/A", 1.0), (day(1), None, None), (day(2), "x", 5.0)]
    fold = WindowFold(spark, f"{tmp_path}/q", streams.quality_by_window(spark.createDataFrame(rows, "ts timestamp, word string, x double"), "ts"))
    fold.batch(fold.what.rows, 0)
    assert {(r["window_start"].day, r["column"]): (r["n_rows"], r["null_share"], r["pseudo_null_share"]) for r in fold.result().collect()} == {(1, "word"): (2, 0.5, 0.5), (1, "x"): (2, 0.5, 0.0), (2, "word"): (1, 0.0, 0.0), (2, "x"): (1, 0.0, 0.0)}
    drift = WindowFold(spark, f"{tmp_path}/d", streams.window_drift(spark.createDataFrame([(day(1), float(i)) for i in range(10)], "ts timestamp, x double"), "ts", "x", [0.0, 4.5, 9.0], [0.5, 0.5]))
    drift.batch(drift.what.rows.where(F.col("x") < 3), 0)
    drift.batch(drift.what.rows.where(F.col("x") >= 3), 1)
    assert [(r["total"], round(r["psi"], 9)) for r in drift.result().collect()] == [(10, 0.0)]
