"""Sessions, sliding windows and follow-ups over streams whose files come one at a time, with late rows (late by the watermark of the batch before)."""

import os

from pyspark.sql import functions as F

from cohortry.streaming import events as E
from cohortry.streaming import run as R

SCHEMA = "event_id string, user_id string, kind string, ts timestamp"


def streamed(spark, folder, batches):
    """A stream of one file for each batch, in order."""
    for i, rows in enumerate(batches):
        path = f"{folder}/{i}.json"
        with open(path, "w") as out:
            out.writelines(f'{{"event_id": "{e}", "user_id": "{u}", "kind": "{k}", "ts": "2024-01-{ts}:00"}}\n' for e, u, k, ts in rows)
        os.utime(path, (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def test_sessions_close_and_late_rows_are_told(spark, tmp_path):
    batches = [
        [("1", "u", "view", "01T10:00"), ("2", "u", "view", "01T10:20"), ("3", "v", "view", "05T10:00")],
        [("5", "v", "view", "05T10:10")],
        [("4", "u", "view", "01T10:25"), ("6", "w", "view", "09T10:00")],
    ]
    told = []
    rows = R.drained(E.sessions(streamed(spark, tmp_path, batches)), progress=told)
    got = sorted((r["user_id"], r["n"], str(r["start"]), str(r["end"])) for r in rows.collect())
    assert got == [("u", 2, "2024-01-01 10:00:00", "2024-01-01 10:50:00"), ("v", 2, "2024-01-05 10:00:00", "2024-01-05 10:40:00")]
    assert R.late_rows(told) == 1


def test_sliding_windows_overlap(spark, tmp_path):
    batches = [[("1", "u", "view", "01T10:00"), ("2", "u", "view", "01T20:00")], [("3", "u", "view", "09T10:00")]]
    rows = R.drained(E.live_counts(streamed(spark, tmp_path, batches), slide="12 hours")).orderBy("start")
    assert [(str(r["start"]), r["n"]) for r in rows.collect()] == [("2023-12-31 12:00:00", 1), ("2024-01-01 00:00:00", 2), ("2024-01-01 12:00:00", 1)]


def test_follow_ups_meet_over_batches_and_late_ones_are_told(spark, tmp_path):
    batches = [
        [("1", "u", "view", "01T10:00"), ("2", "u", "buy", "01T09:00"), ("3", "v", "view", "01T10:00")],
        [("4", "u", "buy", "02T10:00"), ("5", "v", "buy", "09T10:00"), ("6", "u", "view", "09T10:00")],
        [("8", "u", "buy", "09T11:00")],
        [("7", "u", "buy", "03T09:00")],
    ]
    told = []
    s = streamed(spark, tmp_path, batches)
    rows = R.drained(E.followed(s.where("kind = 'view'"), s.where(F.col("kind") == "buy"), "2 days"), progress=told)
    assert sorted((r["first_id"], r["then_id"]) for r in rows.collect()) == [("1", "4"), ("6", "8")]
    assert R.late_rows(told) == 1
