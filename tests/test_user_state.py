"""Users' state in a stream: fields and views over batches, its beginning and its end."""

import os

import pytest
from pyspark.sql import functions as F

from cohortry.streaming import run as R
from cohortry.streaming.user_state import map_states, user_states

EVENT = "event_id string, user_id string, kind string, field string, value string, ts timestamp"


def stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        path = f"{folder}/{i}.json"
        with open(path, "w") as out:
            out.writelines(f'{{"event_id": "{e}", "user_id": "{u}", "kind": "{k}", "field": "{f}", "value": "{v}", "ts": "2024-{ts}"}}\n' for e, u, k, f, v, ts in rows)
        os.utime(path, (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.fixture
def versions(spark, tmp_path):
    def run(batches, initial=None, keep=30):
        told = []
        with map_states(spark):
            rows = R.drained(user_states(stream(spark, tmp_path, batches), initial, keep, "1 hour"), "update", progress=told)
        return rows.orderBy("user_id", "us", F.size("fields")).collect(), told

    return run


def test_later_batches_add_to_what_the_state_holds(spark, versions):
    initial = spark.createDataFrame([("u", {"age": "old", "city": "X"}, {"car0": "given"}), ("w", {"age": "none"}, None)], "user_id string, fields map<string,string>, views map<string,string>")
    rows, _ = versions(
        [
            [("1", "u", "profile", "age", "young", "01-01T10:00:00"), ("2", "u", "view", "car1", "a", "01-01T11:00:00")],
            [("3", "u", "profile", "age", "stale", "01-01T09:30:00"), ("4", "u", "view", "car1", "b", "01-01T12:00:00"), ("5", "v", "view", "car2", "c", "01-01T12:00:00")],
        ],
        initial,
    )
    u = [r for r in rows if r["user_id"] == "u"]
    assert u[-1]["fields"] == {"age": "young", "city": "X"} and u[-1]["views"] == {"car0": "given", "car1": "a"}
    assert [r["views"] for r in rows if r["user_id"] == "v"] == [{"car2": "c"}]
    assert {r["user_id"] for r in rows} == {"u", "v"} and len(u) == 2


def test_state_ends_and_late_rows_are_dropped(versions):
    rows, told = versions(
        [
            [("1", "u", "profile", "age", "young", "01-01T10:00:00")],
            [("2", "v", "profile", "age", "old", "06-01T10:00:00")],
            [("3", "v", "profile", "age", "older", "06-02T10:00:00")],
            [("4", "u", "profile", "age", "late", "01-02T10:00:00"), ("5", "v", "profile", "city", "Y", "06-03T10:00:00")],
            [("6", "u", "profile", "city", "Z", "06-04T10:00:00")],
        ]
    )
    u = [(r["fields"], r["ended"]) for r in rows if r["user_id"] == "u"]
    assert ({}, True) in u and ({"city": "Z"}, False) in u and len(u) == 3
    assert not any("late" in r["fields"].values() for r in rows)
    assert R.late_rows(told) == 1


def test_many_known_users_are_few_rows_of_state(spark, versions):
    known = [(f"u{i}", {"age": "old", "city": f"c{i}"}, {"car0": "given"}) for i in range(2000)]
    rows, told = versions(
        [
            [("1", "u1", "profile", "age", "young", "01-01T10:00:00"), ("2", "u2", "view", "car0", "a", "01-01T10:00:00"), ("3", "u2", "view", "car1", "b", "01-01T10:00:00")],
            [("4", "v", "profile", "age", "old", "06-01T10:00:00")],
            [("5", "v", "profile", "age", "older", "06-02T10:00:00")],
            [("6", "u1", "profile", "job", "Z", "06-03T10:00:00"), ("7", "u3", "profile", "job", "Z", "06-03T10:00:00")],
        ],
        spark.createDataFrame(known, "user_id string, fields map<string,string>, views map<string,string>"),
    )
    by = {u: [(r["fields"], r["views"], r["ended"]) for r in rows if r["user_id"] == u] for u in ("u1", "u2", "u3")}
    given = {"car0": "given"}
    assert sorted(by["u1"], key=str) == sorted([({"age": "young", "city": "c1"}, given, False), ({}, {}, True), ({"job": "Z"}, {}, False)], key=str)
    assert sorted(by["u2"], key=str) == sorted([({"age": "old", "city": "c2"}, {"car0": "given", "car1": "b"}, False), ({}, {}, True)], key=str)
    assert by["u3"] == [({"age": "old", "city": "c3", "job": "Z"}, given, False)]
    assert {r["user_id"] for r in rows} == {"u1", "u2", "u3", "v"}
    assert max(o["numRowsTotal"] for p in told for o in p["stateOperators"]) < 1000
