"""Stores changed by batches: what is read and rewritten, repeated and killed batches."""

import pytest
from pyspark.sql import functions as F

from cohortry.sources.store import Store

SCHEMA = "id long, name string, content_hash string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(store):
    return {r["id"]: r["name"] for r in store.read().collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), SCHEMA, ["id"], buckets=8)


def test_only_touched_buckets_are_read_and_rewritten(spark, store):
    first = store.upsert("a", frame(spark, [(i, f"n{i}", None) for i in range(200)]))
    assert first == {"touched": 8, "read": 0, "rewritten": 0, "rows": 200}
    got = store.upsert("b", frame(spark, [(7, "new", None), (7, "mew", None)]))
    assert (got["touched"], got["read"], got["rewritten"]) == (1, 1, 1) and got["rows"] < 60
    want = {i: f"n{i}" for i in range(200)} | {7: "new"}
    assert held(store) == want
    added = store.insert("c", frame(spark, [(5, "no", None), (1000, "yes", None)]))
    assert added["rewritten"] == 0 and added["rows"] == 1
    assert held(store) == want | {1000: "yes"}


def test_repeated_and_killed_batches(spark, store, monkeypatch):
    store.upsert("a", frame(spark, [(1, "x", None), (2, "y", None)]))
    batch = frame(spark, [(2, "z", None), (3, "w", None)])

    def dies(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "_write_filters", dies)
    with pytest.raises(RuntimeError):
        store.upsert("b", batch)
    assert held(store) == {1: "x", 2: "y"}
    monkeypatch.undo()
    store.upsert("b", batch)
    assert held(store) == {1: "x", 2: "z", 3: "w"}
    assert store.upsert("b", batch)["touched"] == 0
    assert held(store) == {1: "x", 2: "z", 3: "w"} and store.read().count() == 3


def test_unchanged_content_is_skipped(spark, store):
    rows = spark.createDataFrame([(1, "a  b"), (2, "c"), (3, None)], "id long, name string")
    store.upsert_changed("a", rows, "name")
    again = spark.createDataFrame([(1, "a b"), (2, "d"), (4, "e")], "id long, name string")
    store.upsert_changed("b", again, "name")
    assert held(store) == {1: "a  b", 2: "d", 3: None, 4: "e"}


def test_empty_batches_null_keys_and_many_versions(spark, store):
    assert store.read().count() == 0
    assert store.insert("none", frame(spark, []))["rows"] == 0
    assert store.read().count() == 0
    with pytest.raises(ValueError):
        store.upsert("null", frame(spark, [(None, "x", None)]))
    small = Store(spark, store.root + "2", SCHEMA, ["id"], buckets=1)
    for i in range(10):
        small.insert(str(i), frame(spark, [(i, "x", None)]))
    assert len(held(small)) == 10 and len(small.versions()[0]) < 9
    assert small.manifest().where(F.col("rewritten")).count() == 1
