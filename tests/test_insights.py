"""Insights are asked for once: what failed or is new is scored when the stage runs again."""

from cohortry.operators import web as B
from cohortry.sources.store import Store


def test_only_new_and_failed_articles_are_scored_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "insights"), "id long, category string, thoughts string", ["id"], buckets=2)
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "bad"), (3, "b", "y"), (3, "b", "y"), (4, "c", "z")], "id long, category string, text string")

    def first(row):
        if row["text"] == "bad":
            raise ValueError("no answer")
        return {"thoughts": f"first {row['text']}"}

    def second(row):
        return {"thoughts": f"second {row['text']}"}

    out = "thoughts string"
    assert sorted((r["id"], r["thoughts"]) for r in B.insights(rows, store, "1", first, out, ["a", "b"]).collect()) == [(1, "first x"), (3, "first y")]
    want = [(1, "first x"), (2, "second bad"), (3, "first y")]
    assert sorted((r["id"], r["thoughts"]) for r in B.insights(rows, store, "2", second, out, ["a", "b"]).collect()) == want
    assert len(B.insights(rows, store, "3", second, out).collect()) == 4
    assert B.insights(rows.limit(0), store, "4", second, out).count() == 4
