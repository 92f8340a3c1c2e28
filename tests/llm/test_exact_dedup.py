import random

import duckdb
from pyspark.sql import functions as F

from cohortry.llm import exact_dedup as X


def test_groups_equal_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    want = con.execute(X.EXACT_SQL).fetchall()
    docs = spark.read.parquet(path)
    assert sorted(map(tuple, X.exact_groups(docs).collect())) == sorted(want)
    assert sorted(r["doc_id"] for r in X.exact_dedup(docs).collect()) == sorted(r[0] for r in want if r[3])


def test_chunks_join_to_the_text_and_meet_again(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("aeinorstcm") for _ in range(rng.randint(1, 12))) for _ in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "some words put before " + text), (3, "é" * 9000)], "doc_id long, text string")
    pieces = docs.select("doc_id", F.regexp_extract_all(X.normalized(F.col("text")), F.lit(X.CHUNKS), F.lit(0)).alias("c"), "text").collect()
    assert all("".join(r["c"]) == r["text"] for r in pieces)
    a, b = ({h["h"] for h in r["chunks"]} for r in X.recipes(docs).orderBy("id").take(2))
    assert len(a) > 50 and len(a & b) >= len(a) - 3


def test_clashing_hashes_are_told_apart(spark):
    made = spark.createDataFrame(
        [(1, "x", [(7, b"a")]), (2, "y", [(7, b"b")]), (3, "x", [(7, b"a")]), (4, "z", [(8, b"c"), (7, b"b")])],
        "id long, text_sha256 string, chunks array<struct<h:long,sha:binary>>",
    )
    clashes = X.chunk_clashes(made)
    assert sorted((r["h"], bytes(r["sha"]), r["variant"]) for r in clashes.collect()) == [(7, b"a", 0), (7, b"b", 1)]
    rows = X.identified(made, clashes).collect()
    by = {}
    for r in rows:
        by.setdefault((tuple(r["recipe"]), tuple(r["variants"])), []).append(r["id"])
    assert sorted(map(sorted, by.values())) == [[1, 3], [2], [4]]


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(5, None, 1), (3, "", 2), (None, "a  b", 3), (7, "a\n\tb", 4), (7, "a b", 4), (None, "q", 5)], "doc_id long, text string, recipe int"
    )
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_groups(docs).collect()), key=str)
    assert got == [(3, 3, 2, True), (5, 3, 2, False), (7, 7, 3, True), (7, 7, 3, True), (None, 7, 3, False), (None, None, 1, True)]
    assert X.exact_groups(docs.limit(0)).count() == 0
