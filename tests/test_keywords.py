"""Keywords, containment and suggestions against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cohortry.operators import keywords as K


@pytest.mark.parametrize("block", [500_000, 60])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_CHARS", block)
    rng = random.Random(block)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["é😀", ""]
    rows = [(i if i % 7 else None, "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 30))) if i % 9 else None, "x") for i in range(60)]
    texts = spark.createDataFrame(rows + rows[:3], "id long, text string, hits string")
    keys = spark.createDataFrame([(w,) for w in words + words[:5]] + [(None,)], "keyword string")
    got = sorted(((r["id"] or -1, r["text"] or "", r["hits"]) for r in K.keyword_hits(texts, keys).collect()), key=str)
    want = sorted(((i or -1, t or "", sorted({w for w in words if w and w in (t or "")})) for i, t, _ in rows + rows[:3]), key=str)
    assert got == want
    assert all(r["hits"] == [] for r in K.keyword_hits(texts, keys.limit(0)).collect()) and K.keyword_hits(texts.limit(0), keys).count() == 0


def test_time_does_not_grow_with_keywords(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    rng = random.Random(2)
    words = sorted({w for r in docs.limit(300).collect() for w in (r["text"] or "").split() if len(w) > 5})
    took, counts = [], []
    for n in (100, 10_000):
        some = words[: n // 2] + ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n - n // 2)]
        keys = spark.createDataFrame([(w,) for w in some], "keyword string")
        began = time.time()
        counts.append({r["doc_id"]: len(r["hits"]) for r in K.keyword_hits(docs, keys).collect()})
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 3
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id % 50 = 0").collect()}
    assert all(counts[1][i] == sum(w in t for w in set(some)) for i, t in texts.items())


def test_contained_both_ways(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["", None]
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(25)] + [""]
    got = {tuple(r) for r in K.contained(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(v, n) for v in values for n in names if v and n and v != n and (v in n or n in v)}


def test_suggestions_equal_all_pairs(spark):
    rng = random.Random(4)
    values = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(40)}
    names = [(f"c{i}", "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))) for i in range(30)]
    grams = lambda s: {s[i : i + 2] for i in range(max(1, len(s) - 1))}
    want = set()
    for v in values:
        told = sorted((-round(2 * len(grams(v) & grams(n)) / (len(grams(v)) + len(grams(n))), 4), c) for c, n in names if grams(v) & grams(n))[:3]
        want |= {(v, c, -s, k + 1) for k, (s, c) in enumerate(told)}
    made = K.suggestions(spark.createDataFrame([(v,) for v in [*values, None, ""]], "value string"), spark.createDataFrame(names, "code string, name string"))
    assert {tuple(r) for r in made.collect()} == want
