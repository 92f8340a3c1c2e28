"""Values by shared words, against all pairs; strings within strings."""

import random

from cohortry.operators import keywords as K
from cohortry.operators import metrics as M

SCHEMA = "value string, value_desc string"


def split(text):
    out = (text or "").lower()
    for c in ",，;；/_-\t\n":
        out = out.replace(c, " ")
    return set(out.split())


def brute(queries, catalog, top):
    out = set()
    for i, q in queries:
        a = split(q)
        rows = []
        for value, desc in catalog:
            b = split(f"{value} {desc or ''}")
            hit = sum(any(x in y or y in x for y in b) for x in a)
            rows.append((-round(hit / len(a), 4) if a else 0.0, value))
        out |= {(i, v, -s + 0.0, r + 1) for r, (s, v) in enumerate(sorted(rows)[:top])}
    return out


def words(rng, n):
    return [" ".join("".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 5))) for _ in range(n)]


def test_lexical_search_equals_all_pairs(spark):
    rng = random.Random(5)
    catalog = [(f"{w} v{i}", rng.choice([None, "", "common", "common word"])) for i, w in enumerate(words(rng, 300))]
    catalog += catalog[:5]
    queries = [(i, q) for i, q in enumerate([*words(rng, 40), None, "", "common", "common", "nothing-alike zzz", "v7 common zz", "common word " + "q " * 3])]
    for top in (1, 4):
        found = M.lexical_search(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(catalog, SCHEMA), top).collect()
        assert len(found) == top * len(queries)
        assert {tuple(r) for r in found} == brute(queries, catalog, top)


def test_a_small_or_empty_catalog(spark):
    q = spark.createDataFrame([(1, "a b"), (2, None)], "query_id long, query string")
    assert M.value_search(q, spark.createDataFrame([], SCHEMA)).count() == 0
    got = {tuple(r) for r in M.value_search(q, spark.createDataFrame([("b", None), ("c", "x")], SCHEMA)).collect()}
    assert got == {(1, "b", 0.5, 1, True), (1, "c", 0.0, 2, False), (2, "b", 0.0, 1, False), (2, "c", 0.0, 2, False)}


def test_strings_held_in_others(spark):
    rng = random.Random(2)
    x = {"".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(40)} | {"é", "日本"}
    y = {"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(60)} | {"né", "日本語", ""}
    frame = K.held(spark.createDataFrame([(t,) for t in [*x, None, ""]], "x string"), spark.createDataFrame([(t,) for t in [*y, None]], "y string"))
    assert sorted(map(tuple, frame.collect())) == sorted((a, b) for a in x for b in y if a in b)
