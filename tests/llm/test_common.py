import random

import pytest

from cohortry.llm import common


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 30)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = common.linked_groups(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == want


def test_no_edges(spark):
    assert common.linked_groups(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [0, 100])
def test_rows_without_ids(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d")], "doc_id long, _gone string")
    gone = spark.createDataFrame([(2,), (None,)], "x long")
    assert [tuple(r) for r in common.without_ids(docs, gone, "doc_id").collect()] == [(1, "a")]
