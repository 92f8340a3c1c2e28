"""Titles alike, greedy keep-first and connected components against plain Python."""

import random
import time
from difflib import SequenceMatcher

import pytest

from cohortry.operators import groups as G
from cohortry.operators import web as B
from cohortry.plans import web_queries as Q


def near(later, earlier, ratio):
    if abs(len(later) - len(earlier)) / max(len(later), len(earlier)) > 1 - ratio:
        return False
    return SequenceMatcher(None, later, earlier).ratio() >= ratio


def greedy(titles, ratio):
    """id: the id that makes it go, or its own, as a reader would who compares each title with those kept so far."""
    kept, out = [], {}
    for i, t in sorted(titles):
        by = [j for j, u in kept if t and (t == u or near(t, u, ratio))] if t else []
        out[i] = min(by, default=i)
        if not by and t:
            kept.append((i, t))
    return out


def union(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def made_titles(seed, n, letters="abcdefghij"):
    rng = random.Random(seed)
    opening = "".join(rng.choice(letters) for _ in range(29))
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n // 6)]
    base += [opening + "".join(rng.choice(letters) for _ in range(rng.randint(2, 30))) for _ in range(n // 6)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        out.append((i, "".join(t)))
    return out


@pytest.mark.parametrize(("ratio", "few", "seed"), [(0.9, 10**6, 1), (0.9, 0, 2), (0.8, 5, 3), (0.6, 10**6, 4)])
def test_same_titles_equal_greedy(spark, monkeypatch, ratio, few, seed):
    monkeypatch.setattr(G.kept_first, "__defaults__", (few, 1000))
    titles = made_titles(seed, 400 if few else 150) + [(1000, None), (1001, ""), (1002, "x" * 250), (1003, "x" * 250 + "y" * 9)]
    got = {r["id"]: r["keep"] for r in B.same_titles(spark.createDataFrame(titles, "id int, norm string"), ratio).collect()}
    want = greedy([(i, t or "") for i, t in titles], ratio)
    assert got == want and sum(i != k for i, k in want.items()) > 20


def test_two_thousand_titles(spark):
    titles = made_titles(9, 2000)
    got = {r["id"]: r["keep"] for r in B.same_titles(spark.createDataFrame(titles, "id int, norm string")).collect()}
    # Equal titles first: brute force compares a tenth of a million pairs a second.
    first = {}
    for i, t in titles:
        first.setdefault(t, i)
    heads = greedy([(i, t) for t, i in first.items()], 0.9)
    assert got == {i: heads[first[t]] for i, t in titles}


def test_no_pair_is_missed_by_marks_or_signatures():
    rng = random.Random(5)
    for ratio in (0.95, 0.9, 0.85, 0.8, 0.7, 0.55):
        own = B.TitleMarks(ratio)
        seen = 0
        for _ in range(4000):
            a = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
            b = list(a)
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "a"])
            a, b = "".join(a), "".join(b)
            if not b or a == b or not near(a, b, ratio):
                continue
            seen += 1
            assert set(own.marks(a)) & set(own.marks(b)), (ratio, a, b)
            odd = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(own.signature(a), own.signature(b)))
            assert odd <= len(a) + len(b) - 2 * B._common_least(len(a), len(b), ratio)
        assert seen > 50


def test_shared_openings_take_no_longer(spark):
    rng = random.Random(6)
    took = []
    for n in (200, 1600):
        opening = "".join(rng.choice("abcdefghij") for _ in range(29))
        titles = [(i, opening + "".join(rng.choice("abcdefghijklmnop") for _ in range(25))) for i in range(n)]
        began = time.time()
        assert all(r["id"] == r["keep"] for r in B.same_titles(spark.createDataFrame(titles, "id int, norm string")).collect())
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 2


@pytest.mark.parametrize("few", [0, 7, 10**6])
def test_components_equal_union_find(spark, few):
    rng = random.Random(few)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(25)] + [(200, 200 + i) for i in range(1, 30)] + [(1, 1), (None, 3)]
    got = {r["node"]: r["root"] for r in G.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    want = union([e for e in edges if None not in e and e[0] != e[1]])
    assert got == want
    names = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert {tuple(r) for r in G.components(names, few).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert G.components(names.limit(0), few).count() == 0 and G.kept_first(names.limit(0).toDF("later", "earlier"), few).count() == 0


def test_best_page_of_every_group(spark, sf):
    titles = [(r["id"], r["norm"] or "") for r in Q._titles(spark, sf).collect()]
    edges = [(i, j) for i, t in titles for j, u in titles if j < i and t and u and (t == u or near(t, u, 0.9))]
    roots = union(edges)
    quality = {r["page_id"]: len(r["html"]) % 100 / 10 for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    best = {}
    for i, _ in titles:
        g = roots.get(i, ("own", i))
        best[g] = min(best.get(g, (1, 0)), (-quality[i], i))
    got = sorted((r["id"], r["grp"], r["quality"]) for r in Q.d47_best_of_group(spark, sf).collect())
    assert got == sorted((i, roots.get(i), quality[i]) for _, i in best.values())
