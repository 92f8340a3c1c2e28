import itertools
import random

import pytest
import xxhash

from cohortry.llm import simhash as S


def slow_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice(["A", "bé", "c\tD"]) for _ in range(n))
        assert S.fingerprint(text) == slow_fingerprint(text)
    assert S.fingerprint(None) == 0


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    text = " ".join(str(i % 13) for i in range(200))
    assert S.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("pairs_up_to", [4, 10_000])
def test_links_equal_brute_force(spark, monkeypatch, distance, pairs_up_to):
    monkeypatch.setattr(S, "PAIRS_UP_TO", pairs_up_to)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = set()
    for _ in range(150):
        x = base
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = [(r[0] % 2**64, r[1] % 2**64) for r in S.links(frame, distance).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in edges)
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= distance]
    assert classes(fps, edges) == classes(fps, near)


def test_groups_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.collect()}
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = classes(fps, near)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in S.simhash_groups(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    kept = [r["doc_id"] for r in S.near_dedup(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, None, 1), (3, "", 2), (None, "a b c d", 3), (7, "a b c d", 4), (7, "a b c d", 4), (9, "q " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.simhash_groups(docs).collect()), key=str)
    assert got == [(3, 3), (5, 3), (7, 7), (7, 7), (9, 9), (None, 7)]
    assert sorted(r["doc_id"] for r in S.near_dedup(docs).collect()) == [3, 7, 9]
    assert S.simhash_groups(docs.limit(0)).count() == 0
