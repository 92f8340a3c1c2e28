import itertools
import random

import pytest
from test_simhash import classes

from cohortry.llm import near_copies as N


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute(texts):
    """The smallest id of every group of near copies, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return sorted(set(classes(sets, near).values())), near


@pytest.mark.parametrize("setting", [{}, {"PAIRS_UP_TO": 1, "BLOCK": 3, "WHOLE": 1000, "HOT": 2}, {"PAIRS_UP_TO": 2, "WHOLE": 300}])
def test_edited_copies_go_as_in_brute_force(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(N, name, value)
    rng = random.Random(3)
    texts = {}
    for base in range(8):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 40, 120, 400]))]
        for _ in range(12):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 50))):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(v)
    texts |= {len(texts): "", len(texts) + 1: None, len(texts) + 2: "a b"}
    want, near = brute(texts)
    assert len(near) > 50 and len(want) > 10
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.near_copies(docs).collect()) == want


def test_stage_equals_brute_force_jaccard(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, near = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    assert near and sorted(r["doc_id"] for r in dict(P.STAGES)["near_dedup"](spark, docs, "").collect()) == want


def test_fingerprints_differ_at_most_as_sets_do():
    rng = random.Random(4)
    for n in (1, 30, 700):
        w = [str(rng.randrange(50)) for _ in range(n)]
        v = [x if rng.random() > 0.1 else "x" for x in w]
        a, b = N.shingle_set(" ".join(w)), N.shingle_set(" ".join(v))
        f, g = sorted((N.parity(a).view("u8"), N.parity(b).view("u8")), key=len)
        assert len(g) in (len(f), 2 * len(f)) and 128 * len(f) >= 2 * n
        g = g if len(g) == len(f) else g[: len(f)] ^ g[len(f) :]
        odd = sum(int(x ^ y).bit_count() for x, y in zip(f, g))
        assert odd <= len(set(a) ^ set(b)) and (n == 1 or odd > 0)


def test_passages_shared_by_many_do_not_join(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRS_UP_TO", 4)
    monkeypatch.setattr(N, "HOT", 3)
    rng = random.Random(5)
    passages = [" ".join(f"p{k}-{i}" for i in range(60)) for k in range(4)]
    texts = {i: f"{rng.choice(passages)} {rng.choice(passages)} " + " ".join(f"o{rng.randrange(40)}" for _ in range(rng.randint(5, 40))) for i in range(120)}
    want, near = brute(texts)
    assert 5 < len(want) < 115
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.near_copies(docs).collect()) == want


def test_empty_table(spark):
    assert N.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edited(rng, sizes, copies=8):
    """Texts of some sizes with copies that differ in a few words, some of them shorter or longer."""
    texts = {}
    for n in sizes:
        w = [f"w{rng.randrange(4000)}" for _ in range(n)]
        for _ in range(copies):
            v = list(w)
            for _ in range(rng.randint(0, max(1, n // 55))):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            cut = rng.randint(0, n // 12)
            texts[len(texts)] = " ".join(v[cut:] if rng.random() < 0.5 else v)
    return texts


def test_near_sets_share_positional_words_of_section_simhashes():
    rng = random.Random(8)
    share, few = (4, 5), 0
    texts = edited(rng, [8, 20, 60, 66, 70, 130, 135, 300, 520, 700])
    _, near = brute(texts)
    made = {i: {level: (set(words.tolist()), words, first) for level, words, first in N.postings(N.shingle_set(t), share, N.SECTION, frozenset())} for i, t in texts.items()}
    for order in (lambda w: w, lambda w: w * 0x9E3779B1 % 1_000_003):  # any order of all words
        for a, b in near:
            x, y = N.shingle_set(texts[a]), N.shingle_set(texts[b])
            if set(x.tolist()) == set(y.tolist()):
                continue
            level = max(len(x), len(y)).bit_length() - 1  # where the larger is at home
            firsts = []
            for i in (a, b):
                words, _, first = made[i][level]
                assert first
                firsts.append(set(sorted(words, key=lambda w: (order(w), w))[:first]))
            assert len(firsts[0] & firsts[1]) >= N.SHARED
            few += len(x) >= 64
    assert few > 100


def test_words_are_simhashes_of_sections():
    import numpy as np

    from cohortry.llm.simhash import section_words

    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2)
    for sections in (1, 3, 40, 500):  # more than 255 hashes in a section, a few, one or two
        places, words = section_words(h, sections)
        place = (h * np.uint64(0xA24BAED4963EE407) >> np.uint64(32)) % np.uint64(sections)
        want = {}
        for p in set(place.tolist()):
            own = [int(v) for v in h[place == p]]
            want[p] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in own) > len(own))
        assert dict(zip(places.tolist(), words.tolist())) == want and sorted(want) == places.tolist()
    assert section_words(h, 0)[0].tolist() == sorted(h.tolist())


@pytest.mark.parametrize("section", [2, 1 << 20])
def test_sections_that_promise_nothing_are_cut_finer(spark, monkeypatch, section):
    monkeypatch.setattr(N, "SECTION", section)
    texts = edited(random.Random(9), [66, 130, 300], 7)
    levels = [(level, first) for t in texts.values() for level, _, first in N.postings(N.shingle_set(t), (4, 5), section, frozenset())]
    assert any(first == 0 for level, first in levels if level >= 6) == (section > 2)
    want, near = brute(texts)
    assert near and 3 <= len(want) < len(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.near_copies(docs).collect()) == want
