import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cohortry.llm import decontaminate as D
from cohortry.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, bench, width):
    windows = defaultdict(set)
    for item, text in bench:
        w = slow_words(text)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[k : k + width])].add(item)
    out = []
    for text in docs:
        w, hit, items = slow_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((len(w), len(hit), sorted(items)))
    return out


def test_suffix_arrays_and_search():
    rng = random.Random(2)
    for _ in range(150):
        n, top = rng.randint(1, 60), rng.choice([2, 3, 9])
        text = np.array([rng.randint(1, top) for _ in range(n)])
        closed = np.concatenate((text, [0]))
        assert suffix_array(closed).tolist() == sorted(range(n + 1), key=lambda i: closed[i:].tolist())
        index = FMIndex(text, rng.choice([1, 3, 8]))
        lengths = np.array([rng.randint(1, 4) for _ in range(20)])
        patterns = np.zeros((20, 4), np.int32)
        for i, k in enumerate(lengths):
            patterns[i, :k] = [rng.randint(1, top + 1) for _ in range(k)]
        low, high = index.search(patterns, lengths)
        for i, k in enumerate(lengths):
            want = [j for j in range(n - k + 1) if text[j : j + k].tolist() == patterns[i, :k].tolist()]
            assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want


@pytest.mark.parametrize("chunk", [1 << 18, 5])
def test_shards_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(D, "CHUNK", chunk)
    rng = random.Random(3)
    letters = "ab cd ef gh é1 z".split()
    for _ in range(150):
        docs = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(8)]
        bench = [(str(i), " ".join(rng.choice(letters[:3]) for _ in range(rng.randint(0, 7)))) for i in range(6)]
        found = [D.words(d) for d in docs]
        k = rng.randint(0, 6)
        got = [(len(w), sum(j - i for i, j in s), sorted(x)) for w, (s, x) in zip(found, D.shard_hits(found, [D.Phrases.of(b, 4) for b in (bench[:k], bench[k:])]))]
        assert got == brute(docs, bench, 4)


def test_blocks_of_the_benchmark_agree(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, D.contamination(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", 300)
    monkeypatch.setattr(D, "BLOCKS", 2)
    assert len(list(D._blocks(bench, "item_id", "text", 10))) > 2
    assert sorted(map(tuple, D.contamination(docs, bench).collect())) == one
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()]
    rows = docs.orderBy("doc_id").collect()
    assert [(r[1], r[2], r[3]) for r in one] == [(n, h, len(x)) for n, h, x in brute([r["text"] for r in rows], items, 10)]


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "One two three, four"), (None, "five six")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x ONE Two-three four! five six y", "a"), (2, None, "b"), (3, "é one two", None), (3, "é one two", None), (None, "", "c")],
        "doc_id long, text string, found string",
    )
    got = sorted(map(tuple, D.decontaminate(docs, bench, 4).collect()), key=str)
    assert got == sorted([(1, "x  y", "a"), (2, None, "b"), (3, "é one two", None), (3, "é one two", None), (None, "", "c")], key=str)
    told = {r["doc_id"]: r for r in D.contamination(docs, bench, 4).collect()}
    assert (told[1]["n_hit"], told[1]["n_items"], told[1]["contaminated"]) == (6, 1, True)
    assert (told[2]["n_words"], told[2]["contaminated"]) == (0, False)
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_benchmark_of_several_megabytes_stays_small():
    rng = np.random.default_rng(1)
    n = 600_000
    drawn = [b"w%x" % x for x in rng.integers(0, 1 << 40, 60_000)]
    sizes = np.full(n // 150, 150)
    hashes = D.hashed(drawn)[rng.integers(0, len(drawn), n)]
    block = D.Phrases(list(map(str, range(len(sizes)))), sizes, hashes)
    assert block.codes.nbytes + block.vocabulary.nbytes < 6 * n
    by = dict(zip(D.hashed(drawn).tolist(), drawn))
    copied = [by[h] for h in hashes[1500:1560].tolist()]
    found = D.shard_hits([[b"other"] * 30 + copied + [b"other"], drawn[:500]], [block])
    assert found[0] == ([(30, 90)], {"10"}) and not found[1][0]


def test_repeated_items_count_once(spark):
    bench = spark.createDataFrame([(7, "a b c d e")] * 3 + [(10, "b c d e"), (9, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e"), (1, "b c d e")], "doc_id long, text string")
    assert sorted(tuple(r)[1:4] for r in D.contamination(docs, bench, 4).collect()) == [(4, 4, 2), (6, 5, 2)]
