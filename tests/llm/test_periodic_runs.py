"""Runs against brute force over all periods."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortry.llm import periodic_runs, queries


def brute(words):
    """All runs, by comparing the words of every period."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def report(words, runs):
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (
        len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def test_whole_table_equals_brute_force(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {}
    for r in docs:
        words = planted(r.doc_id, r.text)
        want[r.doc_id] = report(words, brute(words) if len(words) < 6000 else periodic_runs.runs_of([words])[0])
    assert got == want and sum(r[0] > 0 for r in got.values()) > 10


def test_grammar_derives_the_text():
    rng = random.Random(1)
    for _ in range(60):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 80))]
        rules, ends = periodic_runs.repair(words, 100)
        for left, size, first, places in rules:
            assert len(places) > 1 and 0 < left < size and first == places[0]
            assert len({tuple(words[i : i + size]) for i in places}) == 1
        assert ends[0] == 0 and ends == sorted(ends)


@st.composite
def texts(draw):
    out = []
    for _ in range(draw(st.integers(1, 6))):
        block = draw(st.lists(st.sampled_from("abc"), min_size=1, max_size=12))
        out += block * draw(st.integers(1, 14))
        out += draw(st.lists(st.sampled_from("abcdef"), max_size=5))
    return out * draw(st.integers(1, 4))


@settings(max_examples=400, deadline=None)
@given(st.lists(texts(), min_size=1, max_size=4))
def test_any_texts(some):
    assert periodic_runs.runs_of(some) == [brute(t) for t in some]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts(), min_size=1, max_size=3))
def test_hashes_that_clash_change_nothing(monkeypatch, some):
    monkeypatch.setattr(periodic_runs, "_mixed", lambda codes: codes.astype(np.uint64) % np.uint64(3))
    assert periodic_runs.runs_of(some) == [brute(t) for t in some]


def test_runs_within_runs():
    inner = ["a"] * 30 + ["b"]
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    some = [inner * 5, (inner * 4 + ["c"]) * 4, list(fib[-1]), list("ab" * 12), list("ab" * 11 + "a"), list("a" * 23), list("a" * 24), ["x"] * 5000]
    assert periodic_runs.runs_of(some) == [brute(t) for t in some]


def test_nulls_ties_repeats_and_clashing_names(spark):
    run = " ".join("abcdefgh" * 3)
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t ", 0), (None, run, 1), (None, run, 1), (5, f"{run} x {run}", 2), (5, "a " * 24, 3), (6, " ".join(["\x1cé"] * 24), 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = sorted((r.doc_id or -1, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect())
    one = " ".join("abcdefgh")
    assert got == [(-1, [(0, 24, 8)], one)] * 2 + [(1, [], ""), (2, [], ""), (3, [], ""), (5, [(0, 24, 1)], "a"), (5, [(0, 24, 8), (25, 24, 8)], f"{one} x {one}"), (6, [(0, 24, 1)], "\x1cé")]
    told = {(r.doc_id, r.n_runs): tuple(r) for r in periodic_runs.runs_report(docs).collect()}
    assert told[5, 2][2:6] == (0, 24, 8, 3000) and told[1, 0][2:6] == (None,) * 4
    assert periodic_runs.runs_report(docs.limit(0)).count() == 0
    # A null id gets no periodic end, and neither does a text without words.
    assert [r.text for r in periodic_runs.with_periods(docs).where("doc_id is null or doc_id < 4").orderBy("doc_id").collect()] == [run, run, None, "", " \n\t "]


@pytest.mark.parametrize("text", [["a"] * 200_000, (["a"] * 1000 + ["b"]) * 200, [str(i % 5000) for i in range(200_000)], [str(i * i % 7919) for i in range(200_000)]])
def test_long_periodic_texts_in_time(text):
    began = time.time()
    (runs,) = periodic_runs.runs_of([text])
    assert runs and time.time() - began < 30
    for s, n, q in runs:
        assert text[s : s + n - q] == text[s + q : s + n] and (s == 0 or text[s - 1] != text[s - 1 + q]) and (s + n == len(text) or text[s + n] != text[s + n - q])
