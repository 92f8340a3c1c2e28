import hashlib
from collections import defaultdict

import numpy as np
import pytest

from cohortry.llm import line_dedup as L


def slow_keys(text):
    keys = [x.strip(b" \t\n\x0b\x0c\r").lower() for x in (text or "").encode().split(b"\n")]
    return [k if len(k.decode()) >= 20 else None for k in keys]


def brute(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for k in slow_keys(text):
            if k:
                holders[k].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").encode().split(b"\n")
        kept = [x for x, k in zip(lines, slow_keys(text)) if not (k and len(holders[k]) >= 3 and max(holders[k]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("setting", [{}, {"BROADCAST_KEYS": 0}, {"BROADCAST_HASHES": 0}, {"RANGES": 5, "LEAST_BYTES": 1}, {"RANGES": 1, "BYTES_PER_BIT": 1000}])
def test_report_equals_brute_force(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(L, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r[0]: tuple(r)[1:] for r in L.line_dedup_report(docs).collect()} == want
    assert sum(v[1] for v in want.values()) > 0


def test_filters_miss_nothing():
    rng = np.random.default_rng(1)
    pair = L.BloomPair(1 << 16)
    seen = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    assert len(pair.add(seen)) < 100
    told = pair.add(np.concatenate((seen[:100], rng.integers(0, 1 << 63, 50, dtype=np.uint64))))
    assert set(seen[:100]) <= set(told) and len(told) < 120 and len(pair.add(seen[:100])) == 0
    assert L.BloomPair.holds(pair.twice, seen[:100]).all() and L.BloomPair.holds(pair.twice, seen[100:]).mean() < 0.05
    assert L.BloomPair.holds(pair.once, seen).all()
    assert len(pair.add(rng.integers(0, 1 << 63, 50, dtype=np.uint64), sure=True)) > 45


def test_rows_and_columns_stay(spark):
    line = "A line of more than twenty characters"
    docs = spark.createDataFrame(
        [(1, f"x\n {line} ", 1), (2, line.upper(), 2), (3, f"{line}\r\ny", 3), (3, f"{line}\r\ny", 3), (None, line, 4), (None, None, 5), (4, "", None)],
        "doc_id long, text string, key int",
    )
    got = sorted(map(tuple, L.line_dedup(docs).collect()), key=str)
    want = [(1, "x", 1), (2, "", 2), (3, f"{line}\r\ny", 3), (3, f"{line}\r\ny", 3), (None, "", 4), (None, None, 5), (4, "", None)]
    assert got == sorted(want, key=str)
    assert L.line_dedup(docs.limit(0)).count() == 0


def test_columns_may_have_helpers_names(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_KEYS", 0)
    line = "A line of more than twenty characters"
    docs = spark.createDataFrame([(i, line, i, "x") for i in range(3)], "doc_id long, text string, _drop_id int, _dropped string")
    assert sorted(map(tuple, L.line_dedup(docs).collect())) == [(0, "", 0, "x"), (1, "", 1, "x"), (2, line, 2, "x")]
