"""Encoding and decoding against the library on whole texts."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortry.llm import bpe, queries

FILE = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TRICKY = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n  b  \n", "it's  we'll 'S", "x  y  z", "\x1c a \x1db", "a \x85b", "<|endoftext|> x", "中文 字 ,,,  ...", "a" * 3000, " " * 3000 + "x", "é ​ z", "👩‍👩‍👧 x", "\x00 \x00", "1 2 34  5", "don't  ' s"]


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table_equals_library(spark, sf, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_bpe_round_trip(spark, sf).collect()}
    want = {r.doc_id: digests(library, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == want


def test_odd_texts_ids_and_extra_columns(spark, library):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(TRICKY)] + [(1, "a  b", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = bpe.round_trip(docs, P.path(FILE), P.PATTERN)
    assert sorted((r.doc_id or -1, *r[1:]) for r in made.collect()) == sorted((i or -1, *digests(library, t)) for i, t, _ in rows)
    lists = bpe.encoded(docs, P.path(FILE), P.PATTERN)
    assert sorted((r.doc_id or -1, r.ids) for r in lists.collect()) == sorted((i or -1, library.encode_ordinary(t or "")) for i, t, _ in rows)
    back = bpe.decoded(lists, P.path(FILE), P.PATTERN)
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in back.collect()) == sorted((i or -1, (t or "").encode()) for i, t, _ in rows)
    assert bpe.broken_texts(docs, P.path(FILE), P.PATTERN).count() == 0
    assert bpe.round_trip(docs.limit(0), P.path(FILE), P.PATTERN).count() == 0


def test_part_of_a_character_decodes_to_raw_bytes(spark, library):
    ids = library.encode_ordinary("😀😀")
    made = bpe.decoded(spark.createDataFrame([(1, ids[:1]), (2, None)], "doc_id long, ids array<int>"), P.path(FILE), P.PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in made.collect()} == {1: library.decode_bytes(ids[:1]), 2: b""}


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.sampled_from(list("ab'sS1 \n\t\x1c\x85  ,中é")), max_size=40))
def test_any_white_space_in_short_pieces(library, monkeypatch, text):
    monkeypatch.setattr(bpe, "PIECE", 3)
    own = bpe.codec(P.path(FILE), P.PATTERN)
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([" ", "x", "\n", " " * 20_000, "\n" * 10_000, " \n" * 9_000, "é", "'s"]), max_size=6))
def test_long_white_space(library, parts):
    text = "".join(parts)
    assert np.frombuffer(bpe.codec(P.path(FILE), P.PATTERN).encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_white_space_beyond_the_library(library):
    own = bpe.codec(P.path(FILE), P.PATTERN)
    text = "a" + "\n" * 2_000_000 + "b"
    ids = own.encode(text)
    assert own.decode(ids) == text.encode()
