import random

import pytest

from cohortry.llm import tokens
from cohortry.llm.queries import tokenizer_path

ALPHABET = ["a", " ", "  ", "\n", "\t", "<|endoftext|>", " x", "é", "'s", "1", "　", " ", "\x1c", "!", "日本", "<|endof"]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_whole_texts(file):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(file))
    counter = tokens.TokenCounter(tokenizer_path(file))
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["a" * 5000, "ab " * 4000]
    assert counter.count(texts) == [len(e) for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_pieces_join_to_the_text():
    counter = tokens.TokenCounter(tokenizer_path())
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(ALPHABET) for _ in range(20))
        assert "".join(counter.pieces(text)) == text


def test_full_cache_counts_the_same(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    counter = tokens.TokenCounter(tokenizer_path())
    texts = ["one two three four five six", "seven eight nine", "one two three"]
    assert counter.count(texts) == [6, 3, 3] and len(counter.known) <= 6


def test_batches_are_balanced_by_bytes():
    texts = ["x" * 10] * 100 + ["y" * 5000] + [None] * 3
    ranges = list(tokens.by_bytes(texts, 1000))
    assert [i for i, _ in ranges] == [0, *[j for _, j in ranges[:-1]]] and ranges[-1][1] == len(texts)


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "hello world", "x"), (None, None, "y"), (1, "hello world", None), (2, "", "z")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.token_counts(docs, tokenizer_path(), limit=1).collect()), key=str)
    assert got == [(1, 11, 2, True), (1, 11, 2, True), (2, 0, 0, False), (None, 0, 0, False)]
    assert tokens.token_counts(docs.limit(0), tokenizer_path()).count() == 0
