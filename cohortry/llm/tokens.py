"""Token counts of whole texts, as a byte-level BPE tokenizer file gives them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import small_batches

#: Distinct pieces whose lengths a Python worker remembers between batches.
CACHE_PIECES = 800_000
#: Pieces longer than this are encoded each time they occur.
CACHE_CHARS = 48
#: UTF-8 bytes handed to the tokenizer at a time.
BATCH_BYTES = 1 << 20

#: A space that white space or nothing follows.
_unsafe = re.compile(r" (?:\s|\Z)").search

_counters: dict[str, "TokenCounter"] = {}


def _n_bytes(text: str) -> int:
    """UTF-8 bytes of ``text``."""
    return len(text) if text.isascii() else len(text.encode())


class TokenCounter:
    """Counts tokens of texts with one tokenizer file; only lengths leave it.

    A text is split where the tokenizer's own pre-tokenizer always splits: before a
    space that a non-space character follows.  No pre-token of a byte-level BPE file
    spans such a place and none looks back across it, so a text's count is the sum
    of its pieces' counts.  Equal pieces are encoded once and their lengths kept.
    A piece that opens with an added token (``<|endoftext|>``) stays joined to the one
    before it, for an added token cuts the white space before it off.
    Tokenizers of another make (a normalizer, added tokens that swallow spaces)
    get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = tuple(t.content for t in added)
        pre = self.tokenizer.pre_tokenizer
        self.splits = (
            self.tokenizer.normalizer is None
            and type(pre).__name__ == "ByteLevel"
            and not pre.add_prefix_space
            and not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added)
        )
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """``text`` cut at safe places; joined, the pieces give ``text`` again."""
        if not self.splits:
            return [text]
        cut = text.split(" ")
        marked = bool(self.added) and any(a in text for a in self.added)
        if not marked and not _unsafe(text):
            return [cut[0], *[" " + w for w in cut[1:]]]
        out = [cut[0]]
        for w in cut[1:]:
            if not w or w[0].isspace() or (marked and w.startswith(self.added)):
                out[-1] += " " + w
            else:
                out.append(" " + w)
        return out

    def encode_lengths(self, pieces: list[str]) -> list[int]:
        lengths: list[int] = []
        batch: list[str] = []
        size = 0
        for p in pieces:
            batch.append(p)
            size += _n_bytes(p) + 16
            if size >= BATCH_BYTES:
                lengths += [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
                batch, size = [], 0
        if batch:
            lengths += [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        return lengths

    def count(self, texts: list[str | None]) -> list[int]:
        """Token counts of ``texts``; null counts as empty."""
        cut = [self.pieces(t) if t else [] for t in texts]
        known = self.known
        missing = list(set().union(*cut).difference(known))
        known.update(zip(missing, self.encode_lengths(missing)))
        counts = [sum(map(known.__getitem__, ps)) for ps in cut]
        full = len(known) > CACHE_PIECES
        for p in missing:
            if full or len(p) > CACHE_CHARS:
                del known[p]
        return counts


def counter(path: str) -> TokenCounter:
    """The worker's counter for ``path``; loaded once a process."""
    if path not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _counters[path] = TokenCounter(path)
    return _counters[path]


def by_bytes(texts: list[str | None], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about equal size in bytes, so that a few long texts don't make one heavy batch."""
    start = size = 0
    for i, t in enumerate(texts):
        size += _n_bytes(t or "") + 32
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row; no shuffle.

    Null and empty texts have 0 bytes and 0 tokens; rows with a null or repeated id
    are counted like any other; other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [x for i, j in by_bytes(texts) for x in count(texts[i:j])]
            size = pa.compute.fill_null(pa.compute.binary_length(b.column(1).cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
