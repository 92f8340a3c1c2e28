"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy
from .tokens import by_bytes

#: Longer texts are encoded in pieces of about so many characters.
PIECE = 1 << 14
#: White space as the library's own patterns know it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space runs from this length on are cut out of a text before its pattern is applied.
LONG_WHITE = 10_000

_safe = re.compile(r" (?=\S)").search
_long_white = re.compile(f"[{WHITE}]{{{LONG_WHITE},}}")

_codecs: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """Encodes whole texts to ids and ids to raw bytes, with one file of ranks and one pattern that splits text.

    Long texts are cut where a match of the pattern always ends: before a space that a character other than white
    space follows (the pattern lets a match start with such a space and lets no match run over it).  Each match
    is encoded separately, so the ids of a text are those of its pieces in a row.

    The pattern must be of that kind: an optional space opens words, numbers and signs, and white space is
    matched last.  The pattern's look-ahead fails inside the library (its stack ends) on white space of about a
    million characters, so runs from LONG_WHITE on are encoded without it, as the one match that they are.
    """

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def pieces(text: str) -> Iterator[str]:
        """``text`` cut at safe places; joined, the pieces give ``text`` again."""
        at = 0
        while len(text) - at > PIECE and (m := _safe(text, at + PIECE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _ids(self, piece: str) -> list[int]:
        encode, out, at = self.library.encode_ordinary, [], 0
        if len(piece) >= LONG_WHITE:
            for m in _long_white.finditer(piece):
                # The last white character belongs to what follows, if anything does.
                stop = m.end() if m.end() == len(piece) else m.end() - 1
                out += encode(piece[at : m.start()])
                out += self.library._encode_single_piece(piece[m.start() : stop])
                at = stop
        return out + encode(piece[at:])

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers; null counts as empty."""
        return b"".join(np.array(self._ids(p), "<u4").tobytes() for p in self.pieces(text or ""))

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes that ``ids`` stand for; they need not be UTF-8 (an id may hold part of a character)."""
        return self.library.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for ``path``; loaded once a process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)`` for every row, ``ids`` being an array of the text's token ids; no shuffle.

    Special tokens aren't known, so their strings are ordinary text.  Null and empty texts have no tokens; rows with a
    null or repeated id are encoded like any other; other columns are ignored.  ``ranks_path`` is read on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks_path, pattern).encode
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in by_bytes(texts):
                ids = [encode(t) for t in texts[i:j]]
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(ends), pa.int64()), lists], names=[id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids array<int>")


def decoded(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)``: the raw bytes of every row's ``ids``; null ids give no bytes.  No shuffle.

    An id that the rank file lacks is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(ranks_path, pattern).decode
        for b in batches:
            raw = [decode(np.asarray(x.values, "<u4").tobytes()) if x.is_valid else b"" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return small_batches(tokens).select(id_col, ids_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` for every row: digests of the ids and of what they decode to.

    Rows and texts are taken as in ``encoded``.  Both ways are one pass, for ids needn't leave the worker to be digested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for b in batches:
            ids = (own.encode(t.as_py()) for t in b.column(1))
            rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(own.decode(x)).hexdigest()) for x in ids]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def broken_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` of the rows that don't decode to their own text: none, unless the rank file lacks single bytes."""
    made = round_trip(docs.select(F.struct(id_col, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("own")).alias("row"), text_col), ranks_path, pattern, "row", text_col)
    return made.where("row.own <> decoded_sha256").select(F.col("row")[id_col].alias(id_col))
