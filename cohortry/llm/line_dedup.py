"""Line dedup: two Bloom filters find suspected repeats; only those shuffle, and are confirmed exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, small_batches, tidy

#: Keys shorter than this many code points are never dropped.
MIN_CHARS = 20
#: Hashes are dealt to ranges; a range's filters have a bit for so many bytes of text (lines of 250 bytes: 16 bits a line).
BYTES_PER_BIT = 16
#: Text that a range stands for: as little as makes up RANGES ranges, between these bounds (two filters of 16 MB at most).
RANGES, LEAST_BYTES, MOST_BYTES = 64, 1 << 22, 1 << 30
PROBES = 4
#: Suspected hashes (8 bytes each) and confirmed repeats (24 bytes each) are broadcast up to these numbers, and joined beyond.
BROADCAST_HASHES = 4_000_000
BROADCAST_KEYS = 1_000_000


def keys_of(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of ``text`` and their keys: stripped of ASCII white space, A-Z lower-cased; None where too short."""
    lines = (text or "").encode().split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        if len(line) < min_chars:
            keys.append(None)
            continue
        key = line.strip().lower()
        long = len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode()) >= min_chars)
        keys.append(key if long else None)
    return lines, keys


class BloomPair:
    """Filters of the hashes seen at least once, and at least twice."""

    def __init__(self, bits: int):
        import numpy as np

        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    @staticmethod
    def places(hashes, bits: int):
        import numpy as np

        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]

    @classmethod
    def holds(cls, filter_, hashes):
        """Which hashes the filter (packed bits) may hold."""
        import numpy as np

        out = np.ones(len(hashes), bool)
        for p in cls.places(hashes, len(filter_) * 8):
            out &= ((filter_[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
        return out

    def add(self, hashes, sure: bool = False):
        """Takes distinct ``hashes`` in; gives those seen before that weren't given yet (``sure``: also those new here)."""
        import numpy as np

        again = hashes if sure else hashes[self.holds(self.once, hashes)]
        told = again[~self.holds(self.twice, again)]
        for filter_, new in ((self.twice, told), (self.once, hashes)):
            for p in self.places(new, self.bits):
                np.bitwise_or.at(filter_, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        return told


def _hashes(texts, min_chars: int):
    """A 64-bit hash of every key of a batch, once for each text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    found: list[int] = []
    for t in texts:
        keys = keys_of(t.as_py(), min_chars)[1]
        found += {xxh3_64_intdigest(k) for k in keys if k is not None}
    return np.array(found, np.uint64)


def _suspects(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """The written table ``h`` of hashes of keys that two rows or more hold, and a few others.

    Hashes alone travel, each once from a batch of rows (with those held twice in it apart), to the range of the hash
    space they lie in.  Each range has a pair of filters of its own: a hash that the first holds goes into the
    second, and is told when it wasn't there yet.  The number of ranges grows with the text, their filters don't.
    """
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    ranges = max(1, -(-size // min(MOST_BYTES, max(LEAST_BYTES, size // RANGES))))
    bits = 1 << max(16, (size // ranges // BYTES_PER_BIT).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            one, n = np.unique(_hashes(b.column(0), min_chars), return_counts=True)
            # Ranges are cut from the high bits; filters use others, mixed again.
            of = ((one >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.lexsort((n > 1, of))
            one, of, twice = one[order], of[order], (n > 1)[order]
            cut = np.flatnonzero((of[1:] != of[:-1]) | (twice[1:] != twice[:-1])) + 1
            starts = np.concatenate(([0], cut)).astype(np.int64)[: len(one)]
            parts = np.split(one, cut) if len(one) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[starts].astype(np.int32), pa.int32()), pa.array(twice[starts], pa.bool_()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["k", "twice", "hashes"],
            )

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pairs: dict[int, BloomPair] = {}  # of a partition's ranges, one after the other
        last = None
        for b in batches:
            for k, twice, packed in zip(*(c.to_pylist() for c in b.columns)):
                if k != last:
                    pairs, last = {k: BloomPair(bits)}, k
                told = pairs[k].add(np.frombuffer(packed, np.uint64), twice)
                if len(told):
                    yield pa.RecordBatch.from_arrays([pa.array(told.view(np.int64), pa.int64())], names=["h"])

    parts = docs.select(text_col).mapInArrow(tidy(deal), "k int, twice boolean, hashes binary")
    owned = parts.repartition(ranges, "k").sortWithinPartitions("k")
    return materialize(owned.mapInArrow(tidy(tell), "h long"), "suspects")


def repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(digest, keep)`` of every key found in at least ``min_docs`` rows; keep is the largest id holding it.

    Each row of ``docs`` is a document.  Rows with a null id count, but name a key only if no other row
    holds it.  ``min_docs`` is 2 at least.  Keys are told apart by 128 bits of their SHA-256.
    """
    kind = docs.schema[id_col].dataType
    suspects = _suspects(docs, text_col, min_chars)
    shared = None
    if suspects.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        import numpy as np

        shared = docs.sparkSession.sparkContext.broadcast(np.sort(suspects.toArrow()["h"].to_numpy()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_64_intdigest

        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = list({k for k in keys_of(t.as_py(), min_chars)[1] if k is not None})
                ids += [i] * len(own)
                keys += own
            h = np.array([xxh3_64_intdigest(k) for k in keys], np.uint64).view(np.int64)
            if shared is not None:
                known = shared.value
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[at] == h) if len(known) else []
                ids, keys, h = [ids[i] for i in hit], [keys[i] for i in hit], h[hit] if len(hit) else h[:0]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(ids, b.column(0).type), pa.array([_digest(k) for k in keys], pa.binary())], names=["h", "id", "digest"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(emit), f"h long, id {kind.simpleString()}, digest binary")
    if shared is None:
        found = found.join(suspects.distinct(), "h", "left_semi")
    return found.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("digest", "keep")


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def _plan(docs: DataFrame, repeats: DataFrame, min_chars: int, id_col: str, text_col: str):
    """``docs`` with what tells a row's lines to drop, and a function giving a row's dropped digests.

    Few repeats are broadcast as sorted arrays.  More are joined to the digests of the rows' lines,
    and each row gets the list of its own.
    """
    import numpy as np

    if repeats.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        rows = repeats.toArrow().sort_by("digest")
        names = rows["digest"].to_pylist()
        high = np.frombuffer(b"".join(d[:8] for d in names), ">u8").astype(np.uint64)
        return docs, docs.sparkSession.sparkContext.broadcast((high, names, rows["keep"].to_pylist())), None
    kind = docs.schema[id_col].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [
                (i, d)
                for i, t in zip(b.column(0).to_pylist(), b.column(1))
                for d in {_digest(k) for k in keys_of(t.as_py(), min_chars)[1] if k is not None}
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in pairs], b.column(0).type), pa.array([d for _, d in pairs], pa.binary())], names=["id", "digest"]
            )

    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(lines), f"id {kind}, digest binary")
    drops = held.join(repeats, "digest").where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("id").agg(F.collect_set("digest").alias("dropped"))
    of, extra = free_name(docs, "_drop_id"), free_name(docs, "_dropped")
    with_drops = docs.join(drops.select(F.col("id").alias(of), F.col("dropped").alias(extra)), docs[id_col].eqNullSafe(F.col(of)), "left").drop(of)
    return with_drops, None, extra


def _kept(text: str | None, row_id, min_chars: int, table, dropped: set | None) -> tuple[int, int, bytes]:
    """Number of lines, number dropped, and the lines that stay."""
    import numpy as np

    lines, keys = keys_of(text, min_chars)
    at = [i for i, k in enumerate(keys) if k is not None]
    if not at:
        return len(lines), 0, b"\n".join(lines)
    digests = [_digest(keys[i]) for i in at]
    if dropped is None:
        high, names, keeps = table
        first = np.searchsorted(high, np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64)).tolist()
        gone = set()
        for i, d, p in zip(at, digests, first):
            while p < len(names) and names[p][:8] == d[:8]:
                if names[p] == d and keeps[p] != row_id:
                    gone.add(i)
                p += 1
    else:
        gone = {i for i, d in zip(at, digests) if d in dropped}
    return len(lines), len(gone), b"\n".join([x for i, x in enumerate(lines) if i not in gone])


def _apply(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str, finish, schema) -> DataFrame:
    repeats = materialize(repeated_lines(small_batches(docs), min_docs, min_chars, id_col, text_col), "lines")
    ready, shared, extra = _plan(docs, repeats, min_chars, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value if shared is not None else None
        for b in batches:
            names = b.schema.names
            drops = [set(x or ()) for x in b.column(names.index(extra)).to_pylist()] if extra else [None] * b.num_rows
            rows = [
                _kept(t.as_py(), i, min_chars, table, d)
                for t, i, d in zip(b.column(names.index(text_col)), b.column(names.index(id_col)).to_pylist(), drops)
            ]
            yield finish(b, rows)

    return ready.mapInArrow(tidy(run), schema)


def line_dedup_report(docs: DataFrame, min_docs: int = 3, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_lines, n_dropped, kept_sha256)`` for every row; see ``line_dedup``."""

    def finish(b: pa.RecordBatch, rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                b.column(b.schema.names.index(id_col)),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
            ],
            names=[id_col, "n_lines", "n_dropped", "kept_sha256"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return _apply(docs.select(id_col, text_col), min_docs, min_chars, id_col, text_col, finish, f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_sha256 string")


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; repeated lines are gone from the texts but in the row with the largest id.

    Texts are split at \\n.  A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of
    at least ``min_chars`` code points found in at least ``min_docs`` rows lose all their lines except in
    the rows with the largest id holding them (in each such row, if an id repeats; in rows with a null id only
    if no other row holds the key).  Null texts stay null and count as one empty line.
    """
    names = docs.columns

    def finish(b: pa.RecordBatch, rows) -> pa.RecordBatch:
        at = b.schema.names.index(text_col)
        texts = [None if not t.is_valid else r[2].decode() for t, r in zip(b.column(at), rows)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else b.column(b.schema.names.index(n)) for n in names], names=names)

    return _apply(docs, min_docs, min_chars, id_col, text_col, finish, docs.schema)
