"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_one, linked_groups, materialize, small_batches, text_key, tidy

BITS = 64
#: Postings of at most this many fingerprints are compared pair by pair; longer ones go by midpoints.
PAIRS_UP_TO = 64
#: Shingle hashes whose bits are unpacked at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are counted
    with repeats and hashed by XXH64 (seed 42).  A bit is set where more than half the hashes
    have it.  A text with fewer words than a shingle is one shingle; one without words has 0.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        h = [xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def section_words(hashes, sections: int):
    """``(places, words)`` of a long fingerprint, places of its occupied sections ascending: a set's hashes (uint64) are dealt to sections
    by value, and a section's 64-bit word is the SimHash of those in it.  Without ``sections`` every hash has a section of its own.

    Sets that differ in d hashes have the same words in all but d sections at most, as a hash touches one section.
    """
    import numpy as np

    if not sections:
        own = np.sort(hashes)
        return own, own
    place = (hashes * np.uint64(0xA24BAED4963EE407) >> np.uint64(32)) % np.uint64(sections)
    order = np.argsort(place, kind="stable")
    place, own = place[order], hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    counts = np.diff(starts, append=len(own))
    words = own[starts]
    two = starts[counts == 2]
    words[counts == 2] &= own[two + 1]  # more than half of two bits: both
    # A byte's eight bits stand in the eight bytes of a lane, so that one addition counts them all.
    lanes = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    few = np.flatnonzero((counts > 2) & (counts <= 255))
    for at in range(0, len(few), BLOCK // 255):
        some = few[at : at + BLOCK // 255]
        n = counts[some]
        ends = np.cumsum(n)
        members = own[np.arange(ends[-1]) + np.repeat(starts[some] - ends + n, n)]
        sums = np.add.reduceat(lanes[members.view(np.uint8).reshape(-1, 8)], ends - n, axis=0).view(np.uint8)
        words[some] = np.packbits(sums > (n // 2)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    for k in np.flatnonzero(counts > 255):
        total = np.zeros(BITS, np.int64)
        for i in range(int(starts[k]), int(starts[k] + counts[k]), BLOCK):
            part = own[i : min(i + BLOCK, int(starts[k] + counts[k]))]
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words[k] = np.packbits(2 * total > counts[k], bitorder="little").view(np.uint64)[0]
    return place[starts], words


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row, fp the fingerprint's bits as a signed long.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            signed = [f - (1 << 64) if f >> 63 else f for f in fps]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.int64())], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, fp long")


def _byte(column: str, k: int):
    return F.shiftrightunsigned(F.col(column), 8 * k).bitwiseAND(F.lit(255))


def _postings(distance: int) -> list[tuple[int, ...]]:
    """Byte positions of each compound posting: whatever ``distance`` bytes differ, one posting has none of them.

    The eight positions are dealt into ``distance + 2`` blocks; a posting takes two
    blocks, so ``distance`` broken blocks leave at least one posting whole.
    """
    blocks = [tuple(range(i, 8, distance + 2)) for i in range(distance + 2)]
    return [a + b for a, b in combinations(blocks, 2)]


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Edges ``(a, b)`` whose closure joins all fingerprints that differ in at most ``distance`` bits.

    ``fps`` has one row per fingerprint (``fp``).  Fingerprints ``distance`` bits apart
    agree in at least ``8 - distance`` positional bytes.  The inverted index holds, for
    sets of byte positions, the fingerprints with the same bytes there; sets are dealt so
    that every such pair meets.  For each pair that meets the shared positional bytes are
    tallied, pairs below the guaranteed number are dropped, the rest verified by the bits.
    A pair that meets in several postings counts at the first of them only.

    Postings longer than PAIRS_UP_TO are not paired: two fingerprints within two bits
    have a word within one bit of both, so each fingerprint there names its 65 words within
    one bit and is linked to the least fingerprint that names the same word (at most 65 do).
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2: longer postings go by words within one bit of both")
    sets = _postings(distance)
    entry = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.concat_ws("-", *[_byte("fp", i).cast("string") for i in s]).alias("v"))
            for k, s in enumerate(sets)
        ]
    )
    index = materialize(fps.select("fp", F.explode(entry).alias("e")).select("fp", "e.k", "e.v"), "postings")
    length = index.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = index.join(length, ["k", "v"])
    few = met.where(F.col("n") <= PAIRS_UP_TO).select("k", "v", "fp")
    pairs = few.select("k", "v", F.col("fp").alias("a")).join(few.select("k", "v", F.col("fp").alias("b")), ["k", "v"]).where("a < b")
    same = [(_byte("a", i) == _byte("b", i)) for i in range(8)]

    def agree(positions):
        out = F.lit(True)
        for i in positions:
            out = out & same[i]
        return out

    first = F.lit(None)
    for k, s in reversed(list(enumerate(sets))):
        first = F.when(agree(s), F.lit(k)).otherwise(first)
    tally = sum((c.cast("int") for c in same[1:]), same[0].cast("int"))
    near = (
        pairs.withColumn("shared_bytes", tally)
        .where((F.col("shared_bytes") >= 8 - distance) & (F.col("k") == first))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select("a", "b")
    )
    many = met.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
    bits = F.sequence(F.lit(0), F.lit(63))
    if distance == 2:
        words = F.concat(F.array("fp"), F.transform(bits, lambda i: F.col("fp").bitwiseXOR(_bit(i))))
    elif distance == 1:  # the word where the one differing bit is cleared, with its place
        words = F.transform(bits, lambda i: F.struct(i, F.col("fp").bitwiseAND(F.bitwise_not(_bit(i)))))
    else:
        words = F.array("fp")
    named = many.select("fp", F.explode(words).alias("w"))
    heads = named.groupBy("w").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("w", "b")
    stars = named.join(heads, "w").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return near.unionAll(stars)


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row.

    Texts whose fingerprints differ in at most ``distance`` bits are linked; a component's id
    is the smallest id reached.  Null and empty texts have fingerprint zero and are linked like
    any other.  Rows with a null id belong to their component but never name it (a component of such
    rows alone has a null id); repeated rows all come back; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    groups = linked_groups(links(reps.select("fp"), distance))
    named = reps.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with the smallest id.

    Null ids come last, and repeated rows are cut to one.  Rows are told apart by id and text, so rows
    that share an id (or have none) are judged each in its own component.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    fps = materialize(fingerprints(texts.select(F.struct("id", "key").alias("row"), "text"), shingle, "row", "text"), "fingerprints")
    groups = linked_groups(links(fps.select("fp").distinct(), distance))
    rows = fps.join(groups, F.col("fp") == F.col("node"), "left").select("row.id", "row.key", F.coalesce("root", "fp").alias("root"))
    return keep_one(docs, rows, id_col, text_col)
