"""Benchmark decontamination: an FM-index per shard of documents, searched for benchmark phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidy

#: Benchmark words in a block, and blocks searched on one index of a shard.  A word takes 4 bytes in every worker and a distinct
#: one 8 more; a benchmark beyond all blocks (about 100 MB of text) is searched by further passes over the documents.
BLOCK_WORDS, BLOCKS = 4 << 20, 4
#: Starts of windows looked up at a time.
CHUNK = 1 << 18
#: Words of one shard's index at most, but for a longer single document.
SHARD_WORDS = 1 << 20
#: Every so many text positions the index keeps one.
SAMPLE = 8

#: Everything but 0-9, a-z and non-ASCII bytes parts words; A-Z are lower-cased.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    return text.encode().translate(_WORDS).split() if text else []


class Phrases:
    """A block of benchmark items as one array of word numbers; windows are places in it, never rows of their own.

    A word is known by the 64-bit hash that ``hashed`` gave it: for a false hit all words of a window would have to clash at once.
    """

    def __init__(self, ids: list, sizes, hashes, width: int = 10):
        import numpy as np

        self.ids, self.width = ids, width
        self.ends = np.cumsum(sizes)
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        self.codes = codes.astype(np.int32)
        some = np.asarray(sizes)[np.asarray(sizes) > 0]
        self.shortest = int(min(some.min(), width)) if len(some) else 0

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], width: int = 10) -> "Phrases":
        import numpy as np

        split = [words(t) for _, t in items]
        return cls([i for i, _ in items], [len(w) for w in split], hashed([x for w in split for x in w]) if split else np.zeros(0, np.uint64), width)

    def windows(self, dense) -> Iterator[tuple]:
        """``(patterns, lengths, items)`` of the windows whose words all have a number in ``dense``, CHUNK places at a time.

        An item shorter than a window is one window.
        """
        import numpy as np

        n, width = len(self.codes), self.width
        for low in range(0, n, CHUNK):
            at = np.arange(low, min(n, low + CHUNK))
            symbols = dense[self.codes[low : low + CHUNK + width]]
            item = np.searchsorted(self.ends, at, side="right")
            left = self.ends[item] - at
            opens = at == np.where(item > 0, self.ends[item - 1], 0)
            lengths = np.minimum(left, width)
            missing = np.concatenate(([0], np.cumsum(symbols == 0)))
            good = ((left >= width) | opens) & (missing[at - low + lengths] == missing[at - low])
            place, lengths = (at - low)[good], lengths[good]
            if len(place):
                column = np.arange(width)
                patterns = symbols[np.minimum(place[:, None] + column, len(symbols) - 1)]
                yield np.where(column < lengths[:, None], patterns, 0), lengths, item[good]


def hashed(some: list[bytes]):
    """64-bit hashes of words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, some), np.uint64, len(some))


def shard_hits(texts: list[list[bytes]], blocks: list[Phrases]) -> list[tuple[list[tuple[int, int]], set]]:
    """For each document of a shard: merged spans (first word, last word + 1) that windows cover, and the items found.

    Words that no block has part the shard like document ends do: no window holds one.  Stretches between them
    shorter than the shortest window can't hold an occurrence and are left out of the index; all others are indexed, once
    for all blocks.
    """
    import numpy as np

    from .fm_index import FMIndex

    found: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in texts]
    blocks = [b for b in blocks if b.shortest]
    if not blocks:
        return found
    # Numbers from 2 on for the words that shard and blocks share.
    distinct = list(set().union(*texts))
    own = hashed(distinct)
    dense = []
    shared = np.zeros(len(distinct), np.int64)
    for b in blocks:
        at = np.minimum(np.searchsorted(b.vocabulary, own), len(b.vocabulary) - 1)
        dense.append((at, b.vocabulary[at] == own))
        shared |= dense[-1][1]
    number = np.where(shared > 0, np.cumsum(shared) + 1, 0)
    known = {w: k for w, k in zip(distinct, number.tolist()) if k}
    del distinct
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    # One part mark (code 1) behind every document.
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    stream = np.ones(int(first[-1]), np.int32)
    for at, n, t in zip(first.tolist(), sizes.tolist(), texts):
        stream[at : at + n] = np.fromiter(map(known.get, t, repeat(1)), np.int32, n)
    part = np.flatnonzero(stream == 1)
    start = np.concatenate(([0], part[:-1] + 1))
    size = part - start
    keep = size >= min(b.shortest for b in blocks)
    start, size = start[keep], size[keep]
    if not len(start):
        return found
    # Kept stretches with their closing marks, and where each of their symbols was.
    width = size + 1
    begin = np.concatenate(([0], np.cumsum(width)[:-1]))
    origin = np.arange(int(width.sum())) + np.repeat(start - begin, width)
    index = FMIndex(stream[origin], SAMPLE)
    for block, (at, here) in zip(blocks, dense):
        symbol = np.zeros(len(block.vocabulary), np.int32)
        symbol[at[here]] = number[here]
        for patterns, lengths, items in block.windows(symbol):
            low, high = index.search(patterns, lengths)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            count = (high - low)[hit]
            which = np.repeat(hit, count)
            rows = np.arange(int(count.sum())) + np.repeat(low[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            place = origin[index.locate(rows)]
            doc = np.searchsorted(first, place, side="right") - 1
            order = np.lexsort((place, doc))
            end = place + lengths[which]
            for d, i, j, k in zip(doc[order].tolist(), place[order].tolist(), end[order].tolist(), items[which[order]].tolist()):
                spans, those = found[d]
                i, j = i - int(first[d]), j - int(first[d])
                if spans and spans[-1][0] <= i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(j, spans[-1][1]))
                else:
                    spans.append((i, j))
                those.add(block.ids[k])
    return [(_merge(spans, []) if len(spans) > 1 else spans, those) for spans, those in found]


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, j in sorted(a + b):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


#: What a search adds to a row.
_KIND = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def _blocks(bench: DataFrame, id_col: str, text_col: str, width: int) -> Iterator[Phrases]:
    """The benchmark's items in blocks of about BLOCK_WORDS words; words are hashed by tasks, and one block at a time is fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            lists = [hashed(words(t.as_py())).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["i", "h"])

    rows = bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    made = materialize(small_batches(rows).mapInArrow(tidy(run), "i string, h array<long>"), "benchmark")
    n = max(1, -(-(made.agg(F.sum(F.size("h"))).first()[0] or 0) // BLOCK_WORDS))
    for k in range(n):
        block = made.where(F.pmod(F.xxhash64("i", "h"), F.lit(n)) == k).toArrow()
        lists = block["h"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        yield Phrases(block["i"].to_pylist(), pa.compute.list_value_length(lists).to_numpy(), lists.flatten().to_numpy().view("u8"), width)


def benchmark_hits(
    docs: DataFrame,
    bench: DataFrame,
    width: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    out_col: str = "found",
) -> DataFrame:
    """``docs`` with the struct ``out_col``: n_words, merged hit spans in words, and the items found (sorted strings).

    A window is ``width`` consecutive words of an item; an item with fewer words, but any, is one
    window.  Every batch of documents makes shards of bounded size; each is
    indexed and searched where it lies, so documents are never shuffled.  Null texts
    have no words; null items have no windows; an item without an id marks words but isn't listed.
    Repeated items count once, repeated documents each; a column of the name ``out_col`` is replaced.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import from_arrow_type

    docs = small_batches(docs).drop(out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, from_arrow_type(_KIND))])
    return _searched(docs, schema, bench, width, text_col, item_col, item_text_col, out_col, None, schema)


def _searched(docs, schema, bench, width, text_col, item_col, item_text_col, out_col, finish, last) -> DataFrame:
    """``docs`` searched for BLOCKS blocks of phrases at a time; ``finish`` is done to batches of the last search."""
    sc = docs.sparkSession.sparkContext
    blocks = (sc.broadcast(b) for b in _blocks(bench, item_col, item_text_col, width))
    now, n = list(islice(blocks, BLOCKS)), 0
    while now:
        following = list(islice(blocks, BLOCKS))
        run = _searcher(now, text_col, out_col, n == 0)
        docs = docs.mapInArrow(tidy(_then(run, None if following else finish)), schema if following else last)
        now, n = following, n + 1
    return docs


def _then(run, finish):
    return run if finish is None else lambda batches: finish(run(batches))


def _searcher(shared, text_col: str, out_col: str, first: bool):
    """Searches some blocks of phrases; after the first ones, adds to what earlier ones found."""

    def hits(texts) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        phrases = [b.value for b in shared]
        shard: list[list[bytes]] = []
        size = 0
        for t in texts:
            shard.append(words(t.as_py()))
            size += len(shard[-1])
            if size >= SHARD_WORDS:
                yield from ((len(w), *h) for w, h in zip(shard, shard_hits(shard, phrases)))
                shard, size = [], 0
        yield from ((len(w), *h) for w, h in zip(shard, shard_hits(shard, phrases)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            found = [(n, spans, {x for x in items if x is not None}) for n, spans, items in hits(b.column(names.index(text_col)))]
            if not first:
                before = b.column(names.index(out_col)).to_pylist()
                found = [
                    (n, _merge(spans, [(s["first"], s["stop"]) for s in x["spans"]]), items | set(x["items"]))
                    for (n, spans, items), x in zip(found, before)
                ]
            rows = [
                {"n_words": n, "spans": [{"first": i, "stop": j} for i, j in spans], "items": sorted(items)}
                for n, spans, items in found
            ]
            kept = [n for n in names if n != out_col]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in kept), pa.array(rows, _KIND)], names=[*kept, out_col])

    return run


def contamination(docs: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every document; other columns are ignored."""
    found = benchmark_hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), bench, width)
    f = F.col("found")
    n_hit = F.aggregate(f["spans"], F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["first"])
    return found.select(
        F.col("id").alias(id_col),
        f["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the word spans (first word, last word + 1), from the first word's first byte to the last one's end."""
    data = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_WORDS))]
    out, done = [], 0
    for i, j in spans:
        out.append(data[done : at[i][0]])
        done = at[j - 1][1]
    return b"".join([*out, data[done:]]).decode()


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = 10, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; the text loses every span that benchmark windows cover.

    Null texts stay null; texts without a hit stay as they are.
    """
    fields = docs.schema
    found = "found"
    while found in fields.names:
        found += "_"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, f = b.schema.names.index(text_col), b.schema.names.index(found)
            texts = [
                remove_spans(t.as_py(), [(s["first"], s["stop"]) for s in h]) if (h := x.as_py()["spans"]) else t.as_py()
                for t, x in zip(b.column(k), b.column(f))
            ]
            columns = [pa.array(texts, pa.string()) if i == k else c for i, c in enumerate(b.columns) if i != f]
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import from_arrow_type

    schema = T.StructType([*fields.fields, T.StructField(found, from_arrow_type(_KIND))])
    return _searched(small_batches(docs), schema, bench, width, text_col, "item_id", "text", found, cut, fields)
