"""The trie of conversations that begin alike, built shard by shard on vertical bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches, small_side, tidy

#: Turn numbers, positions and depths that are ordered or searched in one place.
BLOCK = 4096
#: The block of turns without a number.
NULL_BLOCK = -(1 << 60)
#: Conversations (bits of a bitmap) and turns of a shard at most; a conversation's turns of one block stay together.
SHARD_CONVS, SHARD_TURNS = 4096, 1 << 16

_NODE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, n_bytes long, first_end long, ends string"


def keyed(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, key, n_bytes)``: a turn is known by 16 bytes of the SHA-256 of its role and text, which go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(sha, 1, 32)).alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def numbered(turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """``keyed`` turns as ``(conv_id, pos, key, n_bytes, size)``: positions from 0 on by turn (null first), then key.

    Rows are numbered within blocks of turn numbers, and numbers go on over a conversation's blocks, so that no
    conversation is ordered in one place (turns of one number or none are).
    """
    none = F.lit(0).cast("long")
    own = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / width), F.lit(NULL_BLOCK)))
    line = W.partitionBy("conv_id").orderBy("block")
    blocks = own.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), none).alias("ahead"),
        F.sum("n").over(W.partitionBy("conv_id")).alias("size"),
    )
    order = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "key")
    return own.join(blocks, ["conv_id", "block"]).select("conv_id", (F.col("ahead") + F.row_number().over(order) - 1).alias("pos"), "key", "n_bytes", "size")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9, width: int = BLOCK) -> DataFrame:
    """``numbered`` turns of conversations that share openings: ``(conv_id, pos, key, n_bytes, size)``.

    Conversation c gets the first h turns of conversation c - c % ``every`` (all if it has fewer, none if there is no such one),
    then its own turns after its first h; h is the CRC-32 of c's decimal digits modulo ``most``.  One that is left
    without turns has a row without a position.
    """
    n = materialize(numbered(keyed(turns), width), "numbered")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    ids = n.where("pos = 0").select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = ids.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    taken = F.least("h", F.coalesce("base_size", F.lit(0).cast("long")))
    ids = ids.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("whole"))
    ids = materialize(ids, "ids")
    opening = n.where((F.col("pos") < most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "pos", "key", "n_bytes")
    shared = ids.where("taken > 0").join(opening, "base").where("pos < taken").select("conv_id", "pos", "key", "n_bytes", F.col("whole").alias("size"))
    own = n.drop("size").join(ids, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "n_bytes", F.col("whole").alias("size"))
    empty = ids.where("whole = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("n_bytes"), F.col("whole").alias("size"))
    return shared.unionAll(own).unionAll(empty)


class Shard:
    """Bitmaps of the conversations of one range of ids, over one block of positions; bit i is the i-th smallest id."""

    def __init__(self, base: int):
        self.base = base  # the block's first position
        self.ids: list[int] = []
        self.turns: list[list[bytes]] = []  # of each conversation, its keys in this block
        self.postings: dict[tuple[int, bytes], list[int]] = {}  # (position, key): bitmap, two hashes, bytes
        self.having: dict[int, int] = {}  # position: bitmap of conversations with a turn there
        self.ended: dict[int, int] = {}  # depth: bitmap of conversations that have so many turns
        self.opened: dict[tuple[int, int], int] = {}  # prefix before the block: bitmap
        self.n_turns = 0

    def add(self, conv: int, pos: int | None, key: bytes, n_bytes: int, size: int, start: tuple[int, int], h1: int, h2: int) -> None:
        if not self.ids or self.ids[-1] != conv:
            self.opened[start] = self.opened.get(start, 0) | 1 << len(self.ids)
            self.ids.append(conv)
            self.turns.append([])
        bit = 1 << len(self.ids) - 1
        self.n_turns += 1
        if pos is None:
            self.ended[0] = self.ended.get(0, 0) | bit
            return
        self.turns[-1].append(key)
        self.postings.setdefault((pos, key), [0, h1, h2, n_bytes])[0] |= bit
        self.having[pos] = self.having.get(pos, 0) | bit
        if pos + 1 == size:
            self.ended[size] = self.ended.get(size, 0) | bit

    def _node(self, bits: int, depth: int, prefix: tuple, parent: tuple, n_bytes: int) -> tuple:
        ends, rest = [], bits & self.ended.get(depth, 0)
        while rest:
            low = rest & -rest
            ends.append(self.ids[low.bit_length() - 1])
            rest ^= low
        first = self.ids[(bits & -bits).bit_length() - 1]
        return depth, *prefix, *parent, first, bits.bit_count(), n_bytes, ends[0] if ends else None, ",".join(map(str, ends)) if ends else None

    def nodes(self) -> Iterator[tuple]:
        """Depth first: a node's members that go on are split by the posting of the smallest one's next turn, again and again."""
        stack = []
        for start, bits in self.opened.items():
            if not self.base:
                yield self._node(bits, 0, start, (None, None), 0)
            stack.append((bits, self.base, start))
        while stack:
            bits, depth, prefix = stack.pop()
            rest = bits & self.having.get(depth, 0)
            while rest:
                i = (rest & -rest).bit_length() - 1
                posting, h1, h2, n_bytes = self.postings[depth, self.turns[i][depth - self.base]]
                child = bits & posting
                rest ^= child
                own = (prefix[0] ^ h1, prefix[1] ^ h2)
                yield self._node(child, depth + 1, own, prefix, n_bytes)
                stack.append((child, depth + 1, own))


def shard_nodes(turns: DataFrame, width: int = BLOCK, shard_convs: int = SHARD_CONVS) -> DataFrame:
    """Nodes of every shard of ``numbered`` turns; equal prefixes of different shards have equal ``(depth, k1, k2)``.

    Shards are ranges of ids within blocks of positions.  A prefix is known by two 64-bit hashes of each of its (position, turn),
    joined by exclusive or; so a later block of long conversations goes on from the prefixes before it, without the blocks between.
    """
    block = F.floor(F.coalesce("pos", F.lit(0)) / width)
    t = turns.select("*", block.alias("block"), F.xxhash64("pos", "key", F.lit(1)).alias("h1"), F.xxhash64("pos", "key", F.lit(2)).alias("h2"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = t.where(F.col("size") > width).groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    starts = starts.select("conv_id", "block", F.bit_xor("x1").over(earlier).alias("s1"), F.bit_xor("x2").over(earlier).alias("s2")).where("s1 is not null")
    t = t.join(small_side(materialize(starts, "starts")), ["conv_id", "block"], "left")
    none = F.lit(0).cast("long")
    rows = t.select("block", "conv_id", "pos", "key", "n_bytes", "size", F.coalesce("s1", none).alias("s1"), F.coalesce("s2", none).alias("s2"), "h1", "h2")
    dealt = rows.repartitionByRange("block", "conv_id").sortWithinPartitions("block", "conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 9 + [pa.string()]
        names = [x.split()[0] for x in _NODE.split(", ")]
        shard, now, last = None, None, None

        def told(some: Shard) -> Iterator[pa.RecordBatch]:
            out = []
            for row in some.nodes():
                out.append(row)
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for b in batches:
            for block, conv, pos, key, n_bytes, size, s1, s2, h1, h2 in zip(*(c.to_pylist() for c in b.columns)):
                full = shard is not None and conv != last and (len(shard.ids) >= shard_convs or shard.n_turns >= SHARD_TURNS)
                if shard is None or block != now or full:
                    if shard is not None:
                        yield from told(shard)
                    shard, now = Shard(block * width), block
                shard.add(conv, pos, key, n_bytes, size, (s1, s2), h1, h2)
                last = conv
        if shard is not None:
            yield from told(shard)

    return small_batches(dealt).mapInArrow(tidy(run), _NODE)


def end_digests(parts: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` of prefixes at which conversations end: a digest of their ids, in order, comma-joined.

    A shard tells its ids of a node as one text; a node's shards are digested in the order of their ids, as a stream.
    """
    rows = parts.where("ends is not null").select("depth", "k1", "k2", "first_end", "ends").repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "first_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], names=["depth", "k1", "k2", "ends_sha256"])

        now, digest, out = None, None, []
        for b in batches:
            for depth, k1, k2, _, ends in zip(*(c.to_pylist() for c in b.columns)):
                if (depth, k1, k2) == now:
                    digest.update(b"," + ends.encode())
                    continue
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (depth, k1, k2), hashlib.sha256(ends.encode())
                if len(out) >= 20_000:
                    yield made(out)
                    out = []
        if now:
            out.append((*now, digest.hexdigest()))
        if out:
            yield made(out)

    return small_batches(rows).mapInArrow(tidy(run), "depth long, k1 long, k2 long, ends_sha256 string")


def chain_totals(chains: DataFrame, values: list[str], max_rounds: int = 64) -> DataFrame:
    """``chains(conv_id, up, ...)``, a forest, with each of ``values`` summed over a row and all rows below it.

    Every round adds what stands at twice the distance: rounds grow with the logarithm of the depth of the forest.
    """
    now = materialize(chains.withColumn("far", F.col("up")), "chains")
    for _ in range(max_rounds):
        rising = now.where("far is not null")
        if not rising.limit(1).count():
            return now.drop("far")
        more = rising.groupBy(F.col("far").alias("conv_id")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        above = now.where("far is not null").select(F.col("conv_id").alias("far"), F.col("far").alias("farther"))
        now = now.join(more, "conv_id", "left").join(above, "far", "left")
        kept = [c for c in now.columns if c not in (*values, *(f"_{v}" for v in values), "far", "farther")]
        summed = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0).cast("long"))).alias(v) for v in values]
        now = materialize(now.select(*kept, *summed, F.col("farther").alias("far")), "chains")
    raise RuntimeError("the forest is too deep or not a forest")


def trie(turns: DataFrame, width: int = BLOCK, shard_convs: int = SHARD_CONVS) -> DataFrame:
    """The nodes of ``numbered`` (or ``rebuilt``) turns; see ``prefix_trie``."""
    parts = materialize(shard_nodes(turns, width, shard_convs), "parts")
    key = ["depth", "k1", "k2"]
    none = F.lit(0).cast("long")
    nodes = parts.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.min("n_bytes").alias("n_bytes"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    nodes = materialize(nodes, "nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    told = (
        nodes.join(below, key, "left")
        .join(end_digests(parts), key, "left")
        .join(above, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id",
            "depth",
            "up",
            "n_convs",
            F.coalesce("n_children", none).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
    told = materialize(told, "told")
    # The nodes whose smallest conversation is c are one chain down to c's end; it hangs on a node of another chain.  So a node
    # is (conversation, depth), and a subtree is the rest of a chain with all chains that hang on it, and on those.
    sums = ["n_leaves", "saved"]
    chains = told.groupBy("conv_id").agg(F.min("depth").alias("opens"), F.min_by(F.when(F.col("up") == F.col("conv_id"), None).otherwise(F.col("up")), "depth").alias("up"), *[F.sum(v).alias(v) for v in sums])
    hung = chain_totals(chains, sums).where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("opens") - 1).alias("depth")).agg(*[F.sum(v).alias(f"_{v}") for v in sums])
    at = told.join(hung, ["conv_id", "depth"], "left").withColumn("block", F.floor(F.col("depth") / width))
    at = at.withColumns({v: F.col(v) + F.coalesce(f"_{v}", none) for v in sums})
    at = materialize(at.drop(*(f"_{v}" for v in sums)), "at")
    later = W.partitionBy("conv_id").orderBy("block").rowsBetween(1, W.unboundedFollowing)
    blocks = at.where(F.col("depth") >= width).groupBy("conv_id", "block").agg(*[F.sum(v).alias(v) for v in sums])
    # A row for a chain's first block, which has what later ones sum up to.
    blocks = blocks.unionAll(blocks.select("conv_id", none.alias("block"), none, none).distinct()).groupBy("conv_id", "block").agg(*[F.sum(v).alias(v) for v in sums])
    blocks = blocks.select("conv_id", "block", *[F.sum(v).over(later).alias(f"_{v}") for v in sums])
    down = W.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    at = at.join(small_side(materialize(blocks, "blocks")), ["conv_id", "block"], "left")
    whole = {v: F.sum(v).over(down) + F.coalesce(f"_{v}", none) for v in sums}
    return at.select(
        "conv_id",
        "depth",
        F.col("up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        whole["n_leaves"].alias("n_leaves"),
        whole["saved"].alias("saved_tokens"),
        "ends_sha256",
    )


def prefix_trie(turns: DataFrame, width: int = BLOCK, shard_convs: int = SHARD_CONVS) -> DataFrame:
    """The trie of ``turns(conv_id, turn, role, text)``: a row for every distinct sequence of first turns of a conversation.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: a node is known by its
    smallest member and its depth (the root, of all conversations, has depth 0 and no parent); ``n_leaves`` and ``saved_tokens``
    are sums over its subtree, itself included: nodes without children, and the members beyond the first times the UTF-8
    bytes of the node's last text (what a cache of prefixes saves).  ``ends_sha256`` is the digest of the ids that end at the node.

    Turns are ordered by turn, nulls first, ties by the digest of role and text; null roles and texts count as empty;
    repeated rows are turns of their own; conversation ids are integers, and a row without one belongs to no conversation; other columns are
    ignored; an empty table gives no node, not even a root.  Two turns are equal when role and text are.  ``width`` and
    ``shard_convs`` bound what one task orders or searches at a time and change no result.
    """
    return trie(numbered(keyed(turns), width), width, shard_convs)


#: The same nodes of the rebuilt conversations, as one DuckDB query.
TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, sha256(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, ''))[:32] AS k, strlen(COALESCE(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT c, k, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM t
), id AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384::UBIGINT * (xor(a, x) & 1))), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM p)
), r AS (
  SELECT c, k, b, row_number() OVER (PARTITION BY c ORDER BY pos) AS d FROM (
    SELECT id.c, pos, k, b FROM id JOIN p ON p.c = id.c - id.c % 5 AND pos < h UNION ALL SELECT id.c, pos, k, b FROM id JOIN p USING (c) WHERE pos >= h)
), m AS (
  SELECT c, d, b, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM r UNION ALL SELECT c, 0, 0, '' FROM id
), n AS (
  SELECT m.node, m.d, MIN(m.c) AS conv_id, COUNT(*) AS n_convs, MAX(b) AS b, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (m.d = last.d) AS ends
  FROM m JOIN (SELECT c, MAX(d) AS d FROM m GROUP BY c) last USING (c) GROUP BY m.node, m.d
), u AS (
  SELECT n.*, up.conv_id AS parent, up.node AS up FROM n LEFT JOIN m ON m.c = n.conv_id AND m.d = n.d - 1 LEFT JOIN n up ON up.node = m.node AND up.d = m.d
), k AS (SELECT up AS node, COUNT(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY up
), x AS (
  SELECT u.*, COALESCE(n_children, 0) AS n_children FROM u LEFT JOIN k USING (node)
), s AS (
  SELECT m.node, m.d, COUNT(*) FILTER (n_children = 0) AS n_leaves, SUM((n_convs - 1) * x.b) AS saved FROM x JOIN m ON m.c = x.conv_id AND m.d <= x.d GROUP BY m.node, m.d
)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(COALESCE(ends, '')) AS ends_sha256
FROM x JOIN s USING (node, d)
"""
