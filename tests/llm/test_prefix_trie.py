"""The trie against one made of plain dictionaries."""

import hashlib
import random
import zlib

import duckdb
import pytest

from cohortry.llm import prefix_trie, queries


def rebuild(own):
    return {c: own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + said[h:] for c, said in own.items()}


def brute(convs):
    """Rows of all nodes of ``{conversation: turns}``."""
    members = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in children.get(path, [])]
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below[path] = (sum(k[0] for k in kids) if kids else 1, saved + sum(k[1] for k in kids))
    sha = lambda cs: hashlib.sha256(",".join(map(str, cs)).encode()).hexdigest()
    return sorted(
        (m[0], len(path), members[path[:-1]][0] if path else -1, len(m), len(children.get(path, [])), *below[path], sha([c for c in m if len(convs[c]) == len(path)]))
        for path, m in members.items()
    )


def rows(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *tuple(r)[3:]) for r in frame.collect())


def grouped(turns):
    own = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn)):
        own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    return own


def test_whole_table_equals_dictionaries(spark, sf):
    convs = rebuild(grouped(spark.read.parquet(f"{sf}/conversations.parquet").collect()))
    assert rows(queries.op13_prefix_trie(spark, sf)) == brute(convs)


@pytest.mark.parametrize(("width", "shard"), [(4096, 6), (3, 6), (5, 4096)])
def test_random_conversations(spark, width, shard):
    rng = random.Random(width)
    convs = {}
    for c in rng.sample(range(1000), 90):
        convs[c] = [(rng.choice("ua"), rng.choice(["x", "yé"])) for _ in range(rng.randrange(1, 12))]
    for i, c in enumerate(range(2000, 2030)):  # each goes on from the one before: chains hang on chains
        convs[c] = [("u", "grows")] * (i + 1)
    for c in range(3000, 3020):  # copies
        convs[c] = [("u", "grows")] * 5
    made = [(c, None if i == 0 else i, r, x, "extra") for c, said in convs.items() for i, (r, x) in enumerate(said)]
    rng.shuffle(made)
    turns = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, pos string")
    assert rows(prefix_trie.prefix_trie(turns, width, shard)) == brute(convs)
    assert rows(prefix_trie.trie(prefix_trie.rebuilt(turns, width=width), width, shard)) == brute(rebuild(convs))


def test_nulls_ties_and_repeats(spark):
    made = [(1, 0, None, None), (2, 0, "", ""), (2, 1, "a", "b"), (3, 0, "", None), (3, 1, "a", "b"), (3, 1, "a", "b"), (None, 0, "u", "lost"), (4, 5, "ab", ""), (5, None, "a", "b")]
    turns = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    want = brute({1: [("", "")], 2: [("", ""), ("a", "b")], 3: [("", ""), ("a", "b"), ("a", "b")], 4: [("ab", "")], 5: [("a", "b")]})
    assert rows(prefix_trie.prefix_trie(turns)) == want
    # Turns that tie are in one order wherever they stand.
    tied = spark.createDataFrame([(1, 0, "u", "x"), (1, 0, "u", "y"), (2, 0, "u", "y"), (2, 0, "u", "x")], turns.schema)
    assert {(r.depth, r.n_convs) for r in prefix_trie.prefix_trie(tied).collect()} == {(0, 2), (1, 2), (2, 2)}
    assert prefix_trie.prefix_trie(turns.limit(0)).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt(turns.limit(0))).count() == 0


def test_conversation_left_without_turns(spark):
    c = next(c for c in range(6, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    turns = spark.createDataFrame([(c, 0, "u", "gone"), (c, 1, "a", "gone")], "conv_id long, turn long, role string, text string")
    assert rows(prefix_trie.trie(prefix_trie.rebuilt(turns))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_sql_says_the_same(sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = sorted((c, d, -1 if p is None else p, *rest) for c, d, p, *rest in con.execute(prefix_trie.TRIE_SQL).fetchall())
    turns = con.execute("SELECT conv_id, turn, role, text FROM conversations ORDER BY 1, 2").fetchall()
    own = {}
    for c, _, role, text in turns:
        own.setdefault(c, []).append((role, text))
    assert got == brute(rebuild(own))
