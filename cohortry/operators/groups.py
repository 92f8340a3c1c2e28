"""Groups of linked rows, and rows kept first among rows alike, from tables of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.run import shared_folder

#: Links that one task finishes at most (about 100 bytes each there); more go by rounds of joins.
FEW = 200_000


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _finished(links: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the Python lists of the two columns of ``links``, in one task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, a, b = pa.int64(), [], []
        for x in batches:
            kind = x.column(0).type
            a += x.column(0).to_pylist()
            b += x.column(1).to_pylist()
        columns = run(a, b)
        kinds = [kind if c and not isinstance(c[0], bool) else pa.bool_() for c in columns]
        if columns and columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return links.coalesce(1).mapInArrow(whole, schema)


def _united(a: list, b: list) -> tuple[list, list]:
    root: dict = {}

    def top(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return list(root), [top(x) for x in root]


def components(links: DataFrame, few: int = FEW, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` of every node in ``links(a, b)``: root is the smallest node that links lead to; nulls link nothing.

    Every round contracts: each node points to the smallest node it sees, pointers are followed to their end by doubling,
    and links are renamed to those ends; links inside a supernode go, so fewer are left for the next round.  Neighbours are
    met by partial ``min`` and joins only, never gathered; ``few`` links that are left are finished in one task.
    """
    kind = dict(links.dtypes)["a"]
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    named: DataFrame | None = None
    for _ in range(max_rounds):
        if now.limit(few + 1).count() <= few:
            last = _finished(now, _united, f"node {kind}, root {kind}")
            if named is None:
                return last
            ends = last.select(F.col("node").alias("root"), F.col("root").alias("end"))
            return stored(named.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "groups")
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
        up = stored(up, "up")
        while True:  # pointers fall, so following them ends
            far = up.select(F.col("node").alias("root"), F.col("root").alias("end"))
            moved = up.join(far, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved"))
            moved = stored(moved, "up")
            up = moved.select("node", "root")
            if not moved.where("moved").limit(1).count():
                break
        ends = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        if named is None:
            named = up
        else:
            named = stored(named.join(ends, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "named")
        a = now.join(ends, F.col("a") == F.col("_n")).select(F.col("_r").alias("a"), "b")
        renamed = a.join(ends, F.col("b") == F.col("_n")).select("a", F.col("_r").alias("b")).where("a <> b")
        now = stored(renamed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    raise RuntimeError("groups did not settle")


def _greedy(later: list, earlier: list) -> tuple[list, list]:
    before: dict = {}
    for x, y in zip(later, earlier):
        before.setdefault(x, []).append(y)
        before.setdefault(y, [])
    kept: dict = {}
    for x in sorted(before):
        kept[x] = not any(kept[y] for y in before[x])
    return list(kept), list(kept.values())


def kept_first(links: DataFrame, few: int = FEW, max_rounds: int = 1000) -> DataFrame:
    """``(node, kept)`` of every node in ``links(later, earlier)``: in order, a node is kept unless one before it that is kept is linked to it.

    Greedy, but in rounds: a node whose earlier ones are all settled settles with them, and one that a kept node drops need not
    wait for the others.  The rest is finished in one task once ``few`` links are left.
    """
    kind = dict(links.dtypes)["later"]
    now = stored(links.where("later <> earlier").distinct(), "links")
    nodes = now.select(F.col("later").alias("node")).unionAll(now.select("earlier")).distinct()
    settled: DataFrame | None = None
    for _ in range(max_rounds):
        if now.limit(few + 1).count() <= few:
            last = _finished(now, _greedy, f"node {kind}, kept boolean")
            if settled is None:
                return last
            told = settled.unionAll(last.join(settled, "node", "left_anti"))
            rest = nodes.join(told, "node", "left_anti").select("node", F.lit(True).alias("kept"))
            return stored(told.unionAll(rest), "kept")
        waiting = now.select(F.col("later").alias("node")).distinct()
        free = now.select(F.col("earlier").alias("node")).distinct().join(waiting, "node", "left_anti").select("node", F.lit(True).alias("kept"))
        free = stored(free, "free")
        dropped = now.join(free, F.col("earlier") == F.col("node")).select(F.col("later").alias("node")).distinct().select("node", F.lit(False).alias("kept"))
        dropped = stored(dropped, "dropped")
        settled = stored(free.unionAll(dropped) if settled is None else settled.unionAll(free).unionAll(dropped), "settled")
        gone = dropped.select("node")
        # Links of dropped nodes say nothing more, on either side.
        now = now.join(gone.withColumnRenamed("node", "later"), "later", "left_anti").join(gone.withColumnRenamed("node", "earlier"), "earlier", "left_anti").select("later", "earlier")
        now = stored(now.join(free.select(F.col("node").alias("earlier")), "earlier", "left_anti").select("later", "earlier"), "links")
    raise RuntimeError("the order did not settle")
