"""Shared helpers: tables in the shared folder, grouping of linked keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session (one process, as in tests) names none a temporary one is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch sent to a Python worker: a worker holds a few copies of one while it works on whole texts.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session sending Arrow batches of at most BATCH_BYTES (one row at least) to Python workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", df.sparkSession.conf.get(key)) or 0) != BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def tidy(run):
    """``run`` (a function of ``mapInArrow``) that gives a worker's freed memory back to the system when its task ends.

    Workers are kept between tasks, several beside each other in an executor; what one task needed
    for its longest texts shall not stay taken while others run.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives lost executors: later stages reread files that
    every executor can reach.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges (about 100 bytes each in a Python worker) that are joined in one task at most; more go by rounds of joins.
FEW_EDGES = 300_000


def _few_groups(edges: DataFrame) -> DataFrame:
    """``linked_groups`` of a written table of at most FEW_EDGES edges ``(u, v)``, in one task."""

    def run(batches):
        import pyarrow as pa

        root: dict = {}

        def top(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        kind = None
        for b in batches:
            kind = b.column(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u, v = top(u), top(v)
                if u != v:
                    root[max(u, v)] = min(u, v)
        if root:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["node", "root"])

    kind = dict(edges.dtypes)["u"]
    return edges.coalesce(1).mapInArrow(tidy(run), f"node {kind}, root {kind}")


def linked_groups(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as rows ``(node, root)``; root is the smallest node.

    At most FEW_EDGES edges are joined in one task.  More: alternates two star-making steps (every node links its larger neighbours, then its
    smaller ones, to the smallest node it sees) until nothing moves; rounds grow with
    the logarithm of the longest path.  A node's neighbours are never gathered: each
    step is a partial ``min`` and a join on the node, which adaptive execution can
    split when a node is hot.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = materialize(both, "edges")
    if current.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return _few_groups(current)
    before = None
    for _ in range(max_rounds):
        # Larger neighbours of every node go to the smallest node in its neighbourhood.
        sides = current.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(
            current.select(F.col("v").alias("n"), F.col("u").alias("m"))
        )
        least = sides.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = (
            sides.join(least, "n")
            .where(F.col("m") > F.col("n"))
            .select(F.col("m").alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        # Every node and its smaller neighbours go to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(lowest, "u")
            .select(
                F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"),
                F.col("low").alias("v"),
            )
            .where("u <> v")
            .distinct()
        )
        current = materialize(small, "edges")
        state = current.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    if before is None or before["n"] == 0:
        return spark.createDataFrame([], f"node {dict(current.dtypes)['u']}, root {dict(current.dtypes)['v']}")
    stars = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


#: Rows of ids (about 16 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``frame`` has no such column (names differ by more than case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few narrow columns, marked for broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id (null is an id) isn't in the one column of ``ids``."""
    name = free_name(docs, "_gone")
    gone = materialize(ids.select(F.col(ids.columns[0]).alias(name)).distinct(), "gone")
    return docs.join(small_side(gone), docs[id_col].eqNullSafe(F.col(name)), "left_anti")


def text_key(text_col: str):
    """A text's MD5, by which rows that share an id are told apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def keep_one(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each group one row of ``docs``: the smallest id (null comes last), then the smallest text key.

    ``rows`` has ``(id, key, root)`` for every row of ``docs``; texts with the same key have the same root.  Rows
    are told apart by id and key, so an id or null that occurs in several groups is judged in each.
    """
    rows = materialize(rows, "rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    best = rows.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best")
    told = rows.join(small_side(materialize(best, "best")), "root").select(
        "id", "key", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))).alias("stays")
    )
    told = materialize(told.groupBy("id", "key", "stays").count(), "told")
    own, gone_id, gone_key = (free_name(docs, n) for n in ("_text_key", "_gone_id", "_gone_key"))
    gone = materialize(told.where("not stays").select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)), "gone")
    keyed = docs.withColumn(own, text_key(text_col))
    kept = keyed.join(small_side(gone), keyed[id_col].eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_key)), "left_anti")
    if told.where("stays and count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, own])
    return kept.drop(own)
