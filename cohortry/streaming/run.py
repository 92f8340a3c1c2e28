"""Running a stream over all files present, with its state and results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only where a local session (one process) names none, in a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read back: computed once, however often it is used."""
    out = shared_folder(frame.sparkSession)
    frame.write.parquet(out)
    return frame.sparkSession.read.schema(frame.schema).parquet(out)


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, progress: list | None = None) -> DataFrame:
    """The result of a stream over what is there now (trigger ``availableNow``).

    Append: all rows written.  Complete: the last result.  Update: every version of each row, in batches.  With
    ``each`` a batch goes through that function, which writes to the folder it is given as attribute.  ``progress`` is filled with
    what Spark tells of the last batches (``late_rows`` reads it).
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append" and each is None:
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:

        def save(batch: DataFrame, number: int) -> None:
            if each is not None:
                each(batch, number)
            elif mode == "complete":
                batch.write.mode("overwrite").parquet(out)
            else:
                batch.write.mode("append").parquet(out)

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(stream.schema).parquet(out) if each is None else spark.read.parquet(out)


def late_rows(progress: list) -> int:
    """Rows that stateful steps dropped for being later than the watermark (groups of rows, where a step aggregates before its shuffle)."""
    return sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])


def newest(stream: DataFrame, key: list[str]) -> DataFrame:
    """The last version of each row of a stream in update mode, rows being known by ``key``; without data, no rows.

    A batch writes only what it changed, to a folder of its own, which a repeated batch replaces; the version of a
    row's latest batch counts.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("update").foreachBatch(save).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    others = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("_row")).select(*key, "_row.*").select(*stream.columns)
