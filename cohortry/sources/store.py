"""A keyed table in a shared folder, changed by batches: hashed buckets, a manifest, and a Bloom filter of each bucket's keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Bits of a filter for each key, bits set for a key, bits in a piece of a filter (what ``bitmap_construct_agg`` makes).
KEY_BITS, HASHES, PIECE = 12, 4, 32_768
#: Versions of a bucket that may lie beside each other before it is written anew.
MOST_VERSIONS = 8

MANIFEST = "n long, batch string, bucket int, versions array<long>, rows long, changed boolean, had_read boolean, rewritten boolean"


@dataclass
class Store:
    """A folder ``root`` of rows known by the columns ``key``, in ``buckets`` hashed buckets; one writer at a time.

    ``data/v=N/bucket=B`` holds what batch number N wrote for a bucket, ``manifest`` which versions make up each bucket.  A batch
    counts from the moment its rows are in the manifest, which one file adds whole: one killed before leaves nothing that readers
    see, and is written over when it comes again; one that comes again after that changes nothing.  Rows with a null in their key are
    a ValueError; of rows of a batch with one key the greatest (by all columns, in order) counts.  Versions no longer named by
    the manifest stay in the folder for readers that began before.
    """

    spark: SparkSession
    root: str
    schema: str
    key: list[str]
    buckets: int = 64

    # ── what is there ──────────────────────────────────────────────────────

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def versions(self) -> dict[int, list[int]]:
        """The versions of each bucket: as many entries as buckets, at most."""
        last = self.manifest().where("changed").groupBy("bucket").agg(F.max_by("versions", "n").alias("versions"))
        return {r["bucket"]: list(r["versions"]) for r in last.collect()}

    def _paths(self, kind: str, versions: dict[int, list[int]], among: set[int] | None = None) -> list[str]:
        return [f"{self.root}/{kind}/v={v}/bucket={b}" for b, vs in sorted(versions.items()) if among is None or b in among for v in vs]

    def _rows(self, versions: dict[int, list[int]], among: set[int] | None = None) -> DataFrame:
        """Rows of the given buckets only, with their bucket."""
        paths = self._paths("data", versions, among)
        schema = f"{self.schema}, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths).select(*self._columns(), "bucket")

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def read(self) -> DataFrame:
        return self._rows(self.versions()).drop("bucket")

    # ── filters ────────────────────────────────────────────────────────────

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _places(self, pieces: Column) -> Column:
        """Places of a key's bits in a filter of so many pieces."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(f"bit {i}"), *self.key), pieces * PIECE) for i in range(HASHES)])

    def _write_filters(self, rows: DataFrame, n: int) -> None:
        sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") * KEY_BITS / PIECE).alias("pieces"))
        bits = rows.join(F.broadcast(sizes), "bucket").select("bucket", "pieces", F.explode(self._places(F.col("pieces"))).alias("p"))
        piece = F.floor(F.col("p") / PIECE)
        made = bits.groupBy("bucket", "pieces", piece.alias("piece")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(PIECE))).alias("bits"))
        made.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/filters/v={n}")

    def _maybe(self, incoming: DataFrame, versions: dict[int, list[int]]) -> DataFrame:
        """``incoming`` with ``maybe``: whether a version of its bucket may hold the key; false is certain."""
        paths = self._paths("filters", versions)
        if not paths:
            return incoming.withColumn("maybe", F.lit(False))
        kept = self.spark.read.schema("pieces long, piece long, bits binary, v long, bucket int").option("basePath", f"{self.root}/filters").parquet(*paths)
        shapes = kept.select("bucket", "v", "pieces").distinct()
        asked = incoming.select(*self.key, "bucket").join(F.broadcast(shapes), "bucket").select(*self.key, "bucket", "v", F.explode(self._places(F.col("pieces"))).alias("p"))
        asked = asked.withColumn("piece", F.floor(F.col("p") / PIECE)).withColumn("at", F.pmod("p", F.lit(PIECE)).cast("int"))
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("at") % 8 + 1)) != 0
        told = asked.join(kept.select("bucket", "v", "piece", "bits"), ["bucket", "v", "piece"], "left").select(*self.key, "v", F.coalesce(bit, F.lit(False)).alias("set"))
        found = told.groupBy(*self.key, "v").agg(F.bool_and("set").alias("all")).where("all").select(*self.key).distinct().withColumn("maybe", F.lit(True))
        return incoming.join(found, self.key, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))

    # ── batches ────────────────────────────────────────────────────────────

    def upsert(self, batch: str, rows: DataFrame) -> dict[str, int]:
        """Rows replace those of their key."""
        return self._apply(batch, rows, lambda new, old: new, True)

    def insert(self, batch: str, rows: DataFrame) -> dict[str, int]:
        """Rows whose key is new are added; others are left out."""
        return self._apply(batch, rows, lambda new, old: new.join(old.select(*self.key), self.key, "left_anti"), False)

    def upsert_changed(self, batch: str, rows: DataFrame, content: str) -> dict[str, int]:
        """As ``upsert``, without rows whose ``content`` hashes to the stored ``content_hash``, which the schema has."""
        told = rows.withColumn("content_hash", X.content_hash(F.col(content)))

        def changed(new: DataFrame, old: DataFrame) -> DataFrame:
            same = old.select(*self.key, F.lit(True).alias("_known"), F.col("content_hash").alias("_old"))
            return new.join(same, self.key, "left").where(F.col("_known").isNull() | ~F.col("_old").eqNullSafe(F.col("content_hash"))).drop("_known", "_old")

        return self._apply(batch, told, changed, True)

    def _apply(self, batch: str, rows: DataFrame, kept: Callable[[DataFrame, DataFrame], DataFrame], replace: bool) -> dict[str, int]:
        """Applies a batch; the counts of buckets it touched, read and rewrote, and of its rows (all 0 if it was applied before)."""
        none = {"touched": 0, "read": 0, "rewritten": 0, "rows": 0}
        if self.manifest().where(F.col("batch") == batch).limit(1).count():
            return none
        n = (self.manifest().agg(F.max("n")).first()[0] or 0) + 1
        columns = self._columns()
        bad = rows.where(" OR ".join(f"`{k}` IS NULL" for k in self.key)).limit(1).count()
        if bad:
            raise ValueError(f"rows with a null in {self.key}")
        versions = self.versions()
        one = rows.select(*columns).groupBy(*self.key).agg(F.max(F.struct(*columns)).alias("r")).select("r.*").withColumn("bucket", self._bucket())
        staged = f"{self.root}/staged/v={n}"
        self._maybe(one, versions).write.mode("overwrite").parquet(staged)
        incoming = self.spark.read.schema(f"{self.schema}, bucket int, maybe boolean").parquet(staged)

        tally = {r["bucket"]: r["hit"] for r in incoming.groupBy("bucket").agg(F.bool_or("maybe").alias("hit")).collect()}
        asked = {b for b, hit in tally.items() if hit}
        old = self._rows(versions, asked)
        sure, unsure = incoming.where("not maybe").drop("maybe"), incoming.where("maybe").drop("maybe")
        new = sure.unionByName(kept(unsure, old.drop("bucket")).select(*columns, "bucket")) if asked else sure

        # A bucket is written anew where rows of it may be replaced, or where it lies in many versions; else rows lie beside.
        full = {b for b in tally if len(versions.get(b, [])) >= MOST_VERSIONS}
        anew = (asked if replace else set()) | full
        out = new
        if anew:
            stay = self._rows(versions, anew)
            out = new.unionByName(stay.join(new.select(*self.key), self.key, "left_anti"))
        out.repartition(min(self.buckets, max(1, len(tally))), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={n}")

        schema = f"{self.schema}, bucket int"
        written = self.spark.read.schema(schema).parquet(f"{self.root}/data/v={n}")
        counts = {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}
        self._write_filters(written, n)
        lines = []
        for b in sorted(tally):
            before = [] if b in anew else versions.get(b, [])
            now = [*before, n] if b in counts else before
            lines.append((n, batch, b, now, counts.get(b, 0), b in counts or b in anew, b in asked, b in anew and bool(versions.get(b))))
        lines = lines or [(n, batch, None, [], 0, False, False, False)]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return {"touched": len(tally), "read": len(asked), "rewritten": sum(x[7] for x in lines), "rows": sum(counts.values())}
