"""Exact dedup by content-defined chunk recipes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, small_side

#: A chunk ends after the first space, from 256 characters on, before six of these letters and digits (about half
#: of all, so in prose one space in some seventy does); where none comes within 4,096 characters, there.
CHUNKS = r"(?s).{255,4095}? (?=[acegikmoqsuwyACEGIKMOQSUWY02468]{6})|.{4096}|.+"


def normalized(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_sha256, chunks)``: each text's chunks as ordered (64-bit hash, SHA-256) pairs.

    Where a text is cut depends on what it says near the cut only, so texts that share long
    stretches share chunks.  This is the one pass over the texts; no text leaves it.
    """
    text = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(CHUNKS), F.lit(0))
    return text.select(
        "id",
        F.sha2("text", 256).alias("text_sha256"),
        F.transform(pieces, lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("sha"))).alias("chunks"),
    )


def chunk_clashes(made: DataFrame) -> DataFrame:
    """``(h, sha, variant)`` of the chunks that share a 64-bit hash with a different chunk.

    Chunks are deduplicated to one row for each (hash, SHA-256); a hash with a single
    SHA-256 is a verified identifier as it stands.  The others (about n^2 / 2^65 of n chunks) get
    a number besides, in the order of their SHA-256.
    """
    chunks = made.select(F.explode("chunks").alias("c")).select("c.h", "c.sha").distinct()
    many = chunks.groupBy("h").agg(F.count("*").alias("n"), F.collect_set("sha").alias("shas")).where("n > 1")
    return many.select("h", F.posexplode(F.array_sort("shas"))).select("h", F.col("col").alias("sha"), F.col("pos").alias("variant"))


def identified(made: DataFrame, clashes: DataFrame) -> DataFrame:
    """``(id, text_sha256, recipe)``: a recipe is the ordered list of verified chunk identifiers."""
    if not clashes.limit(1).count():
        return made.select("id", "text_sha256", F.transform("chunks", lambda c: c["h"]).alias("recipe"), F.array().cast("array<int>").alias("variants"))
    rows = made.withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "rows")
    parts = rows.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", "c.h", "c.sha")
    hit = parts.join(clashes.where("variant > 0"), ["h", "sha"])
    lists = hit.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "variant"))).alias("v"))
    return rows.join(lists, "row", "left").select(
        "id",
        "text_sha256",
        F.transform("chunks", lambda c: c["h"]).alias("recipe"),
        F.coalesce(F.flatten(F.transform("v", lambda x: F.array(x["pos"], x["variant"]))), F.array().cast("array<int>")).alias("variants"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row.

    Texts are equal when identical with each run of ASCII white space as one space; null counts as
    empty.  Long texts move nowhere: chunks are known by verified identifiers and documents are
    grouped by their ordered lists of those.  Of equal texts the row with the smallest id stays; null
    ids come last (a group of such rows alone has a null keep_id and all its rows stay), and
    rows that repeat the smallest id all stay.  Other columns are ignored.
    """
    made = materialize(recipes(docs, id_col, text_col), "recipes")
    rows = identified(made, materialize(chunk_clashes(made), "clashes"))
    groups = rows.groupBy("recipe", "variants").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, ["recipe", "variants"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_groups``.  Rows are told apart by id and text."""
    gone_id, gone_sha = free_name(docs, "_gone_id"), free_name(docs, "_gone_sha")
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias(gone_id), F.col("text_sha256").alias(gone_sha))
    gone = small_side(materialize(gone.distinct(), "gone"))
    sha = F.sha2(normalized(docs[text_col]), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(F.col(gone_id)) & (sha == F.col(gone_sha)), "left_anti")


#: The same groups as one DuckDB query over ``documents``.
EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, MIN(doc_id) OVER (PARTITION BY t) AS keep_id, COUNT(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM MIN(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
