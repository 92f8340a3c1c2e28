"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, materialize, small_side

#: Rank buckets per source, so that no window orders more than about this many rows.
BUCKET_ROWS = 1_000


def n_words(text: Column) -> Column:
    """Runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A repeatable number in (0, 1) of ``key``: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` for each source.

    Sources in code point order, null last, weigh ``weights``, repeating; they share ``share`` times
    all sizes by weight, and a target stops at ``most`` times its source's size, the excess going to the
    others by weight.  The fixed point is found at once: with sources ordered by size over weight,
    those before the first that can take its share of what is left are full.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    by_room = W.orderBy(F.col("room"), F.col("k"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = (
        sizes.withColumn("k", F.row_number().over(place) - 1)
        .withColumn("weight", F.element_at(w, (F.col("k") % len(weights) + 1).cast("int")))
        .withColumn("room", F.col("source_size") * most / F.col("weight"))
    )
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    rest = by_room.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    water = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "k", "level"))).over(W.partitionBy())["level"]
    return levels.withColumn("water", water).select(
        "source",
        "source_size",
        F.when(F.col("water").isNull() | (F.col("room") < F.col("water")), F.col("source_size") * most).otherwise(F.col("water") * F.col("weight")).alias("target"),
    )


def inclusion_scale(sizes: DataFrame) -> DataFrame:
    """``(source, scale, certain)`` from ``sizes(source, size, n, wanted)``, one row for each source and size.

    A document's inclusion probability is ``scale * size``, and 1 where that is more; ``scale`` makes the expected words
    taken ``wanted``.  ``certain`` are the words of the documents whose probability is 1.  With sizes in falling order,
    those before the first whose probability is then below 1 are certain.
    """
    falling = W.partitionBy("source").orderBy(F.desc("size"))
    words = (F.col("n") * F.col("size")).cast("decimal(38,0)")
    before = F.coalesce(F.sum(words).over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,0)"))
    squares = F.sum(words * F.col("size")).over(falling.rowsBetween(W.currentRow, W.unboundedFollowing))
    scaled = sizes.where("size > 0").withColumn("certain", before.cast("double")).withColumn("scale", (F.col("wanted") - F.col("certain")) / squares.cast("double"))
    fits = scaled.where(F.col("scale") * F.col("size") < 1)
    best = fits.groupBy("source").agg(F.max(F.struct("size", "scale", "certain")).alias("m"))
    return best.select("source", "m.scale", "m.certain")


def mix(
    docs: DataFrame,
    weights: list[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row.

    Every document of a source is due ``target / source_size`` copies: the whole part is certain.  One more copy goes to
    documents with probability proportional to size, so that the expected words are the source's remaining
    ones; where that reaches 1 the copy is certain too.  The others are ranked by Pareto's statistic, their random odds over
    their own inclusion odds, and are taken from the smallest on until the words
    taken come nearest to what remains.  Ranks of a source (as x / (1 + x), which are spread over 0 to 1) are
    cut in buckets of about BUCKET_ROWS rows: whole buckets before
    the boundary are in, whole buckets after it out, and only the boundary bucket is ordered.

    The random numbers are digests of the id, so reruns agree; rows with equal ids are ordered by size.
    A null source is a source; null and empty texts have size 0 and nothing taken.  Other columns are ignored.
    """
    sized = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes"
    )
    # One row for each source: that is the list of sources the weights are for.
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = materialize(
        source_targets(sources.select("source", "source_size"), list(weights), share, most)
        .join(sources.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s")))
        .select(
            "source",
            "source_size",
            "target",
            F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).alias("whole"),
            F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("due"),
            F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"),
        )
        .withColumn("part", F.col("due") - F.col("whole")),
        "sources",
    )
    named = sources.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "s")
    by_size = sized.groupBy("source", "size").agg(F.count("*").alias("n")).join(F.broadcast(named.where("part > 0").select("s", "wanted")), F.col("source").eqNullSafe(F.col("s")))
    scales = materialize(inclusion_scale(by_size.select("source", "size", "n", "wanted")).withColumnRenamed("source", "z"), "scales")
    named = materialize(named.join(scales, F.col("s").eqNullSafe(F.col("z")), "left").drop("z"), "named")
    u, p = uniform(F.col("id"), seed), F.col("scale") * F.col("size")
    ranked = (
        sized.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("s")))  # a row for each source
        .withColumn("sure", F.coalesce(p >= 1, F.lit(False)))
        .withColumn("whole", F.col("whole") + F.col("sure").cast("int"))
        .withColumn("rank", F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p))))
        .withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("buckets")))
        .select("id", "source", "size", "source_size", "target", "whole", "bucket", "rank", (F.col("wanted") - F.col("certain")).alias("rest"))
    )
    ranked = materialize(ranked, "ranked")
    sums = ranked.where("rank is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    # Running sums over blocks of buckets, then within each.
    sums = sums.withColumn("block", F.floor(F.col("bucket") / 1000))
    blocks = sums.groupBy(F.col("source").alias("s"), F.col("block").alias("k")).agg(F.sum("words").alias("words"))
    blocks = blocks.select("s", "k", F.coalesce(F.sum("words").over(W.partitionBy("s").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("words").over(W.partitionBy("source", "block").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("within", within).join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    cut = cut.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "words", (F.col("rest") - F.col("earlier") - F.col("within")).alias("left"))
    return _take(ranked, cut, id_col)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies_col: str = "copies", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with how often; see ``mix``.

    Rows that repeat an id share a decision (the most copies any of them gets); texts without
    words are left out.  A column named like ``copies_col`` is replaced.
    """
    docs = docs.drop(copies_col)
    taken = mix(docs, id_col=id_col, text_col=text_col, **options).where("taken > 0")
    name = free_name(docs, "_taken")
    copies = materialize(taken.groupBy(F.col(id_col).alias(name)).agg(F.max((F.col("taken") / F.col("size")).cast("long")).alias(copies_col)), "copies")
    # A text has words if anything but white space is left of it.
    return docs.join(small_side(copies), docs[id_col].eqNullSafe(F.col(name))).where(F.trim(F.translate(text_col, "\t\n\x0b\x0c\r", "     ")) != "").drop(name)


def _take(ranked: DataFrame, cut: DataFrame, id_col: str) -> DataFrame:
    """Whole buckets are in if their words still fit; the bucket at the boundary is ordered by rank."""
    out = ["id", "size", "source_size", "target", "taken"]
    met = ranked.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    edge = (F.col("left") > 0) & (F.col("left") < F.col("words"))
    sure = met.where(~F.coalesce(edge, F.lit(False))).withColumn(
        "taken", F.col("size") * (F.col("whole") + F.when(F.col("left") >= F.col("words"), 1).otherwise(0))
    )
    order = W.partitionBy("source", "bucket").orderBy("rank", "id", "size")
    upto = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    # A document is in if the words with it are no farther from the target than without it.
    some = met.where(edge).withColumn("upto", upto).withColumn("taken", F.col("size") * (F.col("whole") + F.when(F.col("upto") - F.col("size") / 2 <= F.col("left"), 1).otherwise(0)))
    both = sure.select(*out).unionAll(some.select(*out))
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


#: The mix as one DuckDB query over a table ``docs`` of (doc_id, text, source).
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         ROW_NUMBER() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS k FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST([3, 1, 2][CAST(k % 3 + 1 AS INT)] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE / CAST([3, 1, 2][CAST(k % 3 + 1 AS INT)] AS DOUBLE) AS room FROM sources
), levels AS (
  SELECT *, ((SELECT SUM(source_size) FROM sources) * 1.5::DOUBLE - COALESCE(SUM(source_size) OVER (ORDER BY room, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
            / SUM(weight) OVER (ORDER BY room, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), water AS (
  SELECT arg_min(level, (room, k)) AS water FROM levels WHERE level <= room
), targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR room < water THEN source_size * 2.0::DOUBLE ELSE water * weight END AS target FROM levels, water
), due AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole,
         CASE WHEN source_size = 0 THEN 0 ELSE target / source_size - floor(target / source_size) END AS part FROM targets
), hist AS (
  SELECT d.source, s.size, COUNT(*) AS n, any_value(d.target - d.whole * d.source_size) AS wanted
  FROM sized s JOIN due d ON s.source IS NOT DISTINCT FROM d.source WHERE d.part > 0 AND s.size > 0 GROUP BY 1, 2
), scaled AS (
  SELECT source, size, wanted,
         CAST(COALESCE(SUM(CAST(n AS HUGEINT) * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS certain,
         CAST(SUM(CAST(n AS HUGEINT) * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS squares FROM hist
), scale AS (
  SELECT source, arg_max((wanted - certain) / squares, size) AS scale, arg_max(certain, size) AS certain FROM scaled WHERE (wanted - certain) / squares * size < 1 GROUP BY 1
), drawn AS (
  SELECT s.doc_id, s.size, d.*, COALESCE(c.scale * s.size, 0) AS p, target - whole * source_size - c.certain AS rest,
         (CAST('0x' || substr(md5('mix:' || COALESCE(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN due d ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN scale c ON c.source IS NOT DISTINCT FROM s.source
), ordered AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM drawn
), summed AS (
  SELECT *, SUM(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS FIRST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ordered
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN p >= 1 OR (rank IS NOT NULL AND upto - size / 2.0::DOUBLE <= rest) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
