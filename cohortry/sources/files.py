"""Readers and writers: labelled users, behaviours, CSV with checks, partitions, triples, rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

USER_SCHEMA = "user_id string, user_tag string, user_events array<struct<res_key:string,event:string,timestamp:string,time_str:string,dur_time:double>>, is_converted int"


def read_users(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Labelled users from JSON lines or one JSON array, with a fixed schema (nothing is inferred)."""
    return spark.read.schema(USER_SCHEMA).option("multiLine", not lines).json(path)


def with_place(rows: DataFrame) -> DataFrame:
    """``rows``, read from files, with ``_place``: file name, block and place in it, which order lines as they stand.

    Row numbers alone don't: files are dealt to tasks by size.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias("_place"))


def labelled_sets(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Both sets with ``is_lead``; of a user's records the first counts, positive before negative.

    Both are frames just read from files, whose order (names of files, then lines) is that of the records.
    """
    both = with_place(positive).withColumn("is_lead", F.lit(1)).unionByName(with_place(negative).withColumn("is_lead", F.lit(0)))
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("is_lead"), "_place"))
    return both.withColumn("_r", r).where("_r = 1").drop("_r", "_place")


def exploded_events(users: DataFrame) -> DataFrame:
    """One row per event of a user; flat and nested layouts share a key column."""
    e = users.select("user_id", F.explode("user_events").alias("e"))
    return e.select("user_id", F.coalesce("e.res_key", "e.event").alias("event_raw"), F.coalesce("e.timestamp", "e.time_str").alias("event_time"), F.col("e.dur_time").alias("dur_time"))


def read_profiles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Profiles from JSON lines or tab-separated text; of equal keys the last line of the last file (by name) counts."""
    rows = with_place(spark.read.json(path) if kind == "json" else spark.read.csv(path, sep="\t", header=True))
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("_place")))).where("_r = 1").drop("_r", "_place")


def load_summary(profiles: DataFrame, behaviours: DataFrame, label: str = "is_converted") -> DataFrame:
    b = behaviours.agg(F.count("*").alias("behaviours"), F.count_distinct("user_id").alias("active_users"))
    return profiles.agg(F.count("*").alias("users"), F.round(F.avg(F.col(label).cast("double")), 6).alias("rate")).join(F.broadcast(b))


def load(spark: SparkSession, mode: str, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Profiles ``(user_id, ..., is_converted)`` and behaviours ``(user_id, event_raw, event_time, dur_time)`` of one of three layouts.

    ``merged`` takes records of users with their events (a missing label is inferred from them), ``split`` profiles and
    flat behaviours (the last line of a user counts), ``labelled`` a positive and a negative set (the first counts).
    """
    if mode == "merged":
        (path,) = paths
        users = read_users(spark, path)
        users = users.withColumn("is_converted", F.coalesce("is_converted", X.converted_from_events(F.col("user_events"))))
    elif mode == "split":
        profiles, behaviours = paths
        flat = spark.read.schema("user_id string, res_key string, event string, timestamp string, time_str string, dur_time double").json(behaviours)
        events = flat.select("user_id", F.coalesce("res_key", "event").alias("event_raw"), F.coalesce("timestamp", "time_str").alias("event_time"), "dur_time")
        return read_profiles(spark, profiles, "json"), events
    elif mode == "labelled":
        positive, negative = paths
        both = labelled_sets(read_users(spark, positive), read_users(spark, negative))
        users = both.withColumn("is_converted", F.col("is_lead")).drop("is_lead")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return users.select("user_id", "user_tag", "is_converted"), exploded_events(users)


def with_views(users: DataFrame, views: DataFrame, columns: list[str], key: str = "user_id") -> DataFrame:
    """``users`` with ``views``, the distinct rows of each in order (none: empty); rows without a user are left out."""
    rows = views.where(F.coalesce(F.trim(F.col(key)), F.lit("")) != "")
    grouped = rows.groupBy(F.trim(F.col(key)).alias(key)).agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("views"))
    out = users.join(grouped, key, "left")
    return out.withColumn("views", F.coalesce("views", F.array().cast(out.schema["views"].dataType)))


def write_tagged(tagged: DataFrame, fixed: list[str], labels: list[str], path: str) -> None:
    """A CSV of users: id, number and lists of needs, ``fixed`` columns (nulls empty), and a 0/1 column for each label."""
    flags = [F.coalesce(F.col(n).cast("int"), F.lit(0)).alias(n) for n in labels]
    write_csv(tagged.select("user_id", F.col("n_needs").alias("need_count"), "needs", F.col("categories").alias("need_categories"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fixed], *flags), path)


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header; missing required columns raise ValueError naming them."""
    frame = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in required if c not in frame.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}; found {frame.columns}")
    return frame


def partition_range(spark: SparkSession, path: str, first: str, last: str, column: str = "pt_d") -> DataFrame:
    """Rows of the day partitions from ``first`` to ``last``; other partitions aren't read."""
    return spark.read.parquet(path).where(F.col(column).cast("string").between(first, last))


def append(frame: DataFrame, path: str, kind: str = "parquet") -> None:
    """Results appended with all input columns."""
    frame.write.mode("append").format(kind).option("header", True).save(path)


def save_table(frame: DataFrame, name: str) -> None:
    frame.write.mode("overwrite").saveAsTable(name)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def triples(frame: DataFrame, key: str, columns: list[str], base: str = "urn:entity:") -> DataFrame:
    """``(s, p, o)`` of every filled value as N-Triples terms; quotes and line ends in literals are escaped."""
    long = frame.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(key, columns, "name", "value").where("value is not null")
    text = F.col("value")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return long.select(
        F.concat(F.lit(f"<{base}"), F.col(key).cast("string"), F.lit(">")).alias("s"),
        F.concat(F.lit(f"<{base}p:"), "name", F.lit(">")).alias("p"),
        F.concat(F.lit('"'), text, F.lit('"')).alias("o"),
    )


def write_triples(frame: DataFrame, path: str) -> None:
    frame.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.mode("overwrite").text(path)


def write_rules(rules: DataFrame, path: str) -> None:
    rules.select("name", "rule", "tgi", "coverage", "lead_rate").write.mode("overwrite").json(path)


#: What a type of the variant schema is called here, by how it begins; others keep their name.
KINDS = {"BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "text", "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}


def field_types(frame: DataFrame, column: str) -> DataFrame:
    """``(field, type, n, merged)`` of the top-level fields of a column of JSON texts: how many values of a field have each type.

    Types are those of VARIANT values: integer, number, text, boolean, null, object, array.  ``merged`` is the one type that all
    of a field's values fit (integers fit number, null fits any), or ``conflict``.  Texts that aren't JSON objects have no fields.
    Counts are partial sums; what is merged are a few rows a field.
    """
    parsed = frame.select(F.try_parse_json(F.col(column)).alias("v"))
    parsed = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    values = parsed.lateralJoin(frame.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z_]+", 0)
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), kind), F.lower(kind))
    n = values.select(F.col("key").alias("field"), named.alias("type")).groupBy("field", "type").agg(F.count("*").alias("n"))
    some = F.array_remove(F.array_sort(F.collect_set("type")), "null")
    merged = n.groupBy("field").agg(some.alias("t")).select(
        F.col("field").alias("_f"),
        F.when(F.size("t") == 0, "null").when(F.size("t") == 1, F.col("t")[0]).when(F.col("t") == F.array(F.lit("integer"), F.lit("number")), "number").otherwise("conflict").alias("merged"),
    )
    return n.join(merged, F.col("field") == F.col("_f")).drop("_f")
