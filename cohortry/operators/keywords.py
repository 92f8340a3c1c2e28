"""Which of many keywords texts contain, in one pass over each text whatever the number of keywords; names suggested by shared letters."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of keywords in one automaton at most (some 50 bytes each in every worker); more go in several.
BLOCK_CHARS = 500_000


def automaton(keywords: list[str]) -> ahocorasick.Automaton:
    """The Aho-Corasick automaton of ``keywords``; it is sent to workers as it is, not built again."""
    out = ahocorasick.Automaton()
    for k in keywords:
        out.add_word(k, k)
    out.make_automaton()
    return out


def _blocks(keywords: DataFrame, column: str) -> Iterator[list[str]]:
    """The distinct keywords in blocks of about BLOCK_CHARS characters, one fetched at a time."""
    words = keywords.select(F.col(column).alias("k")).where(F.col("k") != "").distinct()
    n = max(1, -(-(words.agg(F.sum(F.length("k") + 8)).first()[0] or 0) // BLOCK_CHARS))
    for i in range(n):
        yield words.where(F.pmod(F.xxhash64("k"), F.lit(n)) == i).toArrow()["k"].to_pylist()


def keyword_hits(texts: DataFrame, keywords: DataFrame, text: str = "text", keyword: str = "keyword", out: str = "hits") -> DataFrame:
    """``texts`` with ``out``: the keywords that a row's text contains, each once, in order; texts stay where they are.

    Keywords may overlap and hold each other.  Empty and null keywords are in no text, null texts contain none; repeated rows are
    told apart by nothing and each told; a column of the name ``out`` is replaced.
    """
    frame = texts.drop(out)
    schema = T.StructType([*frame.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    at = frame.columns.index(text)
    done = None
    for words in _blocks(keywords, keyword):
        shared = frame.sparkSession.sparkContext.broadcast(automaton(words) if words else None)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=done is None) -> Iterator[pa.RecordBatch]:
            found = shared.value
            for b in batches:
                rows = [{k for _, k in found.iter(t.as_py())} if found and t.is_valid else set() for t in b.column(at)]
                columns = b.columns
                if not first:
                    rows = [x.union(y.as_py()) for x, y in zip(rows, columns[-1])]
                    columns = columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([sorted(x) for x in rows], pa.list_(pa.string()))], names=[f.name for f in schema.fields])

        done = (frame if done is None else done).mapInArrow(run, schema)
    return done


def contained(values: DataFrame, names: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    """``(value, name)``: the pairs of different non-empty strings of which one contains the other.

    Names in values are found by their automaton, values in names by equality with the names' substrings: ``names`` is a dimension
    of short names, whose substrings are few.
    """
    v = values.select(F.col(value).alias("value")).where(F.col(value) != "").distinct()
    n = names.select(F.col(name).alias("name")).where(F.col(name) != "").distinct()
    held = keyword_hits(v, n, "value", "name").select("value", F.explode("hits").alias("name"))
    size = F.length("name")
    parts = n.select("name", F.explode(F.sequence(F.lit(1), size)).alias("i")).select("name", "i", F.explode(F.sequence(F.lit(1), size - F.col("i") + 1)).alias("k"))
    parts = parts.select("name", F.expr("substring(name, i, k)").alias("value")).distinct()
    return held.unionAll(v.join(parts, "value").select("value", "name")).where("value <> name").distinct()


def suggestions(values: DataFrame, catalog: DataFrame, top: int = 3, q: int = 2, value: str = "value") -> DataFrame:
    """``(value, code, similarity, rank)``: the ``top`` names of ``catalog(code, name)`` likest to each distinct value.

    Similarity is twice the common distinct q-grams over all of both, rounded to four places; ties go to the smaller code; names that share no
    q-gram aren't suggested.  Values and names meet by q-gram, each pair is counted by partial sums, and each partition passes on a
    value's ``top`` names only.  Strings shorter than a q-gram are one.
    """

    def grams(frame: DataFrame, column: str, keys: list[str]) -> DataFrame:
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(column) - q + 1))
        return frame.withColumn("g", F.array_distinct(F.transform(at, lambda i: F.substring(F.col(column), i, F.lit(q))))).withColumn("n", F.size("g")).select(*keys, "n", F.explode("g").alias("g"))

    v = grams(values.select(F.lower(value).alias("_v"), F.col(value).alias("value")).where("_v <> ''").distinct(), "_v", ["value"])
    c = grams(catalog.select("code", F.lower("name").alias("_n")).where("_n <> ''").distinct(), "_n", ["code", "_n"]).withColumnRenamed("n", "m")
    met = v.join(c, "g").groupBy("value", "code", "_n", "n", "m").agg(F.count("*").alias("common"))
    best = met.groupBy("value", "code").agg(F.max(F.round(2 * F.col("common") / (F.col("n") + F.col("m")), 4)).alias("similarity"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("value").orderBy(F.desc("similarity"), "code"))).where(F.col("rank") <= top)


#: Letters of the pieces by which strings meet in ``held``.
GRAM = 3


def _pieces(text: Column, size: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size))))


def held(short: DataFrame, long: DataFrame) -> DataFrame:
    """``(x, y)``: each non-empty string x of ``short(x)`` with each y of ``long(y)`` that contains it, equal ones too.

    An index of pieces of one to GRAM letters of the longer strings is asked for one piece of each shorter one, its rarest there;
    strings that have it are then compared.  Both sides are shuffled by piece, nothing passes the driver.
    """
    x = short.select("x").where("x <> ''").distinct()
    y = long.select("y").where("y <> ''").distinct()
    every = F.array_distinct(F.concat(*[_pieces(F.col("y"), n) for n in range(1, GRAM + 1)]))
    posted = y.select("y", F.explode(every).alias("g"))
    own = F.when(F.length("x") < GRAM, F.array("x")).otherwise(_pieces(F.col("x"), GRAM))
    asked = x.select("x", F.explode(own).alias("g")).join(posted.groupBy("g").agg(F.count("*").alias("n")), "g", "left")
    rarest = asked.groupBy("x").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).where("m.n > 0").select("x", F.col("m.g").alias("g"))
    return rarest.join(posted, "g").where(F.col("y").contains(F.col("x"))).select("x", "y")
