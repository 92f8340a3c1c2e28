"""Metric queries, names resolved in bulk, value search and scenario tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .groups import stored
from .keywords import contained, held
from .vectors import VectorIndex, nearest

#: Days after the end in which conversions of a request may come back.
LATE_DAYS = 90
GRAINS = ("day", "week", "month")


def metric_query(
    fact: DataFrame,
    measures: dict[str, Column],
    ratios: dict[str, tuple[str, str]],
    dimensions: list[str],
    start: str,
    end: str,
    filters: Column | None = None,
    mode: str = "event",
    time: str = "day",
    request: str = "req_day",
) -> DataFrame:
    """Measures summed by dimensions, ratios made of the sums.

    A day, week or month among the dimensions is the time grain and gives a ``date`` column (mode ``event``).  In mode
    ``request`` events are read to LATE_DAYS after the end, kept by request day, and grouped by it.
    """
    grain = next((g for g in GRAINS if g in dimensions), None)
    keys: list[Column] = [F.col(x) for x in dimensions if x not in GRAINS]
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    if mode == "request":
        rows = fact.where(F.col(time).between(s, F.date_add(e, LATE_DAYS)) & F.col(request).between(s, e))
        keys = keys if request in dimensions else [F.col(request), *keys]
    else:
        rows = fact.where(F.col(time).between(s, e))
        keys = [F.date_trunc(grain, time).cast("date").alias("date"), *keys] if grain else keys
    if filters is not None:
        rows = rows.where(filters)
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    return sums.select("*", *[F.round(F.try_divide(F.col(a), F.col(b)), 6).alias(n) for n, (a, b) in ratios.items()])


def truncated(frame: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """The first ``most`` rows, each with the number of rows before the cut."""
    total = frame.agg(F.count("*").alias("total"))
    return frame.orderBy(*order).limit(most).join(F.broadcast(total))


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"""[\s()（）\-_—,，。！？!?:：;'"“”‘’/\\]+""", "")


def resolve_names(values: DataFrame, catalog: DataFrame, value: str = "value") -> DataFrame:
    """A column of free-text names against ``catalog(code, name, alias)``: exact (code or name), alias, then containment.

    Distinct values are resolved once.  Ties go to the smaller code; names that nothing matches have none (``keywords.suggestions``
    ranks what they may mean).  Names meet by equality and, where that fails, by containment found in one pass (``keywords.contained``).
    """
    v = values.select(value).where(F.col(value).isNotNull()).distinct().withColumn("_v", normal(F.col(value)))
    c = catalog.select("code", normal(F.col("name")).alias("_n"), normal(F.col("code")).alias("_c"), normal(F.col("alias")).alias("_a"))
    names = c.select(F.lit(1).alias("how"), "code", F.col("_c").alias("_v")).unionAll(c.select(F.lit(1), "code", "_n")).unionAll(c.where("_a <> ''").select(F.lit(2), "code", "_a"))
    best = F.min(F.struct("how", "code")).alias("m")
    known = v.join(names, "_v").groupBy(value).agg(best)
    rest = v.join(known, value, "left_anti")
    held = contained(rest, c, "_v", "_n").select(F.col("value").alias("_v"), F.col("name").alias("_n"))
    more = rest.join(held, "_v").join(c.select("code", "_n"), "_n").select(value, F.lit(3).alias("how"), "code").groupBy(value).agg(best)
    return v.join(known.unionAll(more), value, "left").select(value, F.col("m.code").alias("code"), F.col("m.how").alias("how"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one has no length."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s,，;；/_-]+"), lambda t: t != ""))


def tokens_hit(query: Column, text: Column) -> Column:
    """How many of the query's tokens contain, or are in, some token of the text (both arrays)."""
    return F.size(F.filter(query, lambda x: F.exists(text, lambda y: y.contains(x) | x.contains(y))))


def token_share(query: Column, text: Column) -> Column:
    """Share of the query's tokens that contain, or are in, some token of the text."""
    q, t = tokens(query), tokens(text)
    return F.when((F.size(q) > 0) & (F.size(t) > 0), tokens_hit(q, t) / F.size(q)).otherwise(0.0)


def lexical_search(queries: DataFrame, catalog: DataFrame, top: int = 5) -> DataFrame:
    """``(query_id, value, similarity, rank)``: the ``top`` rows of ``catalog(value, value_desc)`` by token share, exactly.

    Queries with the same tokens are searched once, and of catalog rows with the same tokens only the ``top`` smallest values go on
    (the others can't be told from them).  Tokens meet through an index of letter pieces (``keywords.held``), sets through their
    tokens.  A query's rarer half of tokens is looked up first: if ``top`` rows then hit more tokens than the commoner half has, no
    row outside them can be among the best; only other queries look up the rest.  Rows that hit nothing fill short lists in order
    of values.  A null query has no tokens; ties go to the smaller value; repeated catalog rows count as often as they stand.
    """
    own = catalog.select("value", F.array_sort(tokens(F.concat_ws(" ", "value", "value_desc"))).alias("t")).withColumn("s", F.sha2(F.array_join("t", " "), 256))
    few = own.withColumn("_r", F.row_number().over(W.partitionBy("s").orderBy("value"))).where(F.col("_r") <= top)
    sets = stored(few.groupBy("s").agg(F.first("t").alias("t"), F.sort_array(F.collect_list(F.struct("value"))).alias("rows")), "value-sets")
    asked = queries.select("query_id", F.array_sort(tokens(F.col("query"))).alias("q")).withColumn("k", F.sha2(F.array_join("q", " "), 256))
    wanted = stored(asked.groupBy("k").agg(F.first("q").alias("q")), "query-sets")

    x = wanted.select("k", F.explode("q").alias("x"))
    y = sets.select("s", F.explode("t").alias("y"))
    pairs = stored(held(x, y).unionByName(held(y.select(F.col("y").alias("x")), x.select(F.col("x").alias("y"))).select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "token-pairs")
    reach = pairs.join(y.groupBy("y").agg(F.count("*").alias("n")), "y").groupBy("x").agg(F.sum("n").alias("n"))
    by = W.partitionBy("k")
    ranked = x.join(reach, "x").withColumn("place", F.row_number().over(by.orderBy("n", "x"))).withColumn("m", F.count("*").over(by))
    ranked = stored(ranked.select("k", "x", (F.col("place") <= F.ceil(F.col("m") / 2)).alias("rare"), F.floor(F.col("m") / 2).alias("rest")), "query-tokens")

    def met(tokens_of: DataFrame) -> DataFrame:
        return tokens_of.select("k", "x").join(pairs, "x").join(y, "y").select("k", "s").distinct()

    def scored(found: DataFrame) -> DataFrame:
        told = found.join(wanted, "k").join(sets, "s").select("k", "s", F.size("q").alias("n"), tokens_hit(F.col("q"), F.col("t")).alias("hit"), "rows")
        return best(told.select("k", "s", "n", "hit", F.explode("rows.value").alias("value")))

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(by.orderBy(F.desc("hit"), "value"))).where(F.col("rank") <= top)

    first = met(ranked.where("rare"))
    early = stored(scored(first), "first-values")
    sure = early.where(F.col("rank") == top).join(ranked.groupBy("k").agg(F.first("rest").alias("rest")), "k").where("hit > rest").select("k")
    late = ranked.where("not rare").join(sure, "k", "left_anti")
    more = scored(met(late).join(first, ["k", "s"], "left_anti"))
    done = stored(best(early.unionByName(more).drop("rank")), "best-values")

    # Rows that hit nothing: of the ``top`` smallest values, so many fetched at most.
    spare = own.select("value", "s").orderBy("value").limit(top).collect()
    short = wanted.join(done.where(F.col("rank") == top).select("k"), "k", "left_anti").select("k", F.size("q").alias("n"))
    filled = done
    if spare:
        none = F.array(*[F.struct(F.lit(r["value"]).alias("value"), F.lit(r["s"]).alias("s")) for r in spare])
        rows = short.select("k", "n", F.inline(none)).join(done.select("k", "s").distinct(), ["k", "s"], "left_anti").withColumn("hit", F.lit(0))
        filled = best(done.drop("rank").unionByName(rows))
    share = F.round(F.coalesce(F.try_divide(F.col("hit"), F.col("n")), F.lit(0.0)), 4)
    return asked.select("query_id", "k").join(filled, "k").select("query_id", "value", share.alias("similarity"), "rank")


def value_search(queries: DataFrame, catalog: DataFrame, top: int = 5, fix: float = 0.5, vectors: bool = False) -> DataFrame:
    """The ``top`` catalog values for each row of ``queries(query_id, query[, query_vector])``; ``fixed`` marks a best value sure enough to use.

    Similarity is the token share (``lexical_search``), or 0.7 cosine + 0.3 token share with vectors.  With vectors an inverted file of
    ``catalog(value, value_desc, vector)`` is searched, exactly (``vectors.nearest``).  Ties go to the smaller value.
    """
    if vectors:
        both = cosine(F.col("query_vector"), F.col("vector")) * 0.7 + token_share(F.col("query"), F.concat_ws(" ", "value", "value_desc")) * 0.3
        out = nearest(queries, VectorIndex(catalog), both, top, 0.7, 0.3)
    else:
        out = lexical_search(queries, catalog, top)
    return out.select("query_id", "value", "similarity", "rank", ((F.col("rank") == 1) & (F.col("similarity") >= fix)).alias("fixed"))


def likeness(a: Column, b: Column) -> Column:
    """1 if equal; the ratio of lengths if one holds the other; else one minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    held = a.contains(b) | b.contains(a)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).when(held, F.least(F.length(a), F.length(b)) / longest).otherwise(1 - F.levenshtein(a, b) / longest)


def scenario_tags(texts: DataFrame, scenarios: DataFrame, least: float = 0.45, key: list[str] = ["id"]) -> DataFrame:
    """The best scenario of each text: exact, alias, or likest at ``least`` or more; else none.

    ``scenarios(scenario, names array)`` is a small dictionary (name and aliases) and is broadcast; equal texts are
    compared once.
    """
    t = texts.withColumn("_t", normal(F.col("text")))
    names = scenarios.select("scenario", F.explode("names").alias("n"), F.lit(2).alias("how")).unionAll(scenarios.select("scenario", F.col("scenario"), F.lit(1)))
    n = names.select("scenario", normal(F.col("n")).alias("_n"), "how")
    d = t.select("_t").distinct()
    s = d.join(F.broadcast(n)).withColumn("score", F.round(likeness(F.col("_t"), F.col("_n")), 6)).where(F.col("score") >= least)
    s = s.withColumn("how", F.when(F.col("score") == 1, F.col("how")).otherwise(3))
    best = s.groupBy("_t").agg(F.min(F.struct("how", (-F.col("score")).alias("neg"), "scenario")).alias("m"))
    how = F.when(F.col("m.how") == 1, "exact").when(F.col("m.how") == 2, "alias").when(F.col("m.how") == 3, "fuzzy").otherwise("none")
    return t.join(best, "_t", "left").select(*key, F.col("m.scenario").alias("scenario"), how.alias("match"), (-F.col("m.neg")).alias("score"))
