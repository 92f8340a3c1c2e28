"""Lift, coverage and causal statistics of audiences against a conversion label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lift tiers.
MEAT, POISON = 120, 60
#: Least differences of the causal check: overall, and within the segment.
CAUSAL, CAUSAL_WITHIN = 0.05, 0.03


def baseline(profile: DataFrame, by: str | None = None) -> DataFrame:
    """Users, leads and conversion rate, over all or by split."""
    a = [F.count("*").alias("users"), F.sum("is_lead").alias("leads"), F.round(F.avg("is_lead"), 6).alias("rate")]
    return profile.groupBy(by).agg(*a) if by else profile.agg(*a)


def tgi(rate: Column, base: Column) -> Column:
    """Rate over baseline, times 100; 0 where the baseline is none."""
    return F.when(base > 0, rate / base * 100).otherwise(F.lit(0.0))


def lift(members: DataFrame, profile: DataFrame, by: str = "rule", id_col: str = "user_id") -> DataFrame:
    """``(by, users, support, rate, tgi)`` for every audience in ``members(by, user_id)`` at once.

    Users count once however often they are listed; the baseline is one scalar joined to the result.
    """
    base = profile.agg(F.avg("is_lead").alias("base"), F.count("*").alias("total"))
    stats = members.select(by, id_col).distinct().join(profile.select(id_col, "is_lead"), id_col).groupBy(by).agg(F.count("*").alias("users"), F.avg("is_lead").alias("rate"))
    return stats.join(F.broadcast(base)).select(
        by,
        "users",
        F.round(F.col("users") / F.col("total"), 6).alias("support"),
        F.round("rate", 6).alias("rate"),
        F.round(tgi(F.col("rate"), F.col("base")), 4).alias("tgi"),
    )


def lift_of_flags(flags: DataFrame, names: list[str], over: str | None = None, within: bool = False, label: str = "rule") -> DataFrame:
    """``([over,] label, users, support, rate, tgi)`` of the rules ``names``, boolean columns of ``flags``, that anybody meets.

    ``flags`` has a row for each user, with ``is_lead``: all rules are counted side by side in one aggregation, by ``over`` if
    given, and turned to rows afterwards, so no row of a hit is ever made.  Support and baseline are those of all users,
    or of those of the same ``over`` (``within``).
    """
    told = F.array(*[F.struct(F.lit(n).alias(label), F.count_if(F.col(n)).alias("users"), F.avg(F.when(F.col(n), F.col("is_lead"))).alias("rate")) for n in names])
    sums = [F.count("*").alias("_total"), F.count("is_lead").alias("_n"), F.sum("is_lead").alias("_s"), told.alias("_told")]
    one = flags.groupBy(over).agg(*sums) if over else flags.agg(*sums)
    if over and not within:
        every = W.partitionBy(F.lit(0))  # a row for each value of ``over``
        one = one.withColumns({c: F.sum(c).over(every) for c in ("_total", "_n", "_s")})
    keys = [over] if over else []
    rows = one.select(*keys, "_total", "_n", "_s", F.explode("_told").alias("t")).where("t.users > 0")
    return rows.select(
        *keys,
        F.col("t")[label].alias(label),
        F.col("t.users").alias("users"),
        F.round(F.col("t.users") / F.col("_total"), 6).alias("support"),
        F.round("t.rate", 6).alias("rate"),
        F.round(tgi(F.col("t.rate"), F.try_divide(F.col("_s"), F.col("_n"))), 4).alias("tgi"),
    )


def predicate_lift(profile: DataFrame, predicate: Column, split: str | None = None) -> DataFrame:
    """Hit users, support, rate and lift of a predicate over profile rows; one row, or one for each split."""
    hit = predicate.cast("int")
    a = [
        F.sum(hit).alias("hits"),
        F.round(F.avg(hit), 6).alias("support"),
        F.round(F.avg(F.when(predicate, F.col("is_lead"))), 6).alias("rate"),
        F.round(tgi(F.avg(F.when(predicate, F.col("is_lead"))), F.avg("is_lead")), 4).alias("tgi"),
    ]
    return profile.groupBy(split).agg(*a) if split else profile.agg(*a)


def lift_matrix(segments: DataFrame, events: DataFrame, profile: DataFrame) -> DataFrame:
    """Lift of every (segment, event) pair: the rate of users in both, against all.  Users count once."""
    both = segments.select("user_id", "segment").distinct().join(events.select("user_id", "event").distinct(), "user_id")
    return lift(both.withColumn("pair", F.struct("segment", "event")), profile, "pair").select("pair.segment", "pair.event", "users", "support", "rate", "tgi")


def tier(column: Column) -> Column:
    return F.when(column >= MEAT, "meat").when(column >= POISON, "salt").otherwise("poison")


def causal_check(pairs: DataFrame, events: DataFrame, segments: DataFrame, profile: DataFrame, least: float = CAUSAL, within: float = CAUSAL_WITHIN) -> DataFrame:
    """For every candidate (event, segment): rates with and without the event, overall and in the segment, and a verdict.

    With and without come from totals minus what the event's users hold, so no candidate
    is crossed with all users: one join of events to labels and one of (event, segment) memberships.
    """
    total = profile.agg(F.count("*").alias("n"), F.sum("is_lead").alias("s"))
    ev = events.select("user_id", "event").distinct().join(profile.select("user_id", "is_lead"), "user_id")
    sg = segments.select("user_id", "segment").distinct().join(profile.select("user_id", F.col("is_lead").alias("y")), "user_id")
    with_event = ev.groupBy("event").agg(F.count("*").alias("n1"), F.sum("is_lead").alias("s1"))
    in_segment = sg.groupBy("segment").agg(F.count("*").alias("n2"), F.sum("y").alias("s2"))
    in_both = ev.join(sg.select("user_id", "segment"), "user_id").groupBy("event", "segment").agg(F.count("*").alias("n3"), F.sum("is_lead").alias("s3"))
    j = pairs.join(with_event, "event", "left").join(in_segment, "segment", "left").join(in_both, ["event", "segment"], "left").join(F.broadcast(total))
    j = j.fillna(0, ["n1", "s1", "n2", "s2", "n3", "s3"])

    def rate(s, n):
        return F.when(n > 0, s / n).otherwise(F.lit(0.0))

    c = F.col
    j = j.select(
        "event",
        "segment",
        rate(c("s1"), c("n1")).alias("with_rate"),
        rate(c("s") - c("s1"), c("n") - c("n1")).alias("without_rate"),
        rate(c("s3"), c("n3")).alias("segment_with_rate"),
        rate(c("s2") - c("s3"), c("n2") - c("n3")).alias("segment_without_rate"),
    )
    weak = c("with_rate") - c("without_rate") < least
    gone = (c("segment_with_rate") - c("segment_without_rate") < within) & (c("segment_without_rate") > 0)
    return j.withColumn("verdict", F.when(weak, "weak").when(gone, "confounded").otherwise("causal")).select(
        "event", "segment", *[F.round(x, 6).alias(x) for x in ("with_rate", "without_rate", "segment_with_rate", "segment_without_rate")], "verdict"
    )


def field_distribution(frame: DataFrame, fields: list[str], top: int = 50) -> DataFrame:
    """``(field, value, n, pct)``: the most frequent values of every field, in one pass over the rows."""
    pairs = frame.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")).select("p.*")
    n = pairs.groupBy("field", "value").agg(F.count("*").alias("n"))
    totals = n.groupBy(F.col("field").alias("f")).agg(F.sum("n").alias("total"))  # a row for each field
    # The fixed limit next to the rank lets each partition pass on its most frequent values only.
    ranked = n.withColumn("r", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), F.col("value").asc_nulls_first()))).where(F.col("r") <= top)
    return ranked.join(F.broadcast(totals), F.col("field") == F.col("f")).select("field", "value", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("pct"))


def event_distribution(raw: DataFrame, profile: DataFrame) -> DataFrame:
    """``(event_type, events, share, users, rate, avg_dwell, max_dwell)``; users count once in the rate."""
    n = raw.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.avg("dwell"), 4).alias("avg_dwell"), F.round(F.max("dwell"), 4).alias("max_dwell"))
    u = raw.select("event_type", "user_id").distinct().join(profile.select("user_id", "is_lead"), "user_id").groupBy("event_type").agg(F.count("*").alias("users"), F.round(F.avg("is_lead"), 6).alias("rate"))
    share = F.round(F.col("events") * 100 / F.sum("events").over(W.partitionBy()), 4)
    return n.join(u, "event_type", "left").select("event_type", "events", share.alias("share"), F.coalesce("users", F.lit(0)).alias("users"), "rate", "avg_dwell", "max_dwell")


def stability(train: DataFrame, val: DataFrame, deviation: float = 0.2) -> DataFrame:
    """Rules whose validation lift stays within a share of the training lift: stable, else unstable; missing without one."""
    v = val.select("rule", F.col("tgi").alias("val_tgi"))
    ratio = F.abs(F.col("val_tgi") - F.col("tgi")) / F.col("tgi")
    tag = F.when(F.col("val_tgi").isNull() | (F.col("tgi") <= 0), "missing").when(ratio <= deviation, "stable").otherwise("unstable")
    return train.select("rule", "tgi").join(v, "rule", "left").select("rule", F.col("tgi").alias("train_tgi"), "val_tgi", tag.alias("tag"))


def generalisation(train: DataFrame, val: DataFrame, drift: float = 20, threshold: float = 120) -> DataFrame:
    """STABLE, DRIFT, FAILED (validation lift below the threshold) or INVALID (no users in validation)."""
    v = val.select("rule", F.col("tgi").alias("val_tgi"), F.col("users").alias("val_users"))
    change = F.abs(F.col("val_tgi") - F.col("tgi"))
    verdict = (
        F.when(F.coalesce("val_users", F.lit(0)) == 0, "INVALID")
        .when(F.col("val_tgi") < threshold, "FAILED")
        .when(change <= drift, "STABLE")
        .otherwise("DRIFT")
    )
    return train.select("rule", "tgi").join(v, "rule", "left").select("rule", F.col("tgi").alias("train_tgi"), "val_tgi", F.round(change, 4).alias("change"), verdict.alias("verdict"))


def hash_split(frame: DataFrame, id_col: str, by: str, val_ratio: float = 0.2, seed: str = "split") -> DataFrame:
    """``frame`` with ``split``: by class, the first share of rows in the order of a digest is validation, one at least.

    The order is that of the MD5 of seed and id, so the split repeats.  Rows are counted in 4,096 ranges of the digest:
    ranges before the boundary are validation as a whole, and only the rows of the boundary's own range are ordered.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")).cast("binary"))
    keyed = frame.withColumn("_h", key).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = keyed.groupBy(F.col(by).alias("_c"), F.col("_b").alias("_k")).agg(F.count("*").alias("_n"))
    w = W.partitionBy("_c")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(1), F.floor(F.sum("_n").over(w) * val_ratio)) - before
    marks = counts.withColumn("_left", left)  # at most 4,096 rows for each class
    j = keyed.join(F.broadcast(marks), keyed[by].eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_k")))
    edge = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    sure = j.where(~edge).withColumn("split", F.when(F.col("_left") > 0, "val").otherwise("train"))
    r = F.row_number().over(W.partitionBy("_c", "_b").orderBy("_h", id_col))
    some = j.where(edge).withColumn("split", F.when(r <= F.col("_left"), "val").otherwise("train"))
    return sure.unionByName(some).select(*frame.columns, "split")
