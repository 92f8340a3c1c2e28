"""Need scores per user, and the audience plan under a budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keywords import keyword_hits
from .lift import POISON, tgi, tier

#: Hits that satisfy an action without one of its own; days assumed for an action never seen.
SATURATION, UNSEEN_DAYS = 3, 30


def need_coverage(members: DataFrame, profile: DataFrame) -> DataFrame:
    """``(need_name, users, rate, tgi, tier, specificity)`` of ``members(need_name, user_id)``."""
    base = profile.agg(F.avg("is_lead").alias("base"), F.count("*").alias("total"))
    n = members.select("need_name", "user_id").distinct().join(profile.select("user_id", "is_lead"), "user_id", "left").groupBy("need_name").agg(F.count("*").alias("users"), F.avg("is_lead").alias("rate"))
    lifted = tgi(F.coalesce("rate", F.lit(0.0)), F.col("base"))
    return n.join(F.broadcast(base)).select(
        "need_name", "users", F.coalesce("rate", F.lit(0.0)).alias("rate"), lifted.alias("tgi"), tier(lifted).alias("tier"), F.greatest(F.log(F.col("total") / F.col("users")), F.lit(0.01)).alias("specificity")
    )


def action_hits(events: DataFrame, run_date: Column) -> DataFrame:
    """``(user_id, action, hits, days)`` from derived events: how often, and days since the last."""
    return events.groupBy("user_id", F.col("derived_event_type").alias("action")).agg(
        F.count("*").alias("hits"), F.coalesce(F.greatest(F.datediff(run_date, F.to_date(F.max("event_time"))), F.lit(0)), F.lit(UNSEEN_DAYS)).alias("days")
    )


def softmax(frame: DataFrame, score: str, by: str = "user_id") -> Column:
    """The stable softmax of ``score`` within each user (as a window column over ``frame``'s rows)."""
    w = W.partitionBy(by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)


def rule_scores(members: DataFrame, profile: DataFrame, need_actions: DataFrame, saturation: DataFrame, events: DataFrame, run_date: Column, halflife: float = 7.0) -> DataFrame:
    """Need scores by the rule path: fulfilment x time decay x specificity, softmax per user, dominant flag.

    ``need_actions(need_name, action)``, ``saturation(action, saturation)``.  A need whose lift is below the poison
    bound scores minus its specificity and is flagged; it is never dominant.  Ties go to the smaller name.
    """
    cover = need_coverage(members, profile)
    base = members.select("need_name", "user_id").distinct()
    wanted = need_actions.select("need_name", "action").distinct().join(saturation.select("action", "saturation"), "action", "left")
    asked = (
        base.join(F.broadcast(wanted), "need_name")
        .join(action_hits(events, run_date), ["user_id", "action"], "left")
        .groupBy("user_id", "need_name")
        .agg(
            F.avg(F.least(F.coalesce("hits", F.lit(0)) / F.coalesce("saturation", F.lit(SATURATION)), F.lit(1.0))).alias("fulfillment"),
            F.min(F.coalesce("days", F.lit(UNSEEN_DAYS))).alias("days"),
        )
    )
    out = F.col("tgi") < POISON
    j = base.join(asked, ["user_id", "need_name"], "left").join(F.broadcast(cover), "need_name")
    j = j.withColumn("exclusion_flag", out.cast("int"))
    j = j.withColumn("fulfillment", F.when(out, 0.0).otherwise(F.coalesce("fulfillment", F.lit(1.0))))
    j = j.withColumn("time_decay", F.when(out, 0.0).otherwise(F.exp(F.lit(-math.log(2) / halflife) * F.coalesce("days", F.lit(UNSEEN_DAYS)))))
    j = j.withColumn("raw_score", F.when(out, -F.col("specificity")).otherwise(F.col("fulfillment") * F.col("time_decay") * F.col("specificity")))
    return _scored(j)


def graph_scores(edges: DataFrame, profile: DataFrame, events: DataFrame, run_date: Column, competitiveness: DataFrame | None = None, halflife: float = 7.0) -> DataFrame:
    """Need scores by the graph path over ``edges(event, need_name, weight, tgi)``.

    A need's base weight is its edges' mean lift times max(ln(N / (n + 1)), 0.1), over the largest such; each of a
    user's triggering events adds base x edge weight x decay x competitiveness.
    """
    total = profile.agg(F.count("*").alias("total"))
    hits = action_hits(events, run_date).withColumnRenamed("action", "event")
    touched = edges.select("event", "need_name").join(hits.select("user_id", "event"), "event").groupBy("need_name").agg(F.count_distinct("user_id").alias("n"))
    w = edges.groupBy("need_name").agg(F.avg("tgi").alias("mean_tgi")).join(touched, "need_name", "left").join(F.broadcast(total))
    w = w.withColumn("w", F.col("mean_tgi") * F.greatest(F.log(F.col("total") / (F.coalesce("n", F.lit(0)) + 1)), F.lit(0.1)))
    w = w.withColumn("w_base", F.when(F.max("w").over(W.partitionBy()) > 0, F.col("w") / F.max("w").over(W.partitionBy())).otherwise(0.0)).select("need_name", "w_base")
    c = competitiveness if competitiveness is not None else w.select("need_name", F.lit(1.0).alias("score"))
    part = F.col("w_base") * F.col("weight") * F.exp(F.lit(-math.log(2) / halflife) * F.col("days")) * F.coalesce("score", F.lit(1.0))
    j = (
        hits.join(profile.select("user_id"), "user_id", "left_semi")
        .join(F.broadcast(edges), "event")
        .join(F.broadcast(w), "need_name")
        .join(F.broadcast(c.select("need_name", "score")), "need_name", "left")
        .groupBy("user_id", "need_name")
        .agg(F.sum(part).alias("raw_score"))
    )
    return _scored(j.withColumn("exclusion_flag", F.lit(0)))


def _scored(j: DataFrame) -> DataFrame:
    """Normalised scores and the dominant need; all windows share the user's partition."""
    s = j.withColumn("normalized_score", softmax(j, "raw_score"))
    first = F.row_number().over(W.partitionBy("user_id").orderBy("exclusion_flag", F.desc("raw_score"), "need_name")) == 1
    s = s.withColumn("dominant_flag", (first & (F.col("exclusion_flag") == 0)).cast("int"))
    rounded = {"raw_score": 6, "normalized_score": 6, "fulfillment": 4, "time_decay": 4, "specificity": 4, "tgi": 1}
    keep = [c for c in ("user_id", "need_name", "raw_score", "normalized_score", "dominant_flag", "exclusion_flag", "fulfillment", "time_decay", "specificity", "tgi") if c in s.columns]
    return s.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in keep])


def need_report(scores: DataFrame) -> DataFrame:
    return scores.groupBy("need_name").agg(F.count("*").alias("users"), F.sum("dominant_flag").alias("dominant_users"), F.round(F.avg("normalized_score"), 4).alias("avg_normalized"))


def exclusion_audiences(scores: DataFrame) -> DataFrame:
    return scores.where("exclusion_flag = 1").groupBy("need_name").agg(F.count_distinct("user_id").alias("users"))


def intents(matches: DataFrame, rule_tgi: DataFrame, rule_needs: DataFrame, needs: DataFrame) -> DataFrame:
    """``(user_id, need_name, score)``: sum of need weight x lift / 100 over the rules a user hits.

    Rules that name no need count for the heaviest one.  ``rule_needs(rule, need_name)``, ``needs(need_name, weight)``.
    """
    heaviest = needs.orderBy(F.desc("weight"), "need_name").limit(1).select(F.col("need_name").alias("heaviest"))
    mapped = rule_tgi.select("rule", "tgi").join(rule_needs, "rule", "left").join(F.broadcast(heaviest)).select("rule", "tgi", F.coalesce("need_name", "heaviest").alias("need_name"))
    return matches.select("user_id", "rule").distinct().join(F.broadcast(mapped), "rule").join(F.broadcast(needs), "need_name").groupBy("user_id", "need_name").agg(F.round(F.sum(F.col("weight") * F.col("tgi") / 100), 4).alias("score"))


def top_users(intent: DataFrame, k: int) -> DataFrame:
    """The k users with the highest total (ties by id), each with its total and strongest need."""
    w = W.partitionBy("user_id").orderBy(F.desc("score"), "need_name")
    u = intent.withColumn("r", F.row_number().over(w)).groupBy("user_id").agg(F.round(F.sum("score"), 4).alias("total"), F.max(F.when(F.col("r") == 1, F.col("need_name"))).alias("need_name"))
    return u.orderBy(F.desc("total"), "user_id").limit(k)


def audience_plan(top: DataFrame, needs: DataFrame, budget: float, rate: float, avg_tgi: float, cpm: float = 50.0) -> DataFrame:
    """Groups of the chosen users by strongest need: users, average score, budget by need weight, reach, conversions."""
    g = top.groupBy("need_name").agg(F.count("*").alias("users"), F.round(F.avg("total"), 4).alias("avg_score")).join(F.broadcast(needs), "need_name")
    share = F.col("weight") / F.sum("weight").over(W.partitionBy())
    return g.select(
        "need_name",
        "users",
        "avg_score",
        F.round(F.lit(budget) * share, 2).alias("budget"),
        F.round(F.lit(budget) * share / cpm * 1000, 0).cast("long").alias("reach"),
        F.round(F.col("users") * rate * avg_tgi / 100, 4).alias("conversions"),
    )


def score_percentiles(top: DataFrame, shares: tuple[float, ...] = (0.1, 0.5)) -> DataFrame:
    """``(share, total)``: the value at place int(n x share) of the descending list, by position and not interpolated.

    ``top`` is the bounded list of chosen users, so one ordered window over two columns will do.
    """
    n = top.agg(F.count("*").alias("n"))
    wanted = n.select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.floor(F.col("n") * F.lit(s)).alias("at")) for s in shares])).alias("w")).select("w.*")
    placed = top.select("total", (F.row_number().over(W.orderBy(F.desc("total"), "user_id")) - 1).alias("at"))
    return placed.join(F.broadcast(wanted), "at").select("share", "total")


def placements(groups: DataFrame, rules: DataFrame, cpm: float = 50.0) -> DataFrame:
    """Budget and reach of every (item, need group) by placement: the first rule whose keyword the need contains gives shares.

    ``rules(priority, keyword, shares array<struct<placement, share>>)``; an empty keyword always matches.
    """
    hit = groups.join(F.broadcast(rules), F.col("need_name").contains(F.col("keyword")))
    first = hit.withColumn("r", F.row_number().over(W.partitionBy("item", "need_name").orderBy("priority"))).where("r = 1")
    return first.select("item", "need_name", F.explode("shares").alias("s"), "budget").select(
        "item", "need_name", "s.placement", F.round(F.col("budget") * F.col("s.share"), 2).alias("budget"), F.round(F.col("budget") * F.col("s.share") / cpm * 1000, 0).cast("long").alias("reach")
    )


def creatives(groups: DataFrame, themes: DataFrame, library: DataFrame, k: int = 3) -> DataFrame:
    """The first k creatives of every (item, need group) whose text contains one of the need's themes.

    Themes may be many: every text is read once (``keywords.keyword_hits``).  Each partition passes on the first k of each
    need, and only those are joined to the groups.
    """
    found = keyword_hits(library.select("creative_id", "text"), themes, keyword="theme").select("creative_id", F.explode("hits").alias("theme"))
    hit = found.join(themes.select("need_name", "theme").distinct(), "theme").select("need_name", "creative_id").distinct()
    first = hit.withColumn("place", F.row_number().over(W.partitionBy("need_name").orderBy("creative_id"))).where(F.col("place") <= k)
    return groups.select("item", "need_name").distinct().join(first, "need_name").select("item", "need_name", "creative_id", "place")
