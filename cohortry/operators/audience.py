"""Audience jobs: rule runs, segments, gates, score upkeep, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import TARGET, matches, rule_frame
from . import lift as L


def totals(raw: DataFrame, run_date: Column) -> DataFrame:
    """Per user over all kinds of events but the target: events, kinds, dwell, and kinds of the last 30 days."""
    used = raw.where(F.col("event_type") != TARGET)
    recent = F.to_date("event_time") >= F.date_sub(run_date, 30)
    return used.groupBy("user_id").agg(
        F.count("*").alias("n_events"),
        F.size(F.collect_set("event_type")).alias("n_types"),
        F.sum("dwell").alias("total_dwell"),
        F.size(F.collect_set(F.when(recent, F.col("event_type")))).alias("n_recent_types"),
    )


def behaviour_flags(profile: DataFrame, raw: DataFrame, rules: dict[str, dict], total_rules: dict[str, tuple[str, float]], run_date: Column) -> DataFrame:
    """The profile with one boolean column for each built-in rule."""
    frame = rule_frame(profile, rules, raw=raw, run_date=run_date)
    sums = frame.join(totals(raw, run_date), "user_id", "left")
    return sums.select(*frame.columns, *[F.coalesce(F.col(c) >= n, F.lit(False)).alias(name) for name, (c, n) in total_rules.items()])


def derived_events(flags: DataFrame, names: list[str], raw: DataFrame) -> DataFrame:
    """``(user_id, derived_event_type, event_time)`` of all rules that hold; the time is the user's last event's."""
    last = raw.where(F.col("event_type") != TARGET).groupBy("user_id").agg(F.max("event_time").alias("event_time"))
    return matches(flags, names).withColumnRenamed("rule", "derived_event_type").join(last, "user_id")


def run_rules(flags: DataFrame, names: list[str]) -> DataFrame:
    """``(rule, users, support, rate, tgi)`` of the rules that anybody meets; ``flags`` has ``is_lead``."""
    return L.lift_of_flags(flags, names)


def segments(flags: DataFrame, names: list[str], prefix: str = "seg_") -> DataFrame:
    return matches(flags, names).select("user_id", F.concat(F.lit(prefix), "rule").alias("segment"), F.col("rule").alias("event"))


def gate(rules: DataFrame, stats: DataFrame, least_users: int = 10, known: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Import status of rules ``(name, rule_text)``: rejected (fields missing, too few users), skipped (known), accepted."""
    r = rules.join(stats.select(F.col("rule").alias("name"), "users", "tgi"), "name", "left")
    r = r.join((known if known is not None else rules.limit(0)).select("name", F.lit(True).alias("known")).distinct(), "name", "left")
    status = (
        F.when(F.col("name").isNull() | F.col("rule_text").isNull() | (F.trim("rule_text") == ""), "rejected: missing field")
        .when(F.coalesce("known", F.lit(False)) & F.lit(not force), "skipped: known")
        .when(F.coalesce("users", F.lit(0)) < least_users, "rejected: too few users")
        .otherwise("accepted")
    )
    return r.select("name", "users", "tgi", status.alias("status"))


#: Lift from which rules of a kind are published.
PUBLISH = {"behaviour": 100, "need": 120}


def publish(rules: DataFrame, least: dict[str, float] | None = None) -> DataFrame:
    """Draft and validated rules of a kind are published from its lift on, else rejected; others stay."""
    bound = F.lit(None)
    for kind, n in (least or PUBLISH).items():
        bound = F.when(F.col("kind") == kind, F.lit(float(n))).otherwise(bound)
    moved = F.when(F.col("tgi") >= bound, "published").otherwise("rejected")
    return rules.withColumn("status", F.when(F.col("status").isin("draft", "validated"), moved).otherwise(F.col("status")))


def merge_rules(known: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("src", "dst", "type")) -> DataFrame:
    """Confirmed rules across batches: known ones take the new lift, new ones are added."""
    k = known.select(*keys, F.col("tgi").alias("_old"))
    n = new.select(*keys, F.col("tgi").alias("_new"))
    return k.join(n, list(keys), "full").select(
        *keys,
        F.coalesce("_new", "_old").alias("tgi"),
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "kept").otherwise("updated").alias("change"),
    )


def check_candidates(pairs: DataFrame, lifts: DataFrame, causal: DataFrame, nodes: DataFrame, threshold: float = 120) -> DataFrame:
    """Verdict on candidate edges ``(event, segment)``: existing ends, not self-referring, lift, causal check, first of equals."""
    n = nodes.select("name").distinct()
    c = (
        pairs.withColumn("_r", F.row_number().over(W.partitionBy("event", "segment").orderBy("candidate")))
        .join(n.select(F.col("name").alias("event"), F.lit(True).alias("_e")), "event", "left")
        .join(n.select(F.col("name").alias("segment"), F.lit(True).alias("_s")), "segment", "left")
        .join(lifts.select("segment", "event", "tgi"), ["segment", "event"], "left")
        .join(causal.select("segment", "event", "verdict"), ["segment", "event"], "left")
    )
    reason = (
        F.when(F.col("_e").isNull() | F.col("_s").isNull(), "unknown end")
        .when(F.col("segment") == F.concat(F.lit("seg_"), F.col("event")), "self-referring")
        .when(F.coalesce("tgi", F.lit(0.0)) < threshold, "low lift")
        .when(F.col("_r") > 1, "duplicate")
        .when(F.col("verdict") != "causal", F.concat(F.lit("warning: "), F.col("verdict")))
        .otherwise("confirmed")
    )
    return c.select("candidate", "event", "segment", "tgi", reason.alias("reason"))


def edge_conformity(edges: DataFrame, nodes: DataFrame, legal: DataFrame) -> DataFrame:
    """Edges with ``status``: ok, unknown type, unknown end, or illegal ends, by the whitelist ``legal(type, src_type, dst_type)``."""
    s = nodes.select(F.col("name").alias("src"), F.col("type").alias("src_type"))
    d = nodes.select(F.col("name").alias("dst"), F.col("type").alias("dst_type"))
    known = legal.select("type", F.lit(True).alias("_t")).distinct()
    ok = legal.withColumn("_ok", F.lit(True))
    j = edges.join(s, "src", "left").join(d, "dst", "left").join(F.broadcast(known), "type", "left").join(F.broadcast(ok), ["type", "src_type", "dst_type"], "left")
    status = (
        F.when(F.col("_t").isNull(), "unknown type")
        .when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "unknown end")
        .when(F.col("_ok").isNull(), "illegal ends")
        .otherwise("ok")
    )
    return j.select("src", "dst", "type", status.alias("status"))


def audience_chains(triggers: DataFrame, satisfies: DataFrame, events: DataFrame, profile: DataFrame, scores: DataFrame) -> DataFrame:
    """Item <- need <- event <- users: users, rate, lift, and users for whom the need is dominant."""
    base = profile.agg(F.avg("is_lead").alias("base"))
    stats = events.select("user_id", "event").distinct().join(profile.select("user_id", "is_lead"), "user_id").groupBy("event").agg(F.count("*").alias("users"), F.avg("is_lead").alias("rate"))
    dom = scores.where("dominant_flag = 1").groupBy(F.col("need_name").alias("need")).agg(F.count("*").alias("dominant_users"))
    return (
        satisfies.join(triggers, "need")
        .join(stats, "event")
        .join(dom, "need", "left")
        .join(F.broadcast(base))
        .select("item", "need", "event", "users", F.round("rate", 6).alias("rate"), F.round(L.tgi(F.col("rate"), F.col("base")), 4).alias("tgi"), F.coalesce("dominant_users", F.lit(0)).alias("dominant_users"))
    )


def leaf_classes(facts: DataFrame, hierarchy: DataFrame, by: str = "user_id", cls: str = "need") -> DataFrame:
    """Rows whose class isn't implied by a more special class of the same user; ``hierarchy(sub, super)``."""
    implied = facts.join(hierarchy, facts[cls] == hierarchy["sub"]).select(F.col(by), F.col("super").alias(cls)).distinct()
    return facts.join(implied, [by, cls], "left_anti")
