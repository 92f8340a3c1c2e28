"""Training wide tables: bound facts, sample pools, capped details, sequence texts, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Ad event types that are no exposure, click or conversion.
INVALID_AD_EVENTS = (
    "repeatedImp playPause intentSuccess playStart webclose webopen webloadfinish skip downloadstart playEnd installStart impInLandingPage "
    "playResume clickLandingpage repeatedClick intentFail appFirstOpen appOpen browse soundClickOn easterEggEnd downloadResume"
).split()

#: Sums beyond which a user is abnormal, in the order they are tried.
ABNORMAL = (("imp", 10_000, "too many impressions"), ("click", 1_000, "too many clicks"), ("conv", 500, "too many conversions"))


def bind(fact: DataFrame, binding: DataFrame, device: str = "device", account: str = "account") -> DataFrame:
    """Facts of devices with the account each device belongs to; devices without an account are dropped."""
    bound = binding.where(F.col(account).isNotNull()).select(device, account)
    return fact.join(bound, device)


#: Rows of a dimension or list that are broadcast at most; more are joined by a shuffle.
SMALL = 200_000


def small(frame: DataFrame) -> DataFrame:
    """``frame``, marked for broadcast if it has at most SMALL rows."""
    return F.broadcast(frame) if frame.limit(SMALL + 1).count() <= SMALL else frame


def with_dimension(fact: DataFrame, dim: DataFrame, key: str, name: str, on: Column | None = None, out: str | None = None) -> DataFrame:
    """``fact`` with ``name`` of a dimension, or the raw key where the dimension lacks it.

    ``on`` is an extra condition on the fact under which alone the dimension is looked up.
    """
    d = small(dim.select(F.col(key).alias("_key"), F.col(name).alias("_name")))
    match = (fact[key] == F.col("_key")) if on is None else (fact[key] == F.col("_key")) & on
    return fact.join(d, match, "left").withColumn(out or name, F.coalesce("_name", F.col(key).cast("string"))).drop("_key", "_name")


def decoded(column: Column, codes: dict, unknown: str = "unknown") -> Column:
    """A code's label; other codes and nulls are ``unknown``."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(table, column), F.lit(unknown))


def polymorphic(data_id: str, layout: dict[str, dict[str, Column]], names: list[str]) -> list[Column]:
    """Columns whose source depends on ``data_id``: ``layout[id][name]`` is the column to take."""
    out = []
    for name in names:
        c = F.lit(None).cast("string")
        for k, columns in layout.items():
            if name in columns:
                c = F.when(F.col(data_id) == k, columns[name].cast("string")).otherwise(c)
        out.append(c.alias(name))
    return out


def not_listed(frame: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in a blacklist; null keys of the list count for nothing."""
    return frame.join(small(listed.where(F.col(key).isNotNull()).select(key).distinct()), key, "left_anti")


def capped(frame: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return frame.withColumn("row_num", r).where(F.col("row_num") <= most)


def sampled(frame: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows in the order of a digest of the key: a random sample that repeats."""
    return frame.orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def sample_pool(leads: DataFrame, clicks: DataFrame, binding: DataFrame, n: int, account: str = "account") -> DataFrame:
    """``(account, sample_label, leads_cnt)``: lead accounts, clickers without leads, and others, ``n`` each, disjoint.

    ``leads(account)`` has one row for each lead in the label window, ``clicks(account)`` one for each click in the
    feature window before it.
    """
    acc = F.col(account)
    pos = sampled(leads.where(acc.isNotNull()).groupBy(account).agg(F.count("*").alias("leads_cnt")), account, n, "positive")
    pos = pos.select(account, F.lit("positive").alias("sample_label"), "leads_cnt")
    neg = sampled(clicks.where(acc.isNotNull()).select(account).distinct().join(pos, account, "left_anti"), account, n, "click")
    neg = neg.select(account, F.lit("negative_click").alias("sample_label"), F.lit(0).cast("long").alias("leads_cnt"))
    rest = binding.where(acc.isNotNull()).select(account).distinct().join(pos, account, "left_anti").join(neg, account, "left_anti")
    rnd = sampled(rest, account, n, "random").select(account, F.lit("negative_random").alias("sample_label"), F.lit(0).cast("long").alias("leads_cnt"))
    return pos.unionByName(neg).unionByName(rnd)


def sequence_text(details: DataFrame, fields: list[str], header: str, account: str = "account", device: str | None = "device", out: str = "seq") -> DataFrame:
    """One text per account: a header and its rows as comma text, newest first by text order.

    With devices, each has its own text; accounts of several devices list them under a device heading.
    Rows are capped before (see ``capped``), so lists stay small.
    """
    line = F.concat_ws(",", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    keys = [account, device] if device else [account]
    per = details.groupBy(*keys).agg(F.concat(F.lit(header + "\n"), F.array_join(F.sort_array(F.collect_list(line), asc=False), "\n")).alias("_t"))
    if not device:
        return per.select(account, F.col("_t").alias(out))
    head = F.concat(F.lit("=== device "), F.col(device).cast("string"), F.lit(" ===\n"), F.col("_t"))
    return per.groupBy(account).agg(F.when(F.count("*") == 1, F.min("_t")).otherwise(F.array_join(F.sort_array(F.collect_list(head)), "\n")).alias(out))


def abnormal_flags(ads: DataFrame, account: str = "account", limits=ABNORMAL) -> DataFrame:
    """``(account, imp, click, conv, abnormal_user_flag)`` from summed measures; the first limit passed names the flag."""
    sums = ads.where(~F.col("event_type").isin(INVALID_AD_EVENTS)).groupBy(account).agg(*[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m, _, _ in limits])
    flag = F.lit("normal")
    for m, most, name in reversed(limits):
        flag = F.when(F.col(m) > most, name).otherwise(flag)
    return sums.withColumn("abnormal_user_flag", flag)


def action_path(ads: DataFrame, split_day: Column, device: str = "device") -> DataFrame:
    """Per device its ad actions as one text: summed before ``split_day``, in detail from it on; one scan."""
    far = F.to_date("day") < split_day
    keyed = ads.where(~F.col("event_type").isin(INVALID_AD_EVENTS)).withColumn("period", F.when(far, "history").otherwise(F.date_format("day", "yyyy-MM-dd")))
    sums = keyed.groupBy(device, "period", "event_type", "app").agg(F.sum("n").cast("long").alias("n"))
    step = F.format_string("[%s][%s] x%d %s", "period", "event_type", "n", F.coalesce("app", F.lit("unknown")))
    return sums.groupBy(device).agg(F.array_join(F.sort_array(F.collect_list(step), asc=False), " -> ").alias("ad_action_seq"))


def device_lists(binding: DataFrame, account: str = "account", device: str = "device") -> DataFrame:
    return binding.where(F.col(account).isNotNull()).groupBy(account).agg(
        F.count(device).alias("device_cnt"), F.array_join(F.sort_array(F.collect_set(F.col(device).cast("string"))), ",").alias("did_list")
    )


def profile_text(columns: dict[str, Column]) -> Column:
    """``name:value;…`` with unknown values spelled out."""
    return F.concat_ws(";", *[F.concat(F.lit(k + ":"), F.coalesce(c.cast("string"), F.lit("unknown"))) for k, c in columns.items()])


def wide(pool: DataFrame, tables: dict[str, tuple[DataFrame, str]], account: str = "account") -> DataFrame:
    """``pool`` left-joined to one-row-per-account tables on the account; missing values get the table's default.

    All sides hash on the account, so the exchange of the pool is reused from join to join.
    """
    out = pool
    for column, (table, default) in tables.items():
        out = out.join(table.select(account, column), account, "left").withColumn(column, F.coalesce(column, F.lit(default)))
    return out


def between(fact: DataFrame, days: tuple[str, str]) -> DataFrame:
    """Facts whose ``day`` is in a window, both ends included."""
    return fact.where(F.col("day").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))


def usage_sums(bound: DataFrame, least: float = 5) -> DataFrame:
    """Seconds by account, device, day and app, those of more than ``least``; days as text."""
    sums = bound.groupBy("account", "device", "day", "app").agg(F.round(F.sum("seconds"), 2).alias("seconds"))
    return sums.where(F.col("seconds") > least).withColumn("day", F.col("day").cast("string"))


def top_apps(sums: DataFrame, recent_from: str, recent: bool, most: int) -> DataFrame:
    """The longest used apps: of every device and day from ``recent_from`` on, or of every device over the days before."""
    if recent:
        return capped(sums.where(F.col("day") >= recent_from), ["account", "device", "day"], [F.desc("seconds"), F.col("app")], most)
    return capped(sums.where(F.col("day") < recent_from), ["account", "device"], [F.desc("seconds"), F.col("app"), F.col("day")], most)


def latest_behaviours(sources: dict[str, DataFrame], most: int = 200) -> DataFrame:
    """The latest rows of every source and device; sources share their columns and are ranked in one shuffle.

    Rows of a day, app and line go by their fields, so that reruns agree.
    """
    rows = None
    for name, frame in sources.items():
        one = frame.withColumn("source", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return capped(rows, ["source", "account", "device"], [F.desc("day"), F.col("app"), F.col("line"), F.col("field1"), F.col("field2")], most)


def latest_ads(ads: DataFrame, most: int = 100) -> DataFrame:
    """The latest impressions, clicks and conversions of every account, summed by day and app; days as text."""
    a = ads.where("event_type in ('impression', 'click', 'conversion')")
    g = a.groupBy("account", "event_type", "day", "app").agg(F.sum("n").alias("n"))
    return capped(g, ["account", "event_type"], [F.desc("day"), F.desc("n"), F.col("app")], most).withColumn("day", F.col("day").cast("string"))


@dataclass(frozen=True)
class Vertical:
    """What one training table asks of the shared job: windows, what makes a positive, caps, and its industry sources."""

    name: str
    label: tuple[str, str]
    feature: tuple[str, str]
    recent_from: str
    positive: str
    sources: tuple[str, ...] = ()
    samples: int = 60
    recent_rows: int = 30
    older_rows: int = 100
    ad_rows: int = 100
    behaviour_rows: int = 200


def vertical_pool(spec: Vertical, binding: DataFrame, facts: DataFrame, ads: DataFrame) -> DataFrame:
    """The sample of a vertical: positives of the label window, clickers of the feature window, and others."""
    leads = bind(between(facts, spec.label).where(spec.positive), binding)
    clicks = bind(between(ads, spec.feature).where("click > 0"), binding)
    return sample_pool(leads, clicks, binding, spec.samples)


def training_table(spec: Vertical, pool: DataFrame, binding: DataFrame, facts: DataFrame, ads: DataFrame, sources: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """One row per account of ``pool`` with its texts: profile, apps, ads, each industry source, devices, and the abnormal flag.

    ``pool`` is a written sample of at most three times ``spec.samples`` accounts.  Its devices are cut out of the
    binding first, so that facts (not yet bound to accounts) are summed and ranked for them alone.
    """
    mine = binding.join(F.broadcast(pool.select("account")), "account", "left_semi")
    sums = usage_sums(bind(between(facts, spec.feature), mine))
    apps = top_apps(sums, spec.recent_from, True, spec.recent_rows).unionByName(top_apps(sums, spec.recent_from, False, spec.older_rows))
    bound = bind(ads, mine)
    tables = {
        "profile_text": (profiles.join(F.broadcast(pool.select("account")), "account", "left_semi"), ""),
        "app_seq": (sequence_text(apps, ["day", "app", "seconds"], "day,app,seconds", out="app_seq"), ""),
        "ad_seq": (sequence_text(latest_ads(bound, spec.ad_rows), ["day", "event_type", "app", "n"], "day,event,app,n", device=None, out="ad_seq"), ""),
    }
    if spec.sources:
        latest = latest_behaviours({k: bind(between(sources[k], spec.feature), mine) for k in spec.sources}, spec.behaviour_rows)
        for k in spec.sources:
            text = sequence_text(latest.where(F.col("source") == k), ["day", "app", "field1", "field2"], "day,app,field1,field2", out=f"{k}_seq")
            tables[f"{k}_seq"] = (text, "")
    tables["abnormal_user_flag"] = (abnormal_flags(bound), "normal")
    tables["did_list"] = (device_lists(mine), "")
    return wide(pool, tables)


def write_usage(facts: DataFrame, binding: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Facts bound to accounts and summed (``usage_sums``), written once as ``table``, bucketed by account for all verticals.

    Sums are made before rows move to their account's bucket, so an account's bucket holds its distinct devices, days and apps and not
    its facts.  ``buckets`` grows with the data: a bucket is a task's work.
    """
    sums = usage_sums(bind(facts, binding))
    sums.repartition(buckets, "account").write.mode("overwrite").bucketBy(buckets, "account").sortBy("account").saveAsTable(table)
    return facts.sparkSession.table(table)


def apps_of_accounts(spec: Vertical, pool: DataFrame, usage: DataFrame) -> DataFrame:
    """``pool`` with ``app_seq``, the texts of ``training_table``, from a table that ``write_usage`` made.

    Rows stay in their bucket from the scan to the join: windows and groups all have the account among their keys, recent and older
    rows are ranked by one window, and only the pool moves.
    """
    mine = usage.where(F.col("day").between(*spec.feature)).join(small(pool.select("account")), "account", "left_semi")
    recent = F.col("day") >= spec.recent_from
    rank = F.row_number().over(W.partitionBy("account", "device", "_part").orderBy(F.desc("seconds"), "app", "day"))
    ranked = mine.withColumn("_part", F.when(recent, F.col("day")).otherwise("")).withColumn("row_num", rank)
    kept = ranked.where(F.col("row_num") <= F.when(recent, spec.recent_rows).otherwise(spec.older_rows))
    return wide(pool, {"app_seq": (sequence_text(kept, ["day", "app", "seconds"], "day,app,seconds", out="app_seq"), "")})


def distribution(frame: DataFrame, by: str) -> DataFrame:
    """Rows and share in percent of each value."""
    n = frame.groupBy(by).agg(F.count("*").alias("n"))
    return n.select(by, "n", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy()), 2).alias("pct"))


def coverage(frame: DataFrame, columns: list[str]) -> DataFrame:
    """For each column the rows that have some text, and their share."""
    a = frame.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.round(F.col(c) * 100 / F.col("n"), 2).alias("pct")) for c in columns])
    return a.select(F.explode(pairs).alias("p")).select("p.*")


def overlaps(pool: DataFrame, key: str = "account", label: str = "sample_label") -> DataFrame:
    """Accounts that are in two classes, by pair of classes; none are expected."""
    a, b = pool.select(key, F.col(label).alias("a")), pool.select(key, F.col(label).alias("b"))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
