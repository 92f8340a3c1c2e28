"""Registered queries on single filters, joins, windows and writers that the larger jobs use, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import audience as A
from ..operators import lift as L
from ..operators import models as M
from ..operators import needs as N
from ..operators import scoring as S
from ..operators import web as B
from ..operators import wide_table as T
from ..sources import files as FS
from ..streaming.run import shared_folder
from . import model_queries, need_queries, rule_sets
from .audience_queries import _SPLIT, FLAGS, _stats, run_date
from .driver_tables import SQL, profile, raw_events, table
from .web_queries import _PLAIN


def f1_target_guard(spark, d):
    """Events that may enter features: all but the target's."""
    return raw_events(spark, d).where(F.col("event_type") != R.TARGET).groupBy("event_type").agg(F.count("*").alias("n"))


def f2_conditions(spark, d):
    specs = [("balance", ">=", 100.0), ("nation", "in", [1, 2, 3, 4, 5]), ("segment", "!=", "BUILDING")]
    assert not R.names_users(specs)
    return profile(spark, d).where(R.conditions(specs)).select("user_id", "segment", "nation")


def f3_text_conditions(spark, d):
    specs = [("c_name", "contains", "00001"), ("c_mktsegment", "equals", "AUTOMOBILE"), ("c_name", "startswith", "Customer#0000000")]
    return table(spark, d, "customer").where(R.conditions(specs, "or")).select("c_custkey")


def f4_overfit_guard(spark, d):
    """Rules (one of each order, its lines as conditions) that name no user by id."""
    li = table(spark, d, "lineitem")
    field = F.when(F.col("l_linenumber") == 4, " User_ID").when(F.col("l_linenumber") == 2, "segment").otherwise("balance")
    return R.without_users(li.select(F.col("l_orderkey").alias("rule"), field.alias("field"), F.col("l_partkey").alias("value")))


def f6_attribute_filters(spark, d):
    e = raw_events(spark, d)
    return e.where(R.condition(R.attribute("brand"), "=", "b3") | R.condition(R.attribute("brand"), "is null") & R.condition(R.attribute("k").cast("int"), "<", 30)).groupBy("event_type", "brand").agg(F.count("*").alias("n"))


def f11_valid_status(spark, d):
    """Rows with a valid status, and how many were removed."""
    o = table(spark, d, "orders")
    ok = F.col("o_orderstatus").isin("O", "F")
    return o.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("removed"))


def f13_touched_users(spark, d):
    u = need_queries.users(spark, d).withColumn("views", F.when(F.size("views") > 0, F.col("views")))
    return u.where(F.col("views").isNotNull() | F.col("inquiry_price_band").isNotNull() & (F.col("inquiry_frequency") > 3)).select("user_id")


def f14_minimum_coverage(spark, d):
    return _stats(spark, d).where("support >= 0.5").select("rule", "users", "support")


def j7_exists_split(spark, d):
    """Conversion with and without an event, in one pass of flags."""
    hit = raw_events(spark, d).where("event_type = 'test_drive' and dwell > 1500").select("user_id").distinct().withColumn("hit", F.lit(True))
    p = profile(spark, d).join(hit, "user_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return p.groupBy("hit").agg(F.count("*").alias("users"), F.round(F.avg("is_lead"), 6).alias("rate"))


def j9_a_before_b(spark, d):
    return R.matches(R.rule_frame(profile(spark, d), {"r": {"before": ("view_car_detail", "view_contact_sales")}}, raw_events(spark, d)), ["r"])


def j10_shared_attribute(spark, d):
    return R.matches(R.rule_frame(profile(spark, d), {"r": {"same": ("view_car_detail", "model", "ad_click", "model")}}, raw_events(spark, d)), ["r"])


def j11_profile_behaviour_predicate(spark, d):
    """Distinct users whose profile or behaviour rows meet a free predicate."""
    j = profile(spark, d).join(raw_events(spark, d).select("user_id", "event_type", "dwell"), "user_id", "left")
    return j.where("nation < 5 and event_type = 'ad_click' or dwell > 3000").select("user_id").distinct()


def a11_event_shares(spark, d):
    return L.field_distribution(raw_events(spark, d), ["event_type"], 50)


def a11_unknown_keys(spark, d):
    """The 50 most frequent keys of no known layout."""
    k = (F.col("event_id") % 70).cast("string")
    key = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("其他_"), k)).otherwise(F.concat(F.lit("试驾_m"), k))
    kind, attrs = X.behaviour_key(F.col("key"))
    e = table(spark, d, "events").select(key.alias("key")).select(kind.alias("kind"), F.try_element_at(attrs, F.lit("raw")).alias("raw"))
    return L.field_distribution(e.where("kind = 'unknown'"), ["raw"], 50)


def a14_diversity(spark, d):
    e = raw_events(spark, d).where(F.col("event_type") != R.TARGET)
    return e.groupBy("user_id").agg(F.size(F.collect_set("brand")).alias("n_brands"), F.size(F.collect_set("model")).alias("n_models"), F.count("*").alias("n"))


def t2_stratified_split(spark, d):
    return L.hash_split(profile(spark, d), "user_id", "is_lead").select("user_id", "is_lead", "split")


def w7_softmax(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 10_000).alias("s"))
    return c.select("c_custkey", F.round(S.softmax(c, "s", "c_nationkey"), 6).alias("p"))


def w9_latest_update(spark, d):
    e = raw_events(spark, d)
    return B.keep_first(e, ["user_id", "event_type"], [F.desc("event_time"), F.desc("dwell")]).select("user_id", "event_type", F.round("dwell", 2).alias("dwell"))


def r15_rule_sets(spark, d):
    """The shipped action rules over events, and the need rules over what they derive."""
    p = profile(spark, d).withColumns({"age_group": F.lit("55岁以上"), "city": F.lit("三亚市"), "consume_freq": F.when(F.col("nation") % 2 == 0, "较高频").otherwise("低频"), "car_status": F.lit("有车"), "city_tier": F.lit("一线")})
    e = raw_events(spark, d)
    actions = {n: r for n, (r, _) in rule_sets.ACTION_RULES.items()}
    derived = A.derived_events(R.rule_frame(p, actions, e, run_date=run_date()), list(actions), e)
    needs = {n: r for n, (r, _) in rule_sets.NEED_RULES.items()}
    hits = R.matches(R.rule_frame(p, needs, e, derived, run_date()), list(needs))
    return derived.select("user_id", F.col("derived_event_type").alias("rule")).union(hits).groupBy("rule").agg(F.count_distinct("user_id").alias("users"))


def d49_feature_flags(spark, d):
    """One boolean column for each published rule."""
    rules = {f"f_{n}": rule_sets.BEHAVIOUR_RULES[n] for n in ("ad_click_user", "multi_brand_search", "full_funnel_user")}
    return R.rule_frame(profile(spark, d), rules, raw_events(spark, d)).select("user_id", *rules)


def p6_decoded(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(T.decoded(F.substring("o_orderpriority", 1, 1), {"1": "urgent", "2": "high", "5": "low"}).alias("priority")).agg(F.count("*").alias("n"))


def p21_platform_articles(spark, d):
    """Platform article pages to title, author, time, cover and body; short bodies are dropped."""
    p = table(spark, d, "pages")
    k = F.col("page_id")
    html = F.concat(F.lit('<h1 class="rich_media_title"> T'), k.cast("string"), F.lit('</h1><a id="js_name"> Author </a><script>var ct = "'), (F.lit(1_700_000_000) + k).cast("string"), F.lit('"; var msg_cdn_url = "https://img.example/c.png";</script><div id="js_content">'), X.html_plain(F.col("html")), F.lit("</div>"))
    return _platform_articles(p.select("page_id", html.alias("html")))


def _platform_articles(pages, least: int = 100):
    body = X.folded(F.regexp_replace(F.regexp_extract("html", r'(?is)id="js_content"[^>]*>(.*?)</div>', 1), r"<[^>]+>", " "))
    out = pages.select(
        "page_id",
        X.folded(F.regexp_extract("html", r'(?is)class="rich_media_title[^"]*"[^>]*>(.*?)</h1>', 1)).alias("title"),
        X.folded(F.regexp_extract("html", r'(?is)id="js_name"[^>]*>(.*?)</a>', 1)).alias("author"),
        F.date_format(F.timestamp_seconds(F.regexp_extract("html", r'var ct = "(\d+)"', 1).try_cast("long")), "yyyy-MM-dd HH:mm:ss").alias("published"),
        F.regexp_extract("html", r'msg_cdn_url = "([^"]*)"', 1).alias("cover"),
        F.length(body).alias("n"),
    )
    return out.where(F.col("n") >= least)


def s4_nested_behaviours(spark, d):
    e = table(spark, d, "events")
    nested = e.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.collect_list(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("res_key"), F.col("event_type").alias("event"), F.col("ts").cast("string").alias("timestamp"), F.lit("").alias("time_str"), F.col("value").alias("dur_time"))).alias("user_events"))
    return FS.exploded_events(nested).groupBy("user_id", "event_raw").agg(F.count("*").alias("n"))


def s7_users_and_views(spark, d):
    u = need_queries.users(spark, d)
    return u.select("user_id", F.size("views").alias("n_views"))


def s15_saved_table(spark, d):
    name = f"features_{uuid.uuid4().hex}"
    FS.save_table(d49_feature_flags(spark, d), name)
    return spark.table(name)


def s17_prediction_csv(spark, d):
    """Predictions written and read back, held against those of the model."""
    f = model_queries._frame(spark, d)
    model = M.train(f, "is_lead", "binary", ["n_actions", "balance"], trees=3, depth=2)
    out = f"{shared_folder(spark)}/predictions"
    told = M.predict(model, f.select("user_id", "n_actions", "balance"), "binary", ["n_actions", "balance"])
    FS.write_csv(told, out)
    read = FS.read_csv(spark, out, ["user_id", "n_actions", "balance", "xgb_prediction", "xgb_probability"])
    read = read.select(F.col("user_id").cast("long").alias("user_id"), F.col("n_actions").try_cast("double").cast("long").alias("n_actions"), F.col("xgb_prediction").try_cast("double").alias("_c"), F.col("xgb_probability").try_cast("double").alias("_p"))
    same = (F.abs(F.col("_p") - F.col("xgb_probability")) < 1e-9) & (F.col("_c") == F.col("xgb_prediction")) & ((F.col("_c") == 1) == (F.col("_p") > 0.5))
    return read.join(told.select("user_id", "xgb_prediction", "xgb_probability"), "user_id").select("user_id", "n_actions", same.alias("same_prediction"))


def d32_label_encoding(spark, d):
    """Categories numbered by alphabet, numbers filled."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("bal"))
    model = M.Pipeline(stages=M.feature_stages(["bal"], ["c_mktsegment"], [])[:1]).fit(M.prepared(c, ["bal"], ["c_mktsegment"], []))
    return model.transform(M.prepared(c, ["bal"], ["c_mktsegment"], [])).select("c_custkey", F.col("c_mktsegment__i").cast("int").alias("code"), F.round("bal", 2).alias("bal"))


def d20_long_commute(spark, d):
    return N.infer_needs(need_queries.users(spark, d), [r for r in N.need_rules(need_queries.WORDS) if r.rule_id == "long_commute"]).where("long_commute").select("user_id")


QUERIES = {f.__name__: f for f in (f1_target_guard, f2_conditions, f3_text_conditions, f4_overfit_guard, f6_attribute_filters, f11_valid_status, f13_touched_users, f14_minimum_coverage, j7_exists_split, j9_a_before_b, j10_shared_attribute, j11_profile_behaviour_predicate, a11_event_shares, a11_unknown_keys, a14_diversity, t2_stratified_split, w7_softmax, w9_latest_update, r15_rule_sets, d49_feature_flags, p6_decoded, p21_platform_articles, s4_nested_behaviours, s7_users_and_views, s15_saved_table, s17_prediction_csv, d32_label_encoding, d20_long_commute)}

_W = f"WITH {SQL}"
_D49 = FLAGS + " SELECT user_id, ad_click_user AS f_ad_click_user, multi_brand_search AS f_multi_brand_search, full_funnel_user AS f_full_funnel_user FROM flags"
ORACLE = {
    "f1_target_guard": f"{_W} SELECT event_type, COUNT(*) AS n FROM raw WHERE event_type <> 'lead_submit' GROUP BY 1",
    "f2_conditions": f"{_W} SELECT user_id, segment, nation FROM profile WHERE balance >= 100 AND nation IN (1, 2, 3, 4, 5) AND segment <> 'BUILDING'",
    "f3_text_conditions": "SELECT c_custkey FROM customer WHERE contains(c_name, '00001') OR c_mktsegment = 'AUTOMOBILE' OR starts_with(c_name, 'Customer#0000000')",
    "f4_overfit_guard": "SELECT l_orderkey AS rule, COUNT(*) AS n_conditions FROM lineitem GROUP BY 1 HAVING COUNT(*) FILTER (l_linenumber = 4) = 0",
    "f6_attribute_filters": f"{_W} SELECT event_type, brand, COUNT(*) AS n FROM raw WHERE brand = 'b3' OR brand IS NULL AND k < 30 GROUP BY 1, 2",
    "f11_valid_status": "SELECT COUNT(*) FILTER (o_orderstatus IN ('O', 'F')) AS kept, COUNT(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS removed FROM orders",
    "f13_touched_users": f"WITH {need_queries.SQL} SELECT user_id FROM u WHERE n_views > 0 OR k % 5 > 3",
    "f14_minimum_coverage": FLAGS + " SELECT rule, COUNT(*) AS users, ROUND(COUNT(*) / ANY_VALUE(total), 6) AS support FROM hit, base GROUP BY 1 HAVING COUNT(*) / ANY_VALUE(total) >= 0.5",
    "j7_exists_split": f"{_W} SELECT user_id IN (SELECT user_id FROM raw WHERE event_type = 'test_drive' AND dwell > 1500) AS hit, COUNT(*) AS users, ROUND(AVG(is_lead), 6) AS rate FROM profile GROUP BY 1",
    "j9_a_before_b": f"{_W} SELECT user_id, 'r' AS rule FROM profile JOIN raw USING (user_id) GROUP BY 1 HAVING MAX(event_time) FILTER (event_type = 'view_car_detail') < MIN(event_time) FILTER (event_type = 'view_contact_sales')",
    "j10_shared_attribute": f"{_W} SELECT DISTINCT a.user_id, 'r' AS rule FROM raw a JOIN raw b ON a.user_id = b.user_id AND a.model = b.model WHERE a.event_type = 'view_car_detail' AND b.event_type = 'ad_click'",
    "j11_profile_behaviour_predicate": f"{_W} SELECT DISTINCT user_id FROM profile LEFT JOIN raw USING (user_id) WHERE nation < 5 AND event_type = 'ad_click' OR dwell > 3000",
    "a11_event_shares": f"{_W} SELECT 'event_type' AS field, event_type AS value, COUNT(*) AS n, ROUND(COUNT(*) * 100 / SUM(COUNT(*)) OVER (), 4) AS pct FROM raw GROUP BY event_type",
    "a11_unknown_keys": "WITH g AS (SELECT '其他_' || (event_id % 70) AS value, COUNT(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT 'raw' AS field, value, n, ROUND(n * 100 / (SELECT SUM(n) FROM g), 4) AS pct FROM g ORDER BY n DESC, value LIMIT 50",
    "a14_diversity": f"{_W} SELECT user_id, COUNT(DISTINCT brand) AS n_brands, COUNT(DISTINCT model) AS n_models, COUNT(*) AS n FROM raw WHERE event_type <> 'lead_submit' GROUP BY 1",
    "t2_stratified_split": f"{_W}{_SPLIT} SELECT user_id, is_lead, split FROM parts",
    "w7_softmax": "SELECT c_custkey, ROUND(exp(c_acctbal / 10000 - MAX(c_acctbal / 10000) OVER n) / SUM(exp(c_acctbal / 10000 - m)) OVER n, 6) AS p FROM (SELECT *, MAX(c_acctbal / 10000) OVER (PARTITION BY c_nationkey) AS m FROM customer) WINDOW n AS (PARTITION BY c_nationkey)",
    "w9_latest_update": f"{_W} SELECT user_id, event_type, ROUND(dwell, 2) AS dwell FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_time DESC, dwell DESC) AS r FROM raw) WHERE r = 1",
    "d49_feature_flags": _D49,
    "p6_decoded": "SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '5' THEN 'low' ELSE 'unknown' END AS priority, COUNT(*) AS n FROM orders GROUP BY 1",
    "p21_platform_articles": f"SELECT * FROM (SELECT page_id, 'T' || page_id AS title, 'Author' AS author, strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS published, 'https://img.example/c.png' AS cover, length({_PLAIN}) AS n FROM pages) WHERE n >= 100",
    "s4_nested_behaviours": "SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS event_raw, COUNT(*) AS n FROM events GROUP BY 1, 2",
    "s7_users_and_views": f"WITH {need_queries.SQL}, c AS (SELECT user_id, COUNT(DISTINCT (power, body, band, size)) AS n FROM v GROUP BY 1) SELECT u.user_id, COALESCE(n, 0) AS n_views FROM u LEFT JOIN c USING (user_id)",
    "s15_saved_table": _D49,
    "s17_prediction_csv": f"{_W} SELECT profile.user_id, COUNT(raw.user_id) AS n_actions, TRUE AS same_prediction FROM profile LEFT JOIN (SELECT * FROM raw WHERE event_type <> 'lead_submit') raw USING (user_id) GROUP BY 1",
    "d32_label_encoding": "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS code, CASE WHEN c_custkey % 2 = 0 THEN ROUND(c_acctbal, 2) ELSE 0 END AS bal FROM customer",
    "d20_long_commute": f"WITH {need_queries.SQL} SELECT user_id FROM nd WHERE long_commute",
}
