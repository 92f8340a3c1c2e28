"""Registered queries on bound facts and training wide tables, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import wide_table as T
from ..streaming.run import stored
from .driver_tables import table


def binding(spark, d) -> DataFrame:
    """Orders as devices, customers as accounts; every 13th device has no account."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("device"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("account"))


def usage(spark, d) -> DataFrame:
    """Line items as app usage of a device on a day."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("device"), (F.col("l_partkey") % 40).alias("app"), F.col("l_quantity").alias("seconds"), F.to_date("l_shipdate").alias("day"), "l_returnflag", "l_linestatus", "l_extendedprice", "l_linenumber")


def ad_facts(spark, d) -> DataFrame:
    """Line items as ad facts of a device."""
    u = usage(spark, d)
    kind = F.when(F.col("l_linenumber") % 5 == 4, "skip").when(F.col("l_returnflag") == "A", "click").when(F.col("l_returnflag") == "N", "impression").otherwise("conversion")
    n = F.floor("seconds").cast("long")
    m = u.select("device", "day", kind.alias("event_type"), F.col("app").cast("string").alias("app"), n.alias("n"))
    measures = [F.when(F.col("event_type") == k, F.col("n")).otherwise(0).alias(x) for x, k in (("imp", "impression"), ("click", "click"), ("conv", "conversion"))]
    return m.select("*", *measures)


def ads(spark, d) -> DataFrame:
    """Ad facts of an account's device."""
    return T.bind(ad_facts(spark, d), binding(spark, d))


def sources(spark, d) -> dict[str, DataFrame]:
    """Three industry sources, line items by number, each with its own fields."""
    li = table(spark, d, "lineitem")
    fields = {"travel": ("l_suppkey", "l_returnflag"), "finance": ("l_linestatus", "l_suppkey"), "shop": ("l_returnflag", "l_linestatus")}
    common = [F.col("l_orderkey").alias("device"), F.to_date("l_shipdate").alias("day"), (F.col("l_partkey") % 40).alias("app"), F.col("l_linenumber").alias("line")]
    return {
        k: li.where(F.col("l_linenumber") % 3 == i).select(*common, *[F.col(c).cast("string").alias(n) for n, c in zip(("field1", "field2"), f)])
        for i, (k, f) in enumerate(fields.items())
    }


SQL = """binding AS (SELECT o_orderkey AS device, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS account FROM orders),
usage AS (SELECT l_orderkey AS device, l_partkey % 40 AS app, l_quantity AS seconds, CAST(l_shipdate AS DATE) AS day, l_returnflag, l_linestatus, l_extendedprice, l_linenumber FROM lineitem),
ads0 AS (SELECT device, day, CASE WHEN l_linenumber % 5 = 4 THEN 'skip' WHEN l_returnflag = 'A' THEN 'click' WHEN l_returnflag = 'N' THEN 'impression' ELSE 'conversion' END AS event_type, CAST(app AS VARCHAR) AS app, CAST(FLOOR(seconds) AS BIGINT) AS n FROM usage),
ads AS (SELECT a.*, account, CASE WHEN event_type = 'impression' THEN n ELSE 0 END AS imp, CASE WHEN event_type = 'click' THEN n ELSE 0 END AS click, CASE WHEN event_type = 'conversion' THEN n ELSE 0 END AS conv FROM ads0 a JOIN binding USING (device) WHERE account IS NOT NULL)"""

LABEL, FEATURE = ("2001-01-01", "2001-12-31"), ("2000-07-01", "2000-12-31")


LEADS = T.Vertical("leads", LABEL, FEATURE, "2000-12-25", "l_returnflag = 'R'", ("travel", "finance", "shop"))
LOAN = T.Vertical("loan", ("1998-01-01", "1998-12-31"), ("1997-01-01", "1997-12-31"), "1997-12-25", "l_returnflag = 'A' AND l_linestatus = 'F'", ("finance",), samples=40)
PAYMENT = T.Vertical("payment", ("1999-07-01", "1999-12-31"), ("1999-01-01", "1999-06-30"), "1999-06-24", "l_extendedprice > 50000", samples=50, ad_rows=20)
_days = T.between


def j1_bound_usage(spark, d):
    return T.bind(usage(spark, d), binding(spark, d)).groupBy("account").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 2).alias("seconds"))


def j2_dimension_fallback(spark, d):
    dim = table(spark, d, "part").where("p_partkey % 3 > 0 and p_partkey < 40").select(F.col("p_partkey").alias("app"), F.col("p_name").alias("app_name"))
    return T.with_dimension(usage(spark, d), dim, "app", "app_name").groupBy("app", "app_name").agg(F.count("*").alias("n"))


def j3_case_key_join(spark, d):
    dim = table(spark, d, "supplier").where("s_suppkey < 10").select(F.col("s_suppkey").alias("k"), "s_name")
    u = usage(spark, d).withColumn("k", F.when(F.col("l_returnflag") == "A", F.col("app") % 10).when(F.col("l_returnflag") == "N", F.lit(3)))
    return T.with_dimension(u, dim, "k", "s_name").groupBy(F.coalesce("s_name", F.lit("none")).alias("s_name")).agg(F.count("*").alias("n"))


def j4_conditional_join(spark, d):
    dim = table(spark, d, "part").where("p_partkey < 40").select(F.col("p_partkey").alias("app"), F.col("p_brand").alias("brand"))
    return T.with_dimension(usage(spark, d), dim, "app", "brand", on=F.col("l_linestatus") == "O").groupBy("brand").agg(F.count("*").alias("n"))


def f7_blacklist(spark, d):
    u = usage(spark, d)
    listed = table(spark, d, "part").where("p_partkey < 40 and p_size > 25").select(F.col("p_partkey").alias("app"))
    return T.not_listed(u, listed, "app").groupBy("app").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 2).alias("seconds"))


def f8_invalid_ad_events(spark, d):
    return ads(spark, d).where(~F.col("event_type").isin(T.INVALID_AD_EVENTS)).groupBy("event_type").agg(F.sum("n").alias("n"))


def a17_app_usage(spark, d):
    """Usage by account, device, day and app, of more than five seconds."""
    return T.usage_sums(T.bind(_days(usage(spark, d), FEATURE), binding(spark, d)))


def w1_top_apps_recent(spark, d):
    """The 30 longest used apps of each device on each of the last seven days."""
    return T.top_apps(a17_app_usage(spark, d), LEADS.recent_from, True, LEADS.recent_rows)


def w2_top_apps_older(spark, d):
    """The 100 longest uses of each device on the days before."""
    return T.top_apps(a17_app_usage(spark, d), LEADS.recent_from, False, LEADS.older_rows)


def w3_latest_installs(spark, d, installs=1000, uninstalls=100):
    """The latest installs and uninstalls of each device."""
    u = usage(spark, d).select("device", "app", "day", F.when(F.col("l_returnflag") == "R", "uninstall").otherwise("install").alias("kind"), "l_linenumber")
    ins = T.capped(u.where("kind = 'install'"), ["device"], [F.desc("day"), F.col("app"), F.col("l_linenumber")], installs)
    out = T.capped(u.where("kind = 'uninstall'"), ["device"], [F.desc("day"), F.col("app"), F.col("l_linenumber")], uninstalls)
    return ins.unionByName(out).select("device", "app", F.col("day").cast("string").alias("day"), "kind", "row_num")


def w4_latest_behaviours(spark, d):
    """The latest 200 rows of each of three sources and device."""
    b = binding(spark, d)
    return T.latest_behaviours({k: T.bind(f, b) for k, f in sources(spark, d).items()}).withColumn("day", F.col("day").cast("string"))


def w5_latest_ads(spark, d, most=100):
    """The latest ad rows of each account and event type."""
    return T.latest_ads(ads(spark, d), most)


def w6_share_of_total(spark, d):
    return T.distribution(ads(spark, d), "event_type")


def a18_abnormal_users(spark, d):
    return T.abnormal_flags(ads(spark, d), limits=(("imp", 900, "too many impressions"), ("click", 300, "too many clicks"), ("conv", 250, "too many conversions")))


def a19_behaviour_text(spark, d):
    sums = a17_app_usage(spark, d)
    a = T.top_apps(sums, LEADS.recent_from, True, 30).unionByName(T.top_apps(sums, LEADS.recent_from, False, 100))
    return T.sequence_text(a, ["day", "app", "seconds"], "day,app,seconds")


def a20_ad_text(spark, d):
    return T.sequence_text(w5_latest_ads(spark, d), ["day", "event_type", "app", "n"], "day,event,app,n", device=None)


def a21_action_path(spark, d):
    return T.action_path(ads(spark, d), F.lit("2001-05-01").cast("date"))


def a22_device_lists(spark, d):
    return T.device_lists(binding(spark, d))


def a23_positive_samples(spark, d):
    """Paid amount and paying days by account in the label window, of more than one day."""
    b = T.bind(_days(usage(spark, d), LABEL), binding(spark, d))
    return b.groupBy("account").agg(F.count("*").alias("leads"), F.round(F.sum("l_extendedprice"), 2).alias("paid"), F.size(F.collect_set("day")).alias("days")).where("days > 1")


def _pool(spark, d, spec=LEADS):
    return T.vertical_pool(spec, binding(spark, d), usage(spark, d), ad_facts(spark, d))


def d38_sample_pool(spark, d):
    return _pool(spark, d)


def t1_repeatable_sample(spark, d):
    return T.sampled(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 100, "sample")


def j5_semi_join_pool(spark, d):
    return T.bind(usage(spark, d), binding(spark, d)).join(_pool(spark, d), "account", "left_semi").groupBy("account").agg(F.count("*").alias("n"))


def j6_anti_join_pool(spark, d):
    return binding(spark, d).where("account is not null").join(_pool(spark, d), "account", "left_anti").agg(F.count("*").alias("devices"), F.count_distinct("account").alias("accounts"))


def _training_table(spark, d, spec):
    pool = stored(_pool(spark, d, spec))  # a bounded sample that all parts read
    text = T.profile_text({"segment": F.col("c_mktsegment"), "nation": T.decoded(F.col("c_nationkey"), {0: "zero", 1: "one", 2: "two"}), "balance": F.round("c_acctbal", 0).cast("long")})
    profiles = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), text.alias("profile_text"))
    return T.training_table(spec, pool, binding(spark, d), usage(spark, d), ad_facts(spark, d), sources(spark, d), profiles)


def d39_wide_table(spark, d):
    """The training table of car leads: apps, ads, and three industry sources."""
    return _training_table(spark, d, LEADS)


def d39_loan_table(spark, d):
    """The training table of completed loans, with the finance source."""
    return _training_table(spark, d, LOAN)


def d39_payment_table(spark, d):
    """The training table of game payments, without industry sources."""
    return _training_table(spark, d, PAYMENT)


def j8_bucketed_verticals(spark, d):
    """App texts of three verticals from usage that is bound, summed and bucketed by account once."""
    usage_table = T.write_usage(usage(spark, d), binding(spark, d), f"usage_{uuid.uuid4().hex}")
    out = None
    for spec in (LEADS, LOAN, PAYMENT):
        pool = stored(_pool(spark, d, spec))
        one = T.apps_of_accounts(spec, pool, usage_table).select(F.lit(spec.name).alias("vertical"), "account", "app_seq")
        out = one if out is None else out.unionByName(one)
    return out


def a24_wide_coverage(spark, d):
    return T.coverage(d39_wide_table(spark, d), ["profile_text", "app_seq", "ad_seq", "travel_seq", "finance_seq", "did_list"])


def a25_class_overlaps(spark, d):
    p = stored(_pool(spark, d))
    return p.groupBy("sample_label").agg(F.count("*").alias("n")).join(T.overlaps(p).groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("overlaps")))


def a26_conversion_types(spark, d):
    pool = _pool(spark, d).where("sample_label = 'positive'")
    return T.distribution(ads(spark, d).join(pool, "account", "left_semi"), "event_type")


def p8_polymorphic_columns(spark, d):
    e = table(spark, d, "lineitem")
    layout = {"A": {"field1": F.col("l_partkey"), "field2": F.col("l_suppkey")}, "R": {"field1": F.col("l_suppkey")}}
    return e.select("l_orderkey", "l_linenumber", "l_returnflag", *T.polymorphic("l_returnflag", layout, ["field1", "field2"]))


def p7_profile_text(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", T.profile_text({"segment": F.col("c_mktsegment"), "nation": T.decoded(F.col("c_nationkey"), {0: "zero", 1: "one", 2: "two"})}).alias("features"))


def u2_action_union(spark, d):
    """Six branches of ad details, from one scan."""
    a = ads(spark, d).where("event_type in ('impression', 'click', 'conversion')")
    branch = F.concat_ws(" ", F.when(F.col("day") < "2000-01-01", "far").otherwise("near"), "event_type")
    return a.groupBy("account", branch.alias("branch")).agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (j8_bucketed_verticals, j1_bound_usage, j2_dimension_fallback, j3_case_key_join, j4_conditional_join, f7_blacklist, f8_invalid_ad_events, a17_app_usage, w1_top_apps_recent, w2_top_apps_older, w3_latest_installs, w4_latest_behaviours, w5_latest_ads, w6_share_of_total, a18_abnormal_users, a19_behaviour_text, a20_ad_text, a21_action_path, a22_device_lists, a23_positive_samples, d38_sample_pool, t1_repeatable_sample, j5_semi_join_pool, j6_anti_join_pool, d39_wide_table, d39_loan_table, d39_payment_table, a24_wide_coverage, a25_class_overlaps, a26_conversion_types, p8_polymorphic_columns, p7_profile_text, u2_action_union)}

_W = f"WITH {SQL}"
_FIELDS = {"travel": ("l_suppkey", "l_returnflag"), "finance": ("l_linestatus", "l_suppkey"), "shop": ("l_returnflag", "l_linestatus")}


def _text(name, rows, columns):
    """SQL of a device text: its rows, the text of each device, and the text of each account."""
    line = f"concat_ws(',', {columns})"
    return f""", {name}_dev AS (SELECT account, device, '{columns.replace(' ', '')}' || chr(10) || string_agg({line}, chr(10) ORDER BY {line} DESC) AS t FROM ({rows}) GROUP BY 1, 2),
{name}_text AS (SELECT account, CASE WHEN COUNT(*) = 1 THEN MIN(t) ELSE string_agg('=== device ' || device || ' ===' || chr(10) || t, chr(10) ORDER BY '=== device ' || device || ' ===' || chr(10) || t) END AS seq FROM {name}_dev GROUP BY 1)"""


def _between(days):
    return f"day BETWEEN DATE '{days[0]}' AND DATE '{days[1]}'"


def _a17(v):
    return f", a17 AS (SELECT account, device, CAST(day AS VARCHAR) AS day, app, ROUND(SUM(seconds), 2) AS seconds FROM usage JOIN binding USING (device) WHERE account IS NOT NULL AND {_between(v.feature)} GROUP BY 1, 2, 3, 4 HAVING ROUND(SUM(seconds), 2) > 5)"


def _apps(v):
    w1 = f"w1 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account, device, day ORDER BY seconds DESC, app) AS row_num FROM a17 WHERE day >= '{v.recent_from}') WHERE row_num <= {v.recent_rows})"
    w2 = f"w2 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account, device ORDER BY seconds DESC, app, day) AS row_num FROM a17 WHERE day < '{v.recent_from}') WHERE row_num <= {v.older_rows})"
    return _a17(v) + f", {w1}, {w2}" + _text("app", "SELECT * FROM w1 UNION ALL SELECT * FROM w2", "day, app, seconds")


def _ads(most):
    return f", w5 AS (SELECT account, event_type, CAST(day AS VARCHAR) AS day, app, n, row_num FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account, event_type ORDER BY day DESC, n DESC, app) AS row_num FROM (SELECT account, event_type, day, app, CAST(SUM(n) AS BIGINT) AS n FROM ads WHERE event_type <> 'skip' GROUP BY 1, 2, 3, 4)) WHERE row_num <= {most})"


def _behaviours(v=None):
    parts = [
        f"SELECT '{k}' AS source, account, device, CAST(l_shipdate AS DATE) AS day, l_partkey % 40 AS app, l_linenumber AS line, CAST({a} AS VARCHAR) AS field1, CAST({b} AS VARCHAR) AS field2 FROM lineitem JOIN binding ON l_orderkey = device WHERE account IS NOT NULL AND l_linenumber % 3 = {i}"
        for i, (k, (a, b)) in enumerate(_FIELDS.items())
    ]
    where = f" WHERE {_between(v.feature)}" if v else ""
    return f", w4 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, account, device ORDER BY day DESC, app, line) AS row_num FROM ({' UNION ALL '.join(parts)}){where}) WHERE row_num <= 200)"


def _pool_sql(v):
    return f""", pos AS (SELECT account, 'positive' AS sample_label, COUNT(*) AS leads_cnt FROM usage JOIN binding USING (device) WHERE account IS NOT NULL AND {v.positive} AND {_between(v.label)} GROUP BY 1 ORDER BY md5('positive:' || account), account LIMIT {v.samples}),
neg AS (SELECT DISTINCT account FROM ads WHERE click > 0 AND {_between(v.feature)} AND account NOT IN (SELECT account FROM pos)), neg1 AS (SELECT account FROM neg ORDER BY md5('click:' || account), account LIMIT {v.samples}),
rest AS (SELECT DISTINCT account FROM binding WHERE account IS NOT NULL AND account NOT IN (SELECT account FROM pos) AND account NOT IN (SELECT account FROM neg1)), rest1 AS (SELECT account FROM rest ORDER BY md5('random:' || account), account LIMIT {v.samples}),
pool AS (SELECT * FROM pos UNION ALL SELECT account, 'negative_click', 0 FROM neg1 UNION ALL SELECT account, 'negative_random', 0 FROM rest1)"""


_A17, _APPS, _W5, _POOL = _a17(LEADS), _apps(LEADS), _ads(100), _pool_sql(LEADS)
_ADT = ", ad_text AS (SELECT account, 'day,event,app,n' || chr(10) || string_agg(concat_ws(',', day, event_type, app, n), chr(10) ORDER BY concat_ws(',', day, event_type, app, n) DESC) AS seq FROM w5 GROUP BY 1)"
_FEATURES = "'segment:' || COALESCE(c_mktsegment, 'unknown') || ';nation:' || CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'unknown' END"
_FLAGS = "CASE WHEN imp > {} THEN 'too many impressions' WHEN click > {} THEN 'too many clicks' WHEN conv > {} THEN 'too many conversions' ELSE 'normal' END AS abnormal_user_flag"
_SUMS = "SELECT account, CAST(SUM(imp) AS BIGINT) AS imp, CAST(SUM(click) AS BIGINT) AS click, CAST(SUM(conv) AS BIGINT) AS conv FROM ads WHERE event_type <> 'skip' GROUP BY 1"


def _wide_sql(v):
    texts = "".join(_text(k, f"SELECT * FROM w4 WHERE source = '{k}'", "day, app, field1, field2") for k in v.sources)
    columns = "".join(f", COALESCE({k}_text.seq, '') AS {k}_seq" for k in v.sources)
    joins = "".join(f" LEFT JOIN {k}_text USING (account)" for k in v.sources)
    return _apps(v) + _ads(v.ad_rows) + _behaviours(v) + texts + _ADT + _pool_sql(v) + f""", flags AS (SELECT *, {_FLAGS.format(10000, 1000, 500)} FROM ({_SUMS})),
dl AS (SELECT account, string_agg(CAST(device AS VARCHAR), ',' ORDER BY CAST(device AS VARCHAR)) AS did_list FROM binding WHERE account IS NOT NULL GROUP BY 1),
wide AS (SELECT account, sample_label, leads_cnt, COALESCE({_FEATURES} || ';balance:' || CAST(ROUND(c_acctbal, 0) AS BIGINT), '') AS profile_text, COALESCE(a.seq, '') AS app_seq, COALESCE(b.seq, '') AS ad_seq{columns}, COALESCE(abnormal_user_flag, 'normal') AS abnormal_user_flag, COALESCE(did_list, '') AS did_list
FROM pool LEFT JOIN customer ON c_custkey = account LEFT JOIN app_text a USING (account) LEFT JOIN ad_text b USING (account){joins} LEFT JOIN flags USING (account) LEFT JOIN dl USING (account))"""


_WIDE = _wide_sql(LEADS)

ORACLE = {
    "j1_bound_usage": _W + " SELECT account, COUNT(*) AS n, ROUND(SUM(seconds), 2) AS seconds FROM usage JOIN binding USING (device) WHERE account IS NOT NULL GROUP BY 1",
    "j2_dimension_fallback": _W + " SELECT app, COALESCE(p_name, CAST(app AS VARCHAR)) AS app_name, COUNT(*) AS n FROM usage LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 > 0 AND p_partkey < 40) ON p_partkey = app GROUP BY 1, 2",
    "j3_case_key_join": _W + " SELECT COALESCE(s_name, CAST(k AS VARCHAR), 'none') AS s_name, COUNT(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN app % 10 WHEN 'N' THEN 3 END AS k FROM usage) LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey < 10) ON s_suppkey = k GROUP BY 1",
    "j4_conditional_join": _W + " SELECT COALESCE(p_brand, CAST(app AS VARCHAR)) AS brand, COUNT(*) AS n FROM usage LEFT JOIN part ON p_partkey = app AND l_linestatus = 'O' GROUP BY 1",
    "f7_blacklist": _W + " SELECT app, COUNT(*) AS n, ROUND(SUM(seconds), 2) AS seconds FROM usage WHERE app NOT IN (SELECT p_partkey FROM part WHERE p_partkey < 40 AND p_size > 25) GROUP BY 1",
    "f8_invalid_ad_events": _W + " SELECT event_type, CAST(SUM(n) AS BIGINT) AS n FROM ads WHERE event_type <> 'skip' GROUP BY 1",
    "a17_app_usage": _W + _A17 + " SELECT * FROM a17",
    "w1_top_apps_recent": _W + _APPS + " SELECT * FROM w1",
    "w2_top_apps_older": _W + _APPS + " SELECT * FROM w2",
    "w3_latest_installs": _W + " SELECT device, app, CAST(day AS VARCHAR) AS day, kind, row_num FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY device, kind ORDER BY day DESC, app, l_linenumber) AS row_num FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'uninstall' ELSE 'install' END AS kind FROM usage)) WHERE row_num <= CASE kind WHEN 'install' THEN 1000 ELSE 100 END",
    "w4_latest_behaviours": _W + _behaviours() + " SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM w4",
    "w5_latest_ads": _W + _W5 + " SELECT * FROM w5",
    "w6_share_of_total": _W + " SELECT event_type, COUNT(*) AS n, ROUND(COUNT(*) * 100 / SUM(COUNT(*)) OVER (), 2) AS pct FROM ads GROUP BY 1",
    "a18_abnormal_users": _W + f" SELECT *, {_FLAGS.format(900, 300, 250)} FROM ({_SUMS})",
    "a19_behaviour_text": _W + _APPS + " SELECT * FROM app_text",
    "a20_ad_text": _W + _W5 + _ADT + " SELECT * FROM ad_text",
    "a21_action_path": _W + ", g AS (SELECT device, CASE WHEN day < DATE '2001-05-01' THEN 'history' ELSE CAST(day AS VARCHAR) END AS period, event_type, app, CAST(SUM(n) AS BIGINT) AS n FROM ads WHERE event_type <> 'skip' GROUP BY 1, 2, 3, 4), s AS (SELECT device, '[' || period || '][' || event_type || '] x' || n || ' ' || app AS step FROM g) SELECT device, string_agg(step, ' -> ' ORDER BY step DESC) AS ad_action_seq FROM s GROUP BY 1",
    "a22_device_lists": _W + " SELECT account, COUNT(device) AS device_cnt, string_agg(CAST(device AS VARCHAR), ',' ORDER BY CAST(device AS VARCHAR)) AS did_list FROM binding WHERE account IS NOT NULL GROUP BY 1",
    "a23_positive_samples": _W + " SELECT account, COUNT(*) AS leads, ROUND(SUM(l_extendedprice), 2) AS paid, COUNT(DISTINCT day) AS days FROM usage JOIN binding USING (device) WHERE account IS NOT NULL AND day BETWEEN DATE '2001-01-01' AND DATE '2001-12-31' GROUP BY 1 HAVING COUNT(DISTINCT day) > 1",
    "d38_sample_pool": _W + _POOL + " SELECT * FROM pool",
    "t1_repeatable_sample": "SELECT c_custkey, c_mktsegment FROM customer ORDER BY md5('sample:' || c_custkey), c_custkey LIMIT 100",
    "j5_semi_join_pool": _W + _POOL + " SELECT account, COUNT(*) AS n FROM usage JOIN binding USING (device) WHERE account IN (SELECT account FROM pool) GROUP BY 1",
    "j6_anti_join_pool": _W + _POOL + " SELECT COUNT(*) AS devices, COUNT(DISTINCT account) AS accounts FROM binding WHERE account IS NOT NULL AND account NOT IN (SELECT account FROM pool)",
    "d39_wide_table": _W + _WIDE + " SELECT * FROM wide",
    "d39_loan_table": _W + _wide_sql(LOAN) + " SELECT * FROM wide",
    "d39_payment_table": _W + _wide_sql(PAYMENT) + " SELECT * FROM wide",
    "a24_wide_coverage": _W + _WIDE + " SELECT field, CAST(COUNT(*) FILTER (v <> '') AS BIGINT) AS filled, ROUND(COUNT(*) FILTER (v <> '') * 100 / COUNT(*), 2) AS pct FROM (UNPIVOT (SELECT profile_text, app_seq, ad_seq, travel_seq, finance_seq, did_list FROM wide) ON COLUMNS(*) INTO NAME field VALUE v) GROUP BY 1",
    "a25_class_overlaps": _W + _POOL + " SELECT sample_label, COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT account FROM pool GROUP BY 1 HAVING COUNT(*) > 1)) AS overlaps FROM pool GROUP BY 1",
    "a26_conversion_types": _W + _POOL + " SELECT event_type, COUNT(*) AS n, ROUND(COUNT(*) * 100 / SUM(COUNT(*)) OVER (), 2) AS pct FROM ads WHERE account IN (SELECT account FROM pos) GROUP BY 1",
    "p8_polymorphic_columns": "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(CASE l_returnflag WHEN 'A' THEN l_partkey WHEN 'R' THEN l_suppkey END AS VARCHAR) AS field1, CAST(CASE l_returnflag WHEN 'A' THEN l_suppkey END AS VARCHAR) AS field2 FROM lineitem",
    "p7_profile_text": f"SELECT c_custkey, {_FEATURES} AS features FROM customer",
    "u2_action_union": _W + " SELECT account, CASE WHEN day < DATE '2000-01-01' THEN 'far ' ELSE 'near ' END || event_type AS branch, CAST(SUM(n) AS BIGINT) AS n FROM ads WHERE event_type <> 'skip' GROUP BY 1, 2",
}
ORACLE["j8_bucketed_verticals"] = " UNION ALL ".join(f"SELECT '{spec.name}' AS vertical, account, app_seq FROM ({ORACLE[name]})" for spec, name in ((LEADS, "d39_wide_table"), (LOAN, "d39_loan_table"), (PAYMENT, "d39_payment_table")))
