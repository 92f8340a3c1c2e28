"""Registered queries on rules, lift, scores and plans, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import audience as A
from ..operators import bitmaps as BM
from ..operators import lift as L
from ..operators import scoring as S
from . import rule_sets
from ..streaming.run import stored
from .driver_tables import RUN_DATE, SQL, profile, raw_events, table


def run_date():
    return F.lit(RUN_DATE).cast("date")

NAMES = [*rule_sets.BEHAVIOUR_RULES, *rule_sets.TOTAL_RULES]


_s, _d = "COUNT(*) FILTER (event_type IN ('search_vertical','search_general'))", "COUNT(*) FILTER (event_type = 'view_car_detail')"


def _n(kind: str) -> str:
    return f"COUNT(*) FILTER (event_type = '{kind}')"


RULE_SQL = {
    "multi_day_search": "COUNT(DISTINCT CASE WHEN event_type IN ('search_vertical','search_general') THEN CAST(event_time AS DATE) END) >= 3",
    "brand_focused_search": "COUNT(*) FILTER (event_type IN ('search_vertical','search_general') AND brand IS NOT NULL) >= 2",
    "high_freq_search": f"{_s} >= 10",
    "vertical_search_user": f"{_n('search_vertical')} >= 2",
    "entertainment_search_user": f"{_n('search_entertainment')} >= 2",
    "high_engagement_search": "COALESCE(MAX(dwell) FILTER (event_type = 'search_general') >= 3000, FALSE)",
    "multi_brand_search": "COUNT(DISTINCT CASE WHEN event_type IN ('search_vertical','search_general') THEN brand END) >= 3",
    "detail_view_user": f"{_d} >= 2",
    "loan_calc_user": f"{_n('view_loan_calc')} >= 1",
    "car_compare_user": f"{_n('view_car_compare')} >= 1",
    "floor_price_user": f"{_n('view_floor_price')} >= 1",
    "contact_sales_user": f"{_n('view_contact_sales')} >= 1",
    "short_video_car_user": f"{_n('view_short_video')} >= 2",
    "multi_model_detail": "COUNT(DISTINCT CASE WHEN event_type = 'view_car_detail' THEN model END) >= 3",
    "ad_click_user": f"{_n('ad_click')} >= 1",
    "multi_ad_click": f"{_n('ad_click')} >= 3",
    "brand_ad_click": "COUNT(*) FILTER (event_type = 'ad_click' AND brand IS NOT NULL) >= 1",
    "pass_dealership_intent": f"({_n('pass_dealership')} >= 2 OR COALESCE(MAX(dwell) FILTER (event_type = 'pass_dealership') > 1800, FALSE))",
    "pass_dealership_once": f"{_n('pass_dealership')} >= 1",
    "map_app_power_user": f"{_n('map_app_use')} >= 5",
    "rental_car_user": f"{_n('rental_app_use')} >= 1",
    "test_drive_user": f"{_n('test_drive')} >= 1",
    "order_placed_user": f"{_n('order_placed')} >= 1",
    "search_then_detail": f"({_s} >= 1 AND {_d} >= 1)",
    "detail_view_with_loan": f"({_d} >= 1 AND {_n('view_loan_calc')} >= 1)",
    "detail_and_compare": f"({_d} >= 1 AND {_n('view_car_compare')} >= 1)",
    "detail_and_floor_price": f"({_d} >= 1 AND {_n('view_floor_price')} >= 1)",
    "search_and_ad_click": f"({_s} >= 1 AND {_n('ad_click')} >= 1)",
    "search_and_dealership": f"({_s} >= 1 AND {_n('pass_dealership')} >= 1)",
    "contact_sales_with_detail": f"({_n('view_contact_sales')} >= 1 AND {_d} >= 1)",
    "video_then_search": f"({_n('view_short_video')} >= 1 AND {_s} >= 1)",
    "test_drive_with_search": f"({_n('test_drive')} >= 1 AND {_s} >= 1)",
    "map_and_dealership": f"({_n('map_app_use')} >= 1 AND {_n('pass_dealership')} >= 1)",
    "full_funnel_user": f"({_s} >= 1 AND {_d} >= 1 AND {_n('view_loan_calc')} >= 1 AND {_n('pass_dealership')} >= 1)",
    "high_total_actions": "COUNT(*) FILTER (event_type <> 'lead_submit') >= 20",
    "multi_event_type_user": "COUNT(DISTINCT CASE WHEN event_type <> 'lead_submit' THEN event_type END) >= 4",
    "long_total_duration": "COALESCE(SUM(dwell) FILTER (event_type <> 'lead_submit') >= 3600, FALSE)",
    "recent_30day_multi_action": f"COUNT(DISTINCT CASE WHEN event_type <> 'lead_submit' AND CAST(event_time AS DATE) >= DATE '{RUN_DATE}' - 30 THEN event_type END) >= 3",
}

FLAGS = (
    f"WITH {SQL}, flags AS (SELECT profile.user_id, ANY_VALUE(is_lead) AS is_lead, ANY_VALUE(segment) AS segment, "
    + ", ".join(f"{c} AS {n}" for n, c in RULE_SQL.items())
    + " FROM profile JOIN raw USING (user_id) GROUP BY profile.user_id), hit AS (SELECT user_id, is_lead, rule FROM (UNPIVOT (SELECT user_id, is_lead, "
    + ", ".join(f"CAST({n} AS INT) AS {n}" for n in RULE_SQL)
    + " FROM flags) ON COLUMNS(* EXCLUDE (user_id, is_lead)) INTO NAME rule VALUE v) WHERE v = 1)"
    + ", base AS (SELECT AVG(is_lead) AS base, COUNT(*) AS total FROM profile)"
    + ", last AS (SELECT user_id, MAX(event_time) AS event_time FROM raw WHERE event_type <> 'lead_submit' GROUP BY user_id)"
)
STATS = ", stats AS (SELECT rule, COUNT(*) AS users, ROUND(COUNT(*) / ANY_VALUE(total), 6) AS support, ROUND(AVG(is_lead), 6) AS rate, ROUND(AVG(is_lead) / ANY_VALUE(base) * 100, 4) AS tgi FROM hit, base GROUP BY rule)"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Users with their rule flags, computed once: one pass over the events, then a narrow table that all else reads."""
    return stored(A.behaviour_flags(profile(spark, d), raw_events(spark, d), rule_sets.BEHAVIOUR_RULES, rule_sets.TOTAL_RULES, run_date()))


def _people(flags: DataFrame) -> DataFrame:
    """The profile columns of the flags table."""
    return flags.select("user_id", "segment", "nation", "balance", "is_lead")


def _stats(spark, d) -> DataFrame:
    return A.run_rules(_flags(spark, d), NAMES)


def _hits(spark, d) -> DataFrame:
    return R.matches(_flags(spark, d), NAMES)


# ── rules and lift ─────────────────────────────────────────────────────────


def d1_rule_lift(spark, d):
    return _stats(spark, d)


def a12_builtin_rules(spark, d):
    return A.derived_events(_flags(spark, d), NAMES, raw_events(spark, d)).select("user_id", "derived_event_type", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"))


def r13_rule_batch(spark, d):
    """Rules of every kind of atom over shared passes."""
    derived = A.derived_events(_flags(spark, d), NAMES, raw_events(spark, d))
    rules = {
        "exists": {"raw": "ad_click", "stat": "exists"},
        "where": {"raw": "view_car_detail", "stat": "count", "op": ">=", "value": 2, "where": [("brand", "=", "b3")]},
        "days": {"raw": "view_loan_calc", "stat": "days", "op": ">=", "value": 2},
        "dwell": {"raw": "search_general", "stat": "dur_max", "op": ">", "value": 1000.0},
        "distinct": {"raw": "view_car_detail", "stat": "distinct", "attr": "brand", "op": ">=", "value": 3},
        "contains": {"raw": "view_car_compare", "stat": "contains", "value": "m7"},
        "before": {"before": ("view_short_video", "ad_click")},
        "same": {"same": ("view_car_detail", "brand", "view_floor_price", "brand")},
        "profile": {"all": [{"profile": "segment", "op": "in", "value": ["BUILDING", "MACHINERY"]}, {"not": {"raw": "test_drive", "stat": "exists"}}]},
        "event": {"any": [{"event": "map_app_power_user", "stat": "exists"}, {"event": "high_freq_search", "stat": "count", "op": ">=", "value": 1}]},
        "since": {"event": "ad_click_user", "stat": "days_since", "op": "<=", "value": 21},
    }
    return R.matches(R.rule_frame(profile(spark, d), rules, raw_events(spark, d), derived, run_date()), list(rules))


R13_SQL = (
    FLAGS
    + f""", u AS (SELECT profile.user_id, ANY_VALUE(segment) AS segment,
  COUNT(*) FILTER (event_type = 'ad_click') > 0 AS "exists",
  COUNT(*) FILTER (event_type = 'view_car_detail' AND brand = 'b3') >= 2 AS "where",
  COUNT(DISTINCT CASE WHEN event_type = 'view_loan_calc' THEN CAST(event_time AS DATE) END) >= 2 AS days,
  MAX(dwell) FILTER (event_type = 'search_general') > 1000 AS dwell,
  COUNT(DISTINCT CASE WHEN event_type = 'view_car_detail' THEN brand END) >= 3 AS "distinct",
  COUNT(*) FILTER (event_type = 'view_car_compare' AND model = 'm7') > 0 AS "contains",
  MAX(event_time) FILTER (event_type = 'view_short_video') < MIN(event_time) FILTER (event_type = 'ad_click') AS "before",
  len(list_intersect(COALESCE(list(brand) FILTER (event_type = 'view_car_detail' AND brand IS NOT NULL), []), COALESCE(list(brand) FILTER (event_type = 'view_floor_price' AND brand IS NOT NULL), []))) > 0 AS same,
  ANY_VALUE(segment) IN ('BUILDING', 'MACHINERY') AND COUNT(*) FILTER (event_type = 'test_drive') = 0 AS profile
  FROM profile JOIN raw USING (user_id) GROUP BY profile.user_id)
SELECT user_id, rule FROM (UNPIVOT (SELECT user_id, CAST("exists" AS INT) AS "exists", CAST("where" AS INT) AS "where", CAST(days AS INT) AS days, CAST(dwell AS INT) AS dwell, CAST("distinct" AS INT) AS "distinct",
  CAST("contains" AS INT) AS "contains", CAST("before" AS INT) AS "before", CAST(same AS INT) AS same, CAST(profile AS INT) AS profile FROM u) ON COLUMNS(* EXCLUDE user_id) INTO NAME rule VALUE v) WHERE v = 1
UNION ALL SELECT DISTINCT user_id, 'event' FROM hit WHERE rule IN ('map_app_power_user', 'high_freq_search')
UNION ALL SELECT user_id, 'since' FROM hit JOIN last USING (user_id) WHERE rule = 'ad_click_user' AND DATE '{RUN_DATE}' - CAST(event_time AS DATE) <= 21"""
)


def u3_audience_algebra(spark, d):
    rules = {
        "both": {"all": [{"raw": "ad_click"}, {"raw": "test_drive"}]},
        "either": {"any": [{"raw": "ad_click"}, {"raw": "test_drive"}]},
        "neither": {"not": {"any": [{"raw": "ad_click"}, {"raw": "test_drive"}]}},
    }
    f = R.rule_frame(profile(spark, d), rules, raw_events(spark, d))
    return R.matches(f, list(rules)).groupBy("rule").agg(F.count("*").alias("users"))


def u4_bitmap_audiences(spark, d):
    maps = R.bitmaps(_hits(spark, d), "rule")
    either = R.combined(maps, "rule", ["ad_click_user", "test_drive_user"]).withColumn("rule", F.lit("ad_click_user OR test_drive_user"))
    both = R.combined(maps, "rule", ["ad_click_user", "test_drive_user"], "and").withColumn("rule", F.lit("ad_click_user AND test_drive_user"))
    return R.bitmap_sizes(maps.unionByName(either).unionByName(both), "rule")


#: Kinds of events whose users the batch of rules combines.
_KINDS = ["ad_click", "test_drive", "view_car_detail", "view_car_compare", "view_floor_price", "view_loan_calc", "view_short_video", "search_general", "pass_dealership", "map_app_use"]
_BATCH = {
    name: rule
    for i, k in enumerate(_KINDS)
    for other in [_KINDS[(i + 3) % len(_KINDS)]]
    for name, rule in {
        f"{k} not {other}": {"all": [{"raw": k}, {"not": {"raw": other}}]},
        f"{k} or {other}": {"any": [{"raw": k}, {"raw": other}]},
        f"neither {k} nor {other}": {"not": {"any": [{"raw": k}, {"raw": other}]}},
    }.items()
}


def u4_bitmap_rules(spark, d):
    """Thirty rules with AND, OR and NOT on bitmaps of users known by text ids."""
    named = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    maps, _ = BM.bitmap_rules(profile(spark, d).withColumn("user_id", named), _BATCH, raw_events(spark, d).withColumn("user_id", named))
    return maps.groupBy("rule").agg(F.sum("users").alias("users"))


def d2_segments(spark, d):
    """Segments made of rules: a segment of a rule's users has the rule's lift."""
    return A.run_rules(_flags(spark, d), NAMES).select(F.concat(F.lit("seg_"), "rule").alias("segment"), "users", "support", "rate", "tgi")


def a2_lift_matrix(spark, d):
    return L.lift_of_flags(_flags(spark, d), NAMES, "segment", label="event")


def a1_baseline(spark, d):
    return L.baseline(profile(spark, d))


def a6_split_stats(spark, d):
    return L.baseline(L.hash_split(profile(spark, d), "user_id", "is_lead"), "split")


def a4_predicate_lift(spark, d):
    p = L.hash_split(profile(spark, d), "user_id", "is_lead")
    return L.predicate_lift(p, R.conditions([("balance", ">", 4000.0), ("segment", "in", ["BUILDING", "FURNITURE"])]), "split")


_SPLIT = """, numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY is_lead ORDER BY md5('split:' || user_id), user_id) AS r, COUNT(*) OVER (PARTITION BY is_lead) AS n FROM profile),
parts AS (SELECT *, CASE WHEN r <= GREATEST(1, FLOOR(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM numbered)"""


def a7_field_distribution(spark, d):
    return L.field_distribution(profile(spark, d), ["segment", "nation", "is_lead"], 50)


def a8_profile_all_fields(spark, d):
    return L.field_distribution(raw_events(spark, d), ["event_type", "brand", "model"], 20)


def a10_event_distribution(spark, d):
    return L.event_distribution(raw_events(spark, d), profile(spark, d))


def d3_causal_check(spark, d):
    f = _flags(spark, d)
    pairs = spark.createDataFrame([(n,) for n in NAMES], "event string").crossJoin(F.broadcast(f.select("segment").distinct()))
    return L.causal_check(pairs, R.matches(f, NAMES).withColumnRenamed("rule", "event"), f.select("user_id", "segment"), _people(f))


D3_SQL = (
    FLAGS
    + """, seg AS (SELECT DISTINCT segment FROM profile), r AS (SELECT DISTINCT rule AS event FROM (SELECT unnest(["""
    + ", ".join(f"'{n}'" for n in RULE_SQL)
    + """]) AS rule)), x AS (
  SELECT event, seg.segment, COALESCE(AVG(p.is_lead) FILTER (h.user_id IS NOT NULL), 0) AS a, COALESCE(AVG(p.is_lead) FILTER (h.user_id IS NULL), 0) AS b,
         COALESCE(AVG(p.is_lead) FILTER (h.user_id IS NOT NULL AND p.segment = seg.segment), 0) AS c, COALESCE(AVG(p.is_lead) FILTER (h.user_id IS NULL AND p.segment = seg.segment), 0) AS e
  FROM r, seg, profile p LEFT JOIN hit h ON h.user_id = p.user_id AND h.rule = event GROUP BY event, seg.segment)
SELECT event, segment, ROUND(a, 6) AS with_rate, ROUND(b, 6) AS without_rate, ROUND(c, 6) AS segment_with_rate, ROUND(e, 6) AS segment_without_rate,
       CASE WHEN a - b < 0.05 THEN 'weak' WHEN c - e < 0.03 AND e > 0 THEN 'confounded' ELSE 'causal' END AS verdict FROM x"""
)


def _split_lift(spark, d) -> list[DataFrame]:
    """Lift in each part, of the users of that part."""
    parts = L.lift_of_flags(L.hash_split(_flags(spark, d), "user_id", "is_lead", 0.4), NAMES, "split", within=True)
    return [parts.where(F.col("split") == s).drop("split") for s in ("train", "val")]


def d11_stability(spark, d):
    return L.stability(*_split_lift(spark, d))


def d10_generalisation(spark, d):
    return L.generalisation(*_split_lift(spark, d), threshold=100)


_SPLIT_LIFT = (
    FLAGS
    + _SPLIT.replace("0.2", "0.4")
    + """, sb AS (SELECT split, AVG(is_lead) AS base FROM parts GROUP BY split),
t AS (SELECT split, rule, COUNT(*) AS users, ROUND(AVG(parts.is_lead) / ANY_VALUE(base) * 100, 4) AS tgi FROM hit JOIN parts USING (user_id) JOIN sb USING (split) GROUP BY split, rule),
tv AS (SELECT a.rule, a.tgi AS train_tgi, b.tgi AS val_tgi, b.users AS val_users FROM (SELECT * FROM t WHERE split = 'train') a LEFT JOIN (SELECT * FROM t WHERE split = 'val') b USING (rule))"""
)


def d4_candidate_check(spark, d):
    f = _flags(spark, d)
    hits = R.matches(f, NAMES).withColumnRenamed("rule", "event")
    seg = f.select("user_id", F.concat(F.lit("seg_"), F.when(F.col("segment") == "BUILDING", "ad_click_user").otherwise(F.col("segment"))).alias("segment"))
    pairs = spark.createDataFrame([(n,) for n in [*NAMES, "no_such_event"]], "event string").crossJoin(seg.select("segment").distinct())
    pairs = pairs.distinct().withColumn("candidate", F.lit(1))
    pairs = pairs.union(pairs.where("event = 'test_drive_user'").withColumn("candidate", F.lit(2)))
    nodes = hits.select(F.col("event").alias("name")).union(seg.select("segment"))
    p = _people(f)
    return A.check_candidates(pairs, L.lift_matrix(seg, hits, p), L.causal_check(pairs.where("candidate = 1"), hits, seg, p), nodes, 100)


def d7_import_gate(spark, d):
    rules = spark.createDataFrame([(n, "" if i % 9 == 8 else "text") for i, n in enumerate(NAMES)], "name string, rule_text string")
    known = spark.createDataFrame([("ad_click_user",), ("test_drive_user",)], "name string")
    return A.gate(rules, _stats(spark, d), 60, known)


def d8_publish(spark, d):
    s = _stats(spark, d)
    kind = F.when(F.length("rule") % 2 == 0, "behaviour").otherwise("need")
    state = F.when(F.length("rule") % 5 == 0, "published").otherwise("draft")
    return A.publish(s.select("rule", "tgi", kind.alias("kind"), state.alias("status")))


def d9_merge_rules(spark, d):
    s = _stats(spark, d).select(F.col("rule").alias("src"), F.lit("lead").alias("dst"), F.lit("Triggers_Need").alias("type"), "tgi")
    return A.merge_rules(s.where(F.length("src") % 3 > 0).withColumn("tgi", F.col("tgi") - 1), s.where(F.length("src") % 3 < 2))


def t4_top_rules(spark, d):
    return _stats(spark, d).orderBy(F.desc("tgi"), "rule").limit(10)


# ── scores and plans ───────────────────────────────────────────────────────

#: Needs over the built-in rules, for the given tables.
NEEDS = {
    "need_space": (["detail_view_user", "car_compare_user"], 0.85),
    "need_price": (["loan_calc_user", "floor_price_user", "multi_ad_click"], 0.9),
    "need_tech": (["high_freq_search", "multi_brand_search"], 0.7),
    "need_travel": (["map_app_power_user", "rental_car_user"], 0.8),
    "need_drive": (["test_drive_user", "pass_dealership_intent"], 0.75),
}
_NEED_ROWS = [(n, a) for n, (acts, _) in NEEDS.items() for a in acts]
_SAT = {"detail_view_user": 5, "loan_calc_user": 2, "map_app_power_user": 10, "test_drive_user": 1}


def _need_frames(spark, d):
    """Derived events (stored: they are read for counts, times and memberships), the needs' actions, members, and people."""
    f = _flags(spark, d)
    hits = stored(A.derived_events(f, NAMES, raw_events(spark, d)))
    acts = spark.createDataFrame(_NEED_ROWS, "need_name string, action string")
    members = hits.join(F.broadcast(acts.withColumnRenamed("action", "derived_event_type")), "derived_event_type").select("need_name", "user_id").distinct()
    return hits, acts, members, _people(f)


def d6_need_scores_rules(spark, d):
    hits, acts, members, people = _need_frames(spark, d)
    sat = spark.createDataFrame(list(_SAT.items()), "action string, saturation int")
    return S.rule_scores(members, people, acts, sat, hits, run_date())


_NEED_SQL = ", acts(need_name, action) AS (VALUES " + ", ".join(f"('{n}', '{a}')" for n, a in _NEED_ROWS) + "), sat(action, saturation) AS (VALUES " + ", ".join(f"('{a}', {s})" for a, s in _SAT.items()) + f"""),
members AS (SELECT DISTINCT need_name, user_id FROM hit JOIN acts ON rule = action),
cover AS (SELECT need_name, COUNT(*) AS users, AVG(is_lead) AS rate, AVG(is_lead) / ANY_VALUE(base) * 100 AS tgi, GREATEST(LN(ANY_VALUE(total) / COUNT(*)), 0.01) AS specificity FROM members JOIN profile USING (user_id), base GROUP BY need_name),
seen AS (SELECT user_id, rule AS action, 1 AS hits, GREATEST(DATE '{RUN_DATE}' - CAST(event_time AS DATE), 0) AS days FROM hit JOIN last USING (user_id)),
ful AS (SELECT m.user_id, m.need_name, AVG(LEAST(COALESCE(hits, 0) / COALESCE(saturation, 3), 1.0)) AS ful, MIN(COALESCE(days, 30)) AS days
  FROM members m JOIN acts USING (need_name) LEFT JOIN sat USING (action) LEFT JOIN seen s ON s.user_id = m.user_id AND s.action = acts.action GROUP BY 1, 2),
sc AS (SELECT user_id, need_name, tgi, specificity, CAST(tgi < 60 AS INT) AS ex, CASE WHEN tgi < 60 THEN 0 ELSE ful END AS ful, CASE WHEN tgi < 60 THEN 0 ELSE EXP(-LN(2) / 7 * days) END AS td,
  CASE WHEN tgi < 60 THEN -specificity ELSE ful * EXP(-LN(2) / 7 * days) * specificity END AS raw_score FROM ful JOIN cover USING (need_name)),
scores AS (SELECT user_id, need_name, ROUND(raw_score, 6) AS raw_score, ROUND(EXP(raw_score - MAX(raw_score) OVER u) / SUM(EXP(raw_score - mx)) OVER u, 6) AS normalized_score,
  CAST(ex = 0 AND ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ex, raw_score DESC, need_name) = 1 AS INT) AS dominant_flag, ex AS exclusion_flag,
  ROUND(ful, 4) AS fulfillment, ROUND(td, 4) AS time_decay, ROUND(specificity, 4) AS specificity, ROUND(tgi, 1) AS tgi
  FROM (SELECT *, MAX(raw_score) OVER (PARTITION BY user_id) AS mx FROM sc) WINDOW u AS (PARTITION BY user_id))"""


def a27_need_coverage(spark, d):
    _, _, members, people = _need_frames(spark, d)
    c = S.need_coverage(members, people)
    return c.select("need_name", "users", F.round("rate", 6).alias("rate"), F.round("tgi", 4).alias("tgi"), "tier", F.round("specificity", 6).alias("specificity"))


def a28_action_hits(spark, d):
    return S.action_hits(A.derived_events(_flags(spark, d), NAMES, raw_events(spark, d)), run_date())


def a32_need_report(spark, d):
    return S.need_report(d6_need_scores_rules(spark, d))


_EDGES = [(a, n, 0.5 + 0.1 * i, 100.0 + 15 * i) for i, (n, a) in enumerate(_NEED_ROWS)]


def _graph(spark, d):
    edges = spark.createDataFrame(_EDGES, "event string, need_name string, weight double, tgi double")
    comp = spark.createDataFrame([("need_space", 1.2), ("need_price", 0.8)], "need_name string, score double")
    hits, _, _, people = _need_frames(spark, d)
    return S.graph_scores(edges, people, hits, run_date(), comp)


def d5_need_scores_graph(spark, d):
    return _graph(spark, d)


_GRAPH_SQL = ", edges(event, need_name, weight, tgi) AS (VALUES " + ", ".join(f"('{e}', '{n}', CAST({w!r} AS DOUBLE), CAST({t!r} AS DOUBLE))" for e, n, w, t in _EDGES) + f"""), comp(need_name, score) AS (VALUES ('need_space', 1.2::DOUBLE), ('need_price', 0.8::DOUBLE)),
seen AS (SELECT user_id, rule AS event, GREATEST(DATE '{RUN_DATE}' - CAST(event_time AS DATE), 0) AS days FROM hit JOIN last USING (user_id)),
nn AS (SELECT need_name, COUNT(DISTINCT user_id) AS n FROM edges JOIN seen USING (event) GROUP BY 1),
w0 AS (SELECT need_name, AVG(tgi) * GREATEST(LN(ANY_VALUE(total) / (COALESCE(ANY_VALUE(n), 0) + 1)), 0.1) AS w FROM edges LEFT JOIN nn USING (need_name), base GROUP BY need_name),
w1 AS (SELECT need_name, w / MAX(w) OVER () AS w_base FROM w0),
raws AS (SELECT user_id, need_name, SUM(w_base * weight * EXP(-LN(2) / 7 * days) * COALESCE(score, 1)) AS raw_score FROM seen JOIN edges USING (event) JOIN w1 USING (need_name) LEFT JOIN comp USING (need_name) GROUP BY 1, 2),
gs AS (SELECT user_id, need_name, ROUND(raw_score, 6) AS raw_score, ROUND(EXP(raw_score - mx) / SUM(EXP(raw_score - mx)) OVER (PARTITION BY user_id), 6) AS normalized_score,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY raw_score DESC, need_name) = 1 AS INT) AS dominant_flag, 0 AS exclusion_flag FROM (SELECT *, MAX(raw_score) OVER (PARTITION BY user_id) AS mx FROM raws))"""


def d26_exclusions(spark, d):
    """Exclusion audiences of rules taken as needs."""
    hits, _, _, people = _need_frames(spark, d)
    m = hits.select(F.col("derived_event_type").alias("need_name"), "user_id")
    cover = S.need_coverage(m, people).where(F.col("tgi") < 95).select("need_name", "users", F.round("tgi", 4).alias("tgi"))
    return cover


def _intent(spark, d):
    f = _flags(spark, d)
    h = R.matches(f, NAMES)
    needs = spark.createDataFrame([(n, w) for n, (_, w) in NEEDS.items()], "need_name string, weight double")
    mapped = spark.createDataFrame([(a, n) for n, a in _NEED_ROWS], "rule string, need_name string")
    return stored(S.intents(h, L.lift(h, _people(f)), mapped, needs)), needs


def d12_intents(spark, d):
    return _intent(spark, d)[0]


_INTENT_SQL = (
    STATS
    + ", needs(need_name, weight) AS (VALUES "
    + ", ".join(f"('{n}', CAST({w} AS DOUBLE))" for n, (_, w) in NEEDS.items())
    + "), acts(need_name, action) AS (VALUES "
    + ", ".join(f"('{n}', '{a}')" for n, a in _NEED_ROWS)
    + """), mapped AS (SELECT rule, tgi, COALESCE(need_name, 'need_price') AS need_name FROM stats LEFT JOIN acts ON action = rule),
intent AS (SELECT user_id, need_name, ROUND(SUM(weight * tgi / 100), 4) AS score FROM hit JOIN mapped USING (rule) JOIN needs USING (need_name) GROUP BY 1, 2),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, need_name) AS r FROM intent),
totals AS (SELECT user_id, ROUND(SUM(score), 4) AS total, MAX(need_name) FILTER (r = 1) AS need_name FROM ranked GROUP BY user_id),
top AS (SELECT * FROM totals ORDER BY total DESC, user_id LIMIT 100)"""
)


def t3_top_users(spark, d):
    return S.top_users(_intent(spark, d)[0], 100)


def d13_audience_plan(spark, d):
    intent, needs = _intent(spark, d)
    return S.audience_plan(S.top_users(intent, 100), needs, 100_000.0, 0.05, 110.0)


_PLAN_SQL = """, plan AS (SELECT need_name, COUNT(*) AS users, ROUND(AVG(total), 4) AS avg_score, ANY_VALUE(weight) AS weight FROM top JOIN needs USING (need_name) GROUP BY need_name),
pl AS (SELECT need_name, users, avg_score, ROUND(100000.0::DOUBLE * (weight / SUM(weight) OVER ()), 2) AS budget, CAST(ROUND(100000.0::DOUBLE * (weight / SUM(weight) OVER ()) / 50.0::DOUBLE * 1000, 0) AS BIGINT) AS reach, ROUND(users * 0.05::DOUBLE * 110.0::DOUBLE / 100, 4) AS conversions FROM plan)"""


def w13_percentiles(spark, d):
    return S.score_percentiles(S.top_users(_intent(spark, d)[0], 10_000))


def _groups(spark, d):
    return d13_audience_plan(spark, d).select("need_name", "budget").crossJoin(spark.createDataFrame([("sedan",), ("suv",)], "item string"))


def d14_placements(spark, d):
    rules = spark.createDataFrame(
        [(1, "price", [("feed", 0.6), ("search", 0.3), ("video", 0.1)]), (2, "t", [("video", 0.5), ("feed", 0.3), ("search", 0.2)]), (9, "", [("feed", 0.4), ("video", 0.4), ("search", 0.2)])],
        "priority int, keyword string, shares array<struct<placement:string,share:double>>",
    )
    return S.placements(_groups(spark, d), rules)


D14_SQL = FLAGS + _INTENT_SQL + _PLAN_SQL + """, pr(priority, keyword, placement, share) AS (VALUES (1,'price','feed',0.6::DOUBLE),(1,'price','search',0.3::DOUBLE),(1,'price','video',0.1::DOUBLE),(2,'t','video',0.5::DOUBLE),(2,'t','feed',0.3::DOUBLE),(2,'t','search',0.2::DOUBLE),(9,'','feed',0.4::DOUBLE),(9,'','video',0.4::DOUBLE),(9,'','search',0.2::DOUBLE)),
fst AS (SELECT need_name, MIN(priority) AS priority FROM pl, pr WHERE contains(need_name, keyword) GROUP BY 1)
SELECT item, need_name, placement, ROUND(budget * share, 2) AS budget, CAST(ROUND(budget * share / 50.0::DOUBLE * 1000, 0) AS BIGINT) AS reach FROM pl JOIN fst USING (need_name) JOIN pr USING (priority), (VALUES ('sedan'), ('suv')) i(item)"""


def d15_creatives(spark, d):
    themes = spark.createDataFrame([("need_space", "BUILDING"), ("need_price", "MACHINERY"), ("need_tech", "AUTO"), ("need_drive", "HOUSE")], "need_name string, theme string")
    library = table(spark, d, "customer").select(F.col("c_custkey").alias("creative_id"), F.col("c_mktsegment").alias("text"))
    return S.creatives(_groups(spark, d), themes, library)


D15_SQL = FLAGS + _INTENT_SQL + _PLAN_SQL + """, th(need_name, theme) AS (VALUES ('need_space','BUILDING'),('need_price','MACHINERY'),('need_tech','AUTO'),('need_drive','HOUSE')),
m AS (SELECT DISTINCT item, need_name, c_custkey AS creative_id FROM pl JOIN th USING (need_name) JOIN customer ON contains(c_mktsegment, theme), (VALUES ('sedan'), ('suv')) i(item))
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item, need_name ORDER BY creative_id) AS place FROM m) WHERE place <= 3"""


def d25_chains(spark, d):
    hits, acts, members, people = _need_frames(spark, d)
    sat = spark.createDataFrame(list(_SAT.items()), "action string, saturation int")
    scores = S.rule_scores(members, people, acts, sat, hits, run_date())
    satisfies = spark.createDataFrame([("suv", "need_space"), ("sedan", "need_price"), ("suv", "need_travel")], "item string, need string")
    return A.audience_chains(acts.select(F.col("need_name").alias("need"), F.col("action").alias("event")), satisfies, hits.select("user_id", F.col("derived_event_type").alias("event")), people, scores)


def d27_edge_conformity(spark, d):
    f = _hits(spark, d).select("rule").distinct()
    nodes = f.select(F.col("rule").alias("name"), F.lit("Event").alias("type")).union(spark.createDataFrame([(n, "Need") for n in NEEDS], "name string, type string"))
    edges = f.select(F.col("rule").alias("src"), F.when(F.length("rule") % 4 == 0, "need_space").when(F.length("rule") % 4 == 1, "nowhere").when(F.length("rule") % 4 == 2, "ad_click_user").otherwise("need_price").alias("dst"), F.when(F.length("rule") % 7 == 0, "Likes").otherwise("Triggers_Need").alias("type"))
    legal = spark.createDataFrame([("Triggers_Need", "Event", "Need"), ("Satisfied_By", "Need", "Item")], "type string, src_type string, dst_type string")
    return A.edge_conformity(edges, nodes, legal)


D27_SQL = FLAGS + """, ev AS (SELECT DISTINCT rule FROM hit)
SELECT src, dst, type, CASE WHEN type = 'Likes' THEN 'unknown type' WHEN dst = 'nowhere' THEN 'unknown end' WHEN dst = 'ad_click_user' THEN 'illegal ends' ELSE 'ok' END AS status
FROM (SELECT rule AS src, CASE length(rule) % 4 WHEN 0 THEN 'need_space' WHEN 1 THEN 'nowhere' WHEN 2 THEN 'ad_click_user' ELSE 'need_price' END AS dst, CASE WHEN length(rule) % 7 = 0 THEN 'Likes' ELSE 'Triggers_Need' END AS type FROM ev)"""


def j18_leaf_needs(spark, d):
    _, _, members, _ = _need_frames(spark, d)
    h = spark.createDataFrame([("need_price", "need_space"), ("need_drive", "need_travel")], "sub string, super string")
    return A.leaf_classes(members.select("user_id", F.col("need_name").alias("need")), h)


def u5_new_needs(spark, d):
    """Needs a later run adds: rules over all events against rules over the first half of them."""
    e = raw_events(spark, d)
    early = A.behaviour_flags(profile(spark, d), e.where(F.col("event_time") < F.lit("2024-01-10").cast("timestamp")), rule_sets.BEHAVIOUR_RULES, rule_sets.TOTAL_RULES, run_date())
    return _hits(spark, d).join(R.matches(early, NAMES), ["user_id", "rule"], "left_anti")


QUERIES = {f.__name__: f for f in (d1_rule_lift, a12_builtin_rules, r13_rule_batch, u3_audience_algebra, u4_bitmap_audiences, u4_bitmap_rules, d2_segments, a2_lift_matrix, a1_baseline, a6_split_stats, a4_predicate_lift, a7_field_distribution, a8_profile_all_fields, a10_event_distribution, d3_causal_check, d11_stability, d10_generalisation, d4_candidate_check, d7_import_gate, d8_publish, d9_merge_rules, t4_top_rules, d6_need_scores_rules, a27_need_coverage, a28_action_hits, a32_need_report, d5_need_scores_graph, d26_exclusions, d12_intents, t3_top_users, d13_audience_plan, w13_percentiles, d14_placements, d15_creatives, d25_chains, d27_edge_conformity, j18_leaf_needs, u5_new_needs)}

_EARLY = FLAGS.replace("JOIN raw USING (user_id) GROUP BY profile.user_id", "LEFT JOIN (SELECT * FROM raw WHERE event_time < TIMESTAMP '2024-01-10') raw USING (user_id) GROUP BY profile.user_id")

D4_SQL = (
    D3_SQL[: D3_SQL.index("\nSELECT event")]
    .replace("AS (SELECT DISTINCT segment FROM profile)", "AS (SELECT DISTINCT segment FROM prof)")
    .replace(", seg AS", ", prof AS (SELECT * REPLACE ('seg_' || CASE segment WHEN 'BUILDING' THEN 'ad_click_user' ELSE segment END AS segment) FROM profile), seg AS")
    .replace("FROM r, seg, profile p", "FROM r, seg, prof p")
    + """, m AS (SELECT segment, rule AS event, ROUND(AVG(hit.is_lead) / ANY_VALUE(base) * 100, 4) AS tgi FROM hit JOIN prof USING (user_id), base GROUP BY 1, 2),
c AS (SELECT event, segment, 1 AS candidate FROM r, seg UNION ALL SELECT 'no_such_event', segment, 1 FROM seg UNION ALL SELECT 'test_drive_user', segment, 2 FROM seg)
SELECT candidate, event, segment, tgi, CASE WHEN event NOT IN (SELECT rule FROM hit) THEN 'unknown end' WHEN segment = 'seg_' || event THEN 'self-referring' WHEN COALESCE(tgi, 0) < 100 THEN 'low lift'
  WHEN candidate > 1 THEN 'duplicate' WHEN a - b < 0.05 THEN 'warning: weak' WHEN c.c2 THEN 'warning: confounded' ELSE 'confirmed' END AS reason
FROM (SELECT c.*, x.a, x.b, x.c - x.e < 0.03 AND x.e > 0 AS c2 FROM c LEFT JOIN x USING (event, segment)) c LEFT JOIN m USING (event, segment)"""
)

ORACLE = {
    "d4_candidate_check": D4_SQL,
    "d1_rule_lift": FLAGS + STATS + " SELECT * FROM stats",
    "a12_builtin_rules": FLAGS + " SELECT user_id, rule AS derived_event_type, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM hit JOIN last USING (user_id)",
    "r13_rule_batch": R13_SQL,
    "u3_audience_algebra": f"WITH {SQL}, f AS (SELECT profile.user_id, COUNT(*) FILTER (event_type = 'ad_click') > 0 AS a, COUNT(*) FILTER (event_type = 'test_drive') > 0 AS b FROM profile JOIN raw USING (user_id) GROUP BY 1) SELECT * FROM (SELECT 'both' AS rule, COUNT(*) FILTER (a AND b) AS users FROM f UNION ALL SELECT 'either', COUNT(*) FILTER (a OR b) FROM f UNION ALL SELECT 'neither', COUNT(*) FILTER (NOT (a OR b)) FROM f) WHERE users > 0",
    "u4_bitmap_rules": f"WITH {SQL}, f AS (SELECT profile.user_id, " + ", ".join(f"COALESCE(BOOL_OR(event_type = '{k}'), FALSE) AS {k}" for k in _KINDS) + " FROM profile LEFT JOIN raw USING (user_id) GROUP BY 1) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k} not {o}' AS rule, COUNT(*) FILTER ({k} AND NOT {o}) AS users FROM f UNION ALL SELECT '{k} or {o}', COUNT(*) FILTER ({k} OR {o}) FROM f UNION ALL SELECT 'neither {k} nor {o}', COUNT(*) FILTER (NOT ({k} OR {o})) FROM f" for i, k in enumerate(_KINDS) for o in [_KINDS[(i + 3) % len(_KINDS)]]) + ") WHERE users > 0",
    "u4_bitmap_audiences": FLAGS + " SELECT rule, COUNT(*) AS users FROM hit GROUP BY 1 UNION ALL SELECT 'ad_click_user OR test_drive_user', COUNT(DISTINCT user_id) FROM hit WHERE rule IN ('ad_click_user','test_drive_user') UNION ALL SELECT 'ad_click_user AND test_drive_user', COUNT(*) FROM (SELECT user_id FROM hit WHERE rule IN ('ad_click_user','test_drive_user') GROUP BY 1 HAVING COUNT(*) = 2)",
    "d2_segments": FLAGS + STATS + " SELECT 'seg_' || rule AS segment, users, support, rate, tgi FROM stats",
    "a2_lift_matrix": FLAGS + " SELECT segment, rule AS event, COUNT(*) AS users, ROUND(COUNT(*) / ANY_VALUE(total), 6) AS support, ROUND(AVG(hit.is_lead), 6) AS rate, ROUND(AVG(hit.is_lead) / ANY_VALUE(base) * 100, 4) AS tgi FROM hit JOIN profile USING (user_id), base GROUP BY 1, 2",
    "a1_baseline": f"WITH {SQL} SELECT COUNT(*) AS users, CAST(SUM(is_lead) AS BIGINT) AS leads, ROUND(AVG(is_lead), 6) AS rate FROM profile",
    "a6_split_stats": f"WITH {SQL}{_SPLIT} SELECT split, COUNT(*) AS users, CAST(SUM(is_lead) AS BIGINT) AS leads, ROUND(AVG(is_lead), 6) AS rate FROM parts GROUP BY split",
    "a4_predicate_lift": f"WITH {SQL}{_SPLIT}, q AS (SELECT *, balance > 4000 AND segment IN ('BUILDING','FURNITURE') AS p FROM parts) SELECT split, CAST(SUM(CAST(p AS INT)) AS BIGINT) AS hits, ROUND(AVG(CAST(p AS INT)), 6) AS support, ROUND(AVG(is_lead) FILTER (p), 6) AS rate, ROUND(AVG(is_lead) FILTER (p) / AVG(is_lead) * 100, 4) AS tgi FROM q GROUP BY split",
    "a7_field_distribution": f"WITH {SQL}, v AS (SELECT 'segment' AS field, segment AS value FROM profile UNION ALL SELECT 'nation', CAST(nation AS VARCHAR) FROM profile UNION ALL SELECT 'is_lead', CAST(is_lead AS VARCHAR) FROM profile), n AS (SELECT field, value, COUNT(*) AS n FROM v GROUP BY 1, 2) SELECT field, value, n, pct FROM (SELECT *, ROUND(n * 100 / SUM(n) OVER (PARTITION BY field), 4) AS pct, ROW_NUMBER() OVER (PARTITION BY field ORDER BY n DESC, value NULLS FIRST) AS r FROM n) WHERE r <= 50",
    "a8_profile_all_fields": f"WITH {SQL}, v AS (SELECT 'event_type' AS field, event_type AS value FROM raw UNION ALL SELECT 'brand', brand FROM raw UNION ALL SELECT 'model', model FROM raw), n AS (SELECT field, value, COUNT(*) AS n FROM v GROUP BY 1, 2) SELECT field, value, n, pct FROM (SELECT *, ROUND(n * 100 / SUM(n) OVER (PARTITION BY field), 4) AS pct, ROW_NUMBER() OVER (PARTITION BY field ORDER BY n DESC, value NULLS FIRST) AS r FROM n) WHERE r <= 20",
    "a10_event_distribution": f"WITH {SQL}, n AS (SELECT event_type, COUNT(*) AS events, ROUND(AVG(dwell), 4) AS avg_dwell, ROUND(MAX(dwell), 4) AS max_dwell FROM raw GROUP BY 1), u AS (SELECT event_type, COUNT(*) AS users, ROUND(AVG(is_lead), 6) AS rate FROM (SELECT DISTINCT event_type, user_id FROM raw) JOIN profile USING (user_id) GROUP BY 1) SELECT event_type, events, ROUND(events * 100 / SUM(events) OVER (), 4) AS share, COALESCE(users, 0) AS users, rate, avg_dwell, max_dwell FROM n LEFT JOIN u USING (event_type)",
    "d3_causal_check": D3_SQL,
    "d11_stability": _SPLIT_LIFT + " SELECT rule, train_tgi, val_tgi, CASE WHEN val_tgi IS NULL OR train_tgi <= 0 THEN 'missing' WHEN ABS(val_tgi - train_tgi) / train_tgi <= 0.2 THEN 'stable' ELSE 'unstable' END AS tag FROM tv",
    "d10_generalisation": _SPLIT_LIFT + " SELECT rule, train_tgi, val_tgi, ROUND(ABS(val_tgi - train_tgi), 4) AS change, CASE WHEN COALESCE(val_users, 0) = 0 THEN 'INVALID' WHEN val_tgi < 100 THEN 'FAILED' WHEN ABS(val_tgi - train_tgi) <= 20 THEN 'STABLE' ELSE 'DRIFT' END AS verdict FROM tv",
    "d7_import_gate": FLAGS + STATS + ", r AS (SELECT name, CASE WHEN i % 9 = 0 THEN '' ELSE 'text' END AS t FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in RULE_SQL) + "]) AS name, unnest(range(1, 39)) AS i)) SELECT name, users, tgi, CASE WHEN t = '' THEN 'rejected: missing field' WHEN name IN ('ad_click_user', 'test_drive_user') THEN 'skipped: known' WHEN COALESCE(users, 0) < 60 THEN 'rejected: too few users' ELSE 'accepted' END AS status FROM r LEFT JOIN stats ON rule = name",
    "d8_publish": FLAGS + STATS + ", k AS (SELECT rule, tgi, CASE WHEN length(rule) % 2 = 0 THEN 'behaviour' ELSE 'need' END AS kind, length(rule) % 5 = 0 AS old FROM stats) SELECT rule, tgi, kind, CASE WHEN old OR tgi >= (CASE kind WHEN 'behaviour' THEN 100 ELSE 120 END) THEN 'published' ELSE 'rejected' END AS status FROM k",
    "d9_merge_rules": FLAGS + STATS + " SELECT rule AS src, 'lead' AS dst, 'Triggers_Need' AS type, CASE WHEN length(rule) % 3 < 2 THEN tgi ELSE tgi - 1 END AS tgi, CASE length(rule) % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'updated' ELSE 'kept' END AS change FROM stats",
    "t4_top_rules": FLAGS + STATS + " SELECT * FROM stats ORDER BY tgi DESC, rule LIMIT 10",
    "d6_need_scores_rules": FLAGS + _NEED_SQL + " SELECT * FROM scores",
    "a27_need_coverage": FLAGS + _NEED_SQL + " SELECT need_name, users, ROUND(rate, 6) AS rate, ROUND(tgi, 4) AS tgi, CASE WHEN tgi >= 120 THEN 'meat' WHEN tgi >= 60 THEN 'salt' ELSE 'poison' END AS tier, ROUND(specificity, 6) AS specificity FROM cover",
    "a28_action_hits": FLAGS + f" SELECT user_id, rule AS action, 1 AS hits, GREATEST(DATE '{RUN_DATE}' - CAST(event_time AS DATE), 0) AS days FROM hit JOIN last USING (user_id)",
    "a32_need_report": FLAGS + _NEED_SQL + " SELECT need_name, COUNT(*) AS users, CAST(SUM(dominant_flag) AS BIGINT) AS dominant_users, ROUND(AVG(normalized_score), 4) AS avg_normalized FROM scores GROUP BY 1",
    "d5_need_scores_graph": FLAGS + _GRAPH_SQL + " SELECT * FROM gs",
    "d26_exclusions": FLAGS + STATS + " SELECT rule AS need_name, users, tgi FROM stats WHERE tgi < 95",
    "d12_intents": FLAGS + _INTENT_SQL + " SELECT * FROM intent",
    "t3_top_users": FLAGS + _INTENT_SQL + " SELECT * FROM top",
    "d13_audience_plan": FLAGS + _INTENT_SQL + _PLAN_SQL + " SELECT * FROM pl",
    "w13_percentiles": FLAGS + _INTENT_SQL + ", p AS (SELECT total, ROW_NUMBER() OVER (ORDER BY total DESC, user_id) - 1 AS place, COUNT(*) OVER () AS n FROM (SELECT * FROM totals ORDER BY total DESC, user_id LIMIT 10000)) SELECT share, total FROM p, (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) s(share) WHERE place = FLOOR(n * share)",
    "d14_placements": D14_SQL,
    "d15_creatives": D15_SQL,
    "d25_chains": FLAGS + _NEED_SQL + ", dom AS (SELECT need_name, COUNT(*) AS n FROM scores WHERE dominant_flag = 1 GROUP BY 1), ev AS (SELECT rule, COUNT(*) AS users, ROUND(AVG(is_lead), 6) AS rate, ROUND(AVG(is_lead) / ANY_VALUE(base) * 100, 4) AS tgi FROM hit, base GROUP BY 1) SELECT item, need_name AS need, action AS event, users, rate, tgi, COALESCE(n, 0) AS dominant_users FROM (VALUES ('suv','need_space'),('sedan','need_price'),('suv','need_travel')) s(item, need_name) JOIN acts USING (need_name) JOIN ev ON rule = action LEFT JOIN dom USING (need_name)",
    "d27_edge_conformity": D27_SQL,
    "j18_leaf_needs": FLAGS + _NEED_SQL + " SELECT user_id, need_name AS need FROM members m WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.user_id = m.user_id AND ((x.need_name = 'need_price' AND m.need_name = 'need_space') OR (x.need_name = 'need_drive' AND m.need_name = 'need_travel')))",
    "u5_new_needs": FLAGS.replace(", base AS", ", base0 AS") + ", early AS (SELECT user_id, rule FROM (" + _EARLY + " SELECT * FROM hit)) SELECT user_id, rule FROM hit EXCEPT SELECT user_id, rule FROM early",
}
