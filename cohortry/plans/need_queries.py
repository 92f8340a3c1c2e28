"""Registered queries on need rules and journeys over the given tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import needs as N
from ..sources import files as S
from ..streaming.run import shared_folder
from .driver_tables import table

WORDS = N.NeedWords(pure_ev="ev", plug_in=("phev", "erev"), fuel=("fuel", "erev"), large=("large",), small=("small",), low_end=("low",), high_end=("high",), active=("much",))
CATEGORIES = {"green_plate": "plate", "no_parking": "plate", "plate_free": "plate", "six_seven_seats": "space", "single_commute": "space", "budget_locked": "money", "flexible_budget": "money", "range_anxiety": "range", "long_commute": "range"}

_CITIES = ["北京市", "成都", "合肥", "上海", "武汉市"]
_AGES = [*N.GENERATIONS, "none"]


def _pick(k, values):
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(k % len(values) == i, F.lit(v)).otherwise(out)
    return out


def _pick_sql(k, values):
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def users(spark, d) -> DataFrame:
    """Customers as users with views (their orders' parts), city and age from their keys."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    fuel, ev = N.car_policy(_pick(k, _CITIES))
    u = c.select(
        k.alias("user_id"),
        F.when(k % 6 == 5, N.FUEL_FREE).otherwise(fuel).alias("policy_restriction_fuel"),
        N.generation(_pick(k, _AGES)).alias("generation_group"),
        _pick(k, ["low", "high", "mid"]).alias("device_price_tier"),
        _pick(k, ["much", "little"]).alias("travel_activity"),
        (k % 5).cast("int").alias("inquiry_frequency"),
        _pick(k, ["10-20", "20-30", "未知", ""]).alias("inquiry_price_band"),
        _pick(F.floor(k / 2), ["10-20", "20-30", "未知", ""]).alias("interaction_price_band"),
        F.when(k % 5 > 0, (k % 23).cast("string")).otherwise("far").alias("commute_distance_delta"),
        _pick(k, ["线索", "试驾", "小订", "none"]).alias("conversion_stage"),
    )
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    v = o.select(
        F.col("o_custkey").alias("user_id"),
        _pick(F.floor(key / 7), ["ev", "phev", "fuel", "erev"]).alias("power_type"),
        _pick(F.floor(key / 7), ["SUV", "MPV", "轿车"]).alias("body_type"),
        _pick(F.floor(key / 14), ["10-20", "20-30"]).alias("car_price_band"),
        _pick(F.floor(key / 21), ["small", "large"]).alias("car_size_level"),
    )
    views = v.groupBy("user_id").agg(N.views_array().alias("views"))
    empty = F.array().cast("array<struct<power_type:string,body_type:string,car_price_band:string,car_size_level:string>>")
    return u.join(views, "user_id", "left").withColumn("views", F.coalesce("views", empty))


_FUEL = "CASE WHEN c_custkey % 6 = 5 THEN 'free' WHEN c_custkey % 5 IN (0, 3) THEN 'plate' WHEN c_custkey % 5 IN (1, 4) THEN 'road' ELSE 'unknown' END"
SQL = f"""v AS (SELECT o_custkey AS user_id, {_pick_sql('(o_orderkey // 7)', ['ev', 'phev', 'fuel', 'erev'])} AS power, {_pick_sql('(o_orderkey // 7)', ['SUV', 'MPV', '轿车'])} AS body, {_pick_sql('(o_orderkey // 14)', ['10-20', '20-30'])} AS band, {_pick_sql('(o_orderkey // 21)', ['small', 'large'])} AS size FROM orders),
vw AS (SELECT user_id, COUNT(*) AS n, BOOL_OR(power = 'ev') AS ev, BOOL_OR(power IN ('phev', 'erev')) AS plug, BOOL_OR(power IN ('fuel', 'erev')) AS fuel, BOOL_OR(body = 'MPV' OR body = 'SUV' AND size = 'large') AS big, BOOL_OR(body = '轿车' OR body = 'SUV' AND size = 'small') AS small, COUNT(DISTINCT band) AS bands FROM v GROUP BY 1),
u AS (SELECT c_custkey AS user_id, c_custkey AS k, {_FUEL} AS policy, {_pick_sql('c_custkey', [*N.GENERATIONS.values(), '未来车主'])} AS gen, COALESCE(n, 0) AS n_views, COALESCE(ev, FALSE) AS ev, COALESCE(plug, FALSE) AS plug, COALESCE(fuel, FALSE) AS fuel, COALESCE(big, FALSE) AS big, COALESCE(small, FALSE) AS small, COALESCE(bands, 0) AS bands FROM customer LEFT JOIN vw ON user_id = c_custkey),
nd AS (SELECT *, policy IN ('plate', 'road') AND ev AS green_plate, policy IN ('plate', 'road') AND plug AND NOT ev AS no_parking, policy = 'free' AS plate_free, gen = '中坚家庭' AND big AS six_seven_seats, gen IN ('新锐青年', '年轻新贵') AND small AS single_commute,
  k % 8 = 0 AND k % 3 = 0 AND k % 5 >= 2 AS budget_locked, bands >= 2 AND k % 3 = 1 AS flexible_budget,
  k % 2 = 0 AND fuel AND NOT ev AND NOT (policy IN ('plate', 'road') AND ev) AS range_anxiety, k % 5 > 0 AND k % 23 >= 10 AS long_commute FROM u)"""
_NAMES = list(CATEGORIES)
_LIST = "list_filter([" + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in _NAMES) + "], lambda x: x IS NOT NULL)"
_CATS = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {n} THEN '{c}' END" for n, c in CATEGORIES.items()) + "], lambda x: x IS NOT NULL)))"


def d21_all_needs(spark, d):
    return N.tagged(N.infer_needs(users(spark, d), N.need_rules(WORDS)), N.need_rules(WORDS), CATEGORIES)


def d16_need_rows(spark, d):
    return N.need_rows(N.infer_needs(users(spark, d), N.need_rules(WORDS)), N.need_rules(WORDS))


def a30_label_distribution(spark, d):
    rows = d16_need_rows(spark, d)
    return rows.groupBy("need").agg(F.count("*").alias("users")).join(rows.agg(F.count_distinct("user_id").alias("labelled")))


def s16_label_matrix(spark, d):
    """Fixed columns and one 0/1 column per label."""
    names = list(CATEGORIES)
    i = N.infer_needs(users(spark, d), N.need_rules(WORDS))
    return i.select("user_id", "device_price_tier", *[F.col(n).cast("int").alias(n) for n in names])


def s7_csv_pair(spark, d):
    """Users and views written as a pair of CSV files and read back, views grouped by user."""
    out = shared_folder(spark)
    u = users(spark, d)
    S.write_csv(u.select("user_id", "device_price_tier"), f"{out}/users")
    S.write_csv(u.select("user_id", F.explode("views").alias("v")).select("user_id", "v.*"), f"{out}/cars")
    columns = ["power_type", "body_type", "car_price_band", "car_size_level"]
    pair = S.with_views(S.read_csv(spark, f"{out}/users", ["user_id"]), S.read_csv(spark, f"{out}/cars", ["user_id", *columns]), columns)
    return pair.select(F.col("user_id").cast("long").alias("user_id"), "device_price_tier", F.size("views").alias("n_views"))


def s16_tagged_csv(spark, d):
    """The tagged users written as CSV and read back."""
    out = f"{shared_folder(spark)}/tagged"
    rules, names = N.need_rules(WORDS), list(CATEGORIES)
    inferred = N.infer_needs(users(spark, d), rules)
    fixed = ["generation_group", "commute_distance_delta"]
    S.write_tagged(N.tagged(inferred, rules, CATEGORIES).join(inferred.select("user_id", *fixed, *names), "user_id"), fixed, names, out)
    back = S.read_csv(spark, out, ["user_id", "need_count", "needs", "need_categories", *fixed, *names])
    return back.select(F.col("user_id").cast("long").alias("user_id"), F.col("need_count").cast("int").alias("need_count"), F.coalesce("needs", F.lit("")).alias("needs"), "generation_group", *[F.col(n).cast("int").alias(n) for n in names])


def d22_user_360(spark, d):
    i = N.tagged(N.infer_needs(users(spark, d), N.need_rules(WORDS)), N.need_rules(WORDS), CATEGORIES)
    u = users(spark, d).select("user_id", "device_price_tier", "generation_group", F.size("views").alias("n_views"))
    return u.join(i, "user_id").select("user_id", "device_price_tier", "generation_group", (F.col("n_views") > 0).alias("has_views"), "needs")


def d23_rerun_changed(spark, d):
    rules = N.need_rules(WORDS)
    known = d16_need_rows(spark, d).where("user_id % 3 > 0")
    return N.rerun(users(spark, d), rules, {"license_plate"}, known)


def p11_city_policy(spark, d):
    c = table(spark, d, "customer").select("c_custkey", _pick(F.col("c_custkey"), _CITIES).alias("city"))
    fuel, ev = N.car_policy(F.col("city"))
    return c.select("city", fuel.alias("fuel"), ev.alias("ev")).groupBy("city", "fuel", "ev").agg(F.count("*").alias("n"))


def p12_generation(spark, d):
    c = table(spark, d, "customer").select(_pick(F.col("c_custkey"), _AGES).alias("age"))
    return c.groupBy("age", N.generation(F.col("age")).alias("generation")).agg(F.count("*").alias("n"))


def p28_implied_events(spark, d):
    u = users(spark, d)
    return u.select("user_id", F.array_join(N.implied_events(F.col("conversion_stage"), F.col("inquiry_frequency"), F.size("views")), ",").alias("events"))


JOURNEYS = {"J1": [("E101", 1.0), ("E102", 0.65), ("E202", 0.7), ("E501", 0.5)], "J2": [("E501", 1.0), ("E502", 0.8), ("E503", 0.6)], "J3": [("E003", 1.0), ("E101", 0.72)], "J4": [("E202", 0.9), ("E303", 0.45), ("E401", 0.45), ("E506", 0.55)]}


def d24_journeys(spark, d):
    u = users(spark, d)
    j = spark.createDataFrame([(k, v) for k, v in JOURNEYS.items()], "journey_id string, nodes array<struct<event:string,p:double>>")
    e = u.select("user_id", N.implied_events(F.col("conversion_stage"), F.col("inquiry_frequency"), F.size("views")).alias("events"))
    return N.journey_matches(e, j)


_EVENTS = "list_sort(list_distinct(CASE k % 4 WHEN 0 THEN ['E501','E502','E506'] WHEN 1 THEN ['E501','E502','E503','E505','E401'] WHEN 2 THEN ['E501','E502','E503','E504','E505','E506'] ELSE ['E501'] END || CASE WHEN k % 5 >= 1 THEN ['E202','E303'] ELSE [] END || CASE WHEN n_views >= 1 THEN ['E101','E102','E103'] ELSE [] END))"


def _journey_sql(k, nodes):
    cases = " ".join(
        f"WHEN {' AND '.join(f'''list_contains(ev, '{e}')''' for e, _ in nodes[:i])} THEN " + " * ".join(f"{p}::DOUBLE" for _, p in nodes[:i]) for i in range(len(nodes), 0, -1)
    )
    n = " + ".join(f"CAST(list_contains(ev, '{e}') AS INT)" for e, _ in nodes)
    missing = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT list_contains(ev, '{e}') THEN '{e}' END" for e, _ in nodes) + "], lambda x: x IS NOT NULL), ',')"
    return f"SELECT user_id, '{k}' AS journey_id, ROUND(({n}) / {len(nodes)} * CASE {cases} ELSE 1.0::DOUBLE END, 4) AS score, ROUND(({n}) / {len(nodes)}, 4) AS coverage, {missing} AS missing FROM e"


QUERIES = {f.__name__: f for f in (d21_all_needs, d16_need_rows, a30_label_distribution, s16_label_matrix, s7_csv_pair, s16_tagged_csv, d22_user_360, d23_rerun_changed, p11_city_policy, p12_generation, p28_implied_events, d24_journeys)}

_W = f"WITH {SQL}"
_ROWS = f"SELECT user_id, unnest({_LIST}) AS need FROM nd"
ORACLE = {
    "d21_all_needs": f"{_W} SELECT user_id, array_to_string({_LIST}, '|') AS needs, array_to_string({_CATS}, '|') AS categories, len({_LIST}) AS n_needs FROM nd",
    "d16_need_rows": f"{_W} {_ROWS}",
    "a30_label_distribution": f"{_W}, r AS ({_ROWS}) SELECT need, COUNT(*) AS users, (SELECT COUNT(DISTINCT user_id) FROM r) AS labelled FROM r GROUP BY 1",
    "s16_label_matrix": f"{_W} SELECT user_id, {_pick_sql('k', ['low', 'high', 'mid'])} AS device_price_tier, " + ", ".join(f"CAST({n} AS INT) AS {n}" for n in _NAMES) + " FROM nd",
    "s7_csv_pair": f"{_W}, c AS (SELECT user_id, COUNT(DISTINCT (power, body, band, size)) AS n FROM v GROUP BY 1) SELECT user_id, {_pick_sql('k', ['low', 'high', 'mid'])} AS device_price_tier, COALESCE(n, 0) AS n_views FROM u LEFT JOIN c USING (user_id)",
    "s16_tagged_csv": f"{_W} SELECT user_id, len({_LIST}) AS need_count, array_to_string({_LIST}, '|') AS needs, gen AS generation_group, " + ", ".join(f"CAST({n} AS INT) AS {n}" for n in _NAMES) + " FROM nd",
    "d22_user_360": f"{_W} SELECT user_id, {_pick_sql('k', ['low', 'high', 'mid'])} AS device_price_tier, gen AS generation_group, n_views > 0 AS has_views, array_to_string({_LIST}, '|') AS needs FROM nd",
    "d23_rerun_changed": f"{_W}, r AS ({_ROWS}) SELECT * FROM r WHERE need IN ('green_plate', 'no_parking', 'plate_free', 'range_anxiety') AND user_id % 3 = 0",
    "p11_city_policy": f"WITH c AS (SELECT {_pick_sql('c_custkey', _CITIES)} AS city FROM customer) SELECT city, CASE city WHEN '北京市' THEN '燃油车仅限牌' WHEN '上海' THEN '燃油车仅限牌' WHEN '合肥' THEN '未知' ELSE '燃油车仅限行' END AS fuel, CASE city WHEN '北京市' THEN '新能源车仅限牌' WHEN '上海' THEN '新能源车仅限牌' WHEN '合肥' THEN '未知' ELSE '新能源车无限制' END AS ev, COUNT(*) AS n FROM c GROUP BY 1, 2, 3",
    "p12_generation": f"SELECT {_pick_sql('c_custkey', _AGES)} AS age, {_pick_sql('c_custkey', [*N.GENERATIONS.values(), '未来车主'])} AS generation, COUNT(*) AS n FROM customer GROUP BY 1, 2",
    "p28_implied_events": f"{_W} SELECT user_id, array_to_string({_EVENTS}, ',') AS events FROM u",
    "d24_journeys": f"{_W}, e AS (SELECT user_id, {_EVENTS} AS ev FROM u), s AS (" + " UNION ALL ".join(_journey_sql(k, v) for k, v in JOURNEYS.items()) + ") SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, journey_id) = 1 AS best FROM s WHERE score > 0",
}
