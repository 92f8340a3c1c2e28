"""Need rules of car buyers as columns, rule plug-ins with dependencies, journeys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# City policies, generations and the words of the need rules.
PLATE_CITIES = "北京 上海 广州 深圳 天津 杭州 贵阳 海南".split()
TRAFFIC_CITIES = "成都 重庆 西安 郑州 南京 武汉 石家庄 邢台 保定 廊坊".split()
FUEL_BOTH, FUEL_PLATE, FUEL_ROAD, FUEL_FREE, UNKNOWN = "燃油车限牌限行", "燃油车仅限牌", "燃油车仅限行", "燃油车无限制", "未知"
EV_PLATE, EV_FREE = "新能源车仅限牌", "新能源车无限制"
GENERATIONS = {"18岁以下": "未来车主", "18-23岁": "新锐青年", "24-34岁": "年轻新贵", "35-44岁": "中坚家庭", "45-54岁": "中坚家庭", "55岁以上": "银发群体"}


def generation(age_range: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in GENERATIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, age_range), F.lit("未来车主"))


def car_policy(city: Column) -> tuple[Column, Column]:
    """Fuel and EV policy of a city; suffixes are dropped, cities that no list has are unknown."""
    clean = F.regexp_replace(F.trim(city), "[市省]", "")
    plate, road = clean.isin(PLATE_CITIES), clean.isin(TRAFFIC_CITIES)
    fuel = F.when(plate & road, FUEL_BOTH).when(plate, FUEL_PLATE).when(road, FUEL_ROAD).otherwise(UNKNOWN)
    ev = F.when(plate, EV_PLATE).when(road, EV_FREE).otherwise(UNKNOWN)
    return fuel, ev


@dataclass
class NeedRule:
    """A plug-in: what it needs to have run before, the columns it reads, and its needs as boolean columns."""

    rule_id: str
    build: Callable[[], dict[str, Column]]
    depends_on: list[str] = field(default_factory=list)
    reads: list[str] = field(default_factory=list)
    provides: list[str] = field(default_factory=list)


@dataclass
class NeedWords:
    """The values that the rules compare with."""

    restricted: tuple[str, ...] = (FUEL_BOTH, FUEL_PLATE, FUEL_ROAD)
    free: str = FUEL_FREE
    pure_ev: str = "纯电"
    plug_in: tuple[str, ...] = ("插混", "增程")
    fuel: tuple[str, ...] = ("燃油", "增程")
    families: tuple[str, ...] = ("中坚家庭",)
    young: tuple[str, ...] = ("新锐青年", "年轻新贵")
    mpv: str = "MPV"
    suv: str = "SUV"
    sedan: str = "轿车"
    large: tuple[str, ...] = ("中大型", "大型")
    small: tuple[str, ...] = ("小型", "紧凑型")
    low_end: tuple[str, ...] = ("低端", "中端")
    high_end: tuple[str, ...] = ("高端", "旗舰")
    no_band: tuple[str, ...] = ("未知",)
    active: tuple[str, ...] = ("高", "较高")


def views_array() -> Column:
    """A user's car views as an array of structs, for ``groupBy(user).agg``."""
    return F.collect_set(F.struct("power_type", "body_type", "car_price_band", "car_size_level"))


def need_rules(w: NeedWords = NeedWords()) -> list[NeedRule]:
    """The built-in rules over user columns and ``views`` (array of structs); each need is a boolean column."""
    c = F.col

    def powers() -> Column:
        return F.transform("views", lambda v: v["power_type"])

    def has(*values) -> Column:
        return F.coalesce(F.arrays_overlap(powers(), F.array(*[F.lit(v) for v in values])), F.lit(False))

    def view(test: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.exists("views", lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))

    def truth(x: Column) -> Column:
        return F.coalesce(x, F.lit(False))

    def plate():
        r = truth(c("policy_restriction_fuel").isin(*w.restricted))
        return {
            "green_plate": r & has(w.pure_ev),
            "no_parking": r & has(*w.plug_in) & ~has(w.pure_ev),
            "plate_free": truth(c("policy_restriction_fuel") == w.free),
        }

    def space():
        large = view(lambda v: (v["body_type"] == w.mpv) | ((v["body_type"] == w.suv) & v["car_size_level"].isin(*w.large)))
        small = view(lambda v: (v["body_type"] == w.sedan) | ((v["body_type"] == w.suv) & v["car_size_level"].isin(*w.small)))
        return {"six_seven_seats": truth(c("generation_group").isin(*w.families)) & large, "single_commute": truth(c("generation_group").isin(*w.young)) & small}

    def budget():
        bands = F.array_distinct(F.array_compact(F.transform("views", lambda v: v["car_price_band"])))
        locked = (c("inquiry_price_band") == c("interaction_price_band")) & ~c("inquiry_price_band").isin(*w.no_band) & (c("inquiry_price_band") != "") & c("device_price_tier").isin(*w.low_end) & (c("inquiry_frequency") >= 2)
        return {"budget_locked": truth(locked), "flexible_budget": truth((F.size(bands) >= 2) & c("device_price_tier").isin(*w.high_end))}

    def anxiety():
        return {"range_anxiety": truth(c("travel_activity").isin(*w.active)) & has(*w.fuel) & ~has(w.pure_ev) & ~c("green_plate")}

    def commute():
        return {"long_commute": truth(c("commute_distance_delta").cast("string").try_cast("double") >= 10)}

    views = ["views"]
    return [
        NeedRule("license_plate", plate, [], ["policy_restriction_fuel", *views], ["green_plate", "no_parking", "plate_free"]),
        NeedRule("space", space, [], ["generation_group", *views], ["six_seven_seats", "single_commute"]),
        NeedRule("budget", budget, [], ["inquiry_price_band", "interaction_price_band", "device_price_tier", "inquiry_frequency", *views], ["budget_locked", "flexible_budget"]),
        NeedRule("range_anxiety", anxiety, ["license_plate"], ["travel_activity", *views], ["range_anxiety"]),
        NeedRule("long_commute", commute, [], ["commute_distance_delta"], ["long_commute"]),
    ]


def ordered(rules: list[NeedRule]) -> list[NeedRule]:
    """Rules after all they depend on, else in the given order; a cycle or a missing rule raises ValueError."""
    left, out = list(rules), []
    while left:
        done = {r.rule_id for r in out}
        ready = next((r for r in left if set(r.depends_on) <= done), None)
        if ready is None:
            raise ValueError(f"rules in a cycle or without what they depend on: {sorted(r.rule_id for r in left)}")
        left.remove(ready)
        out.append(ready)
    return out


def infer_needs(users: DataFrame, rules: list[NeedRule] | None = None) -> DataFrame:
    """``users`` with one boolean column per need, rules applied in the order of their dependencies."""
    for r in ordered(need_rules() if rules is None else rules):
        users = users.withColumns(r.build())
    return users


def need_rows(inferred: DataFrame, rules: list[NeedRule], id_col: str = "user_id") -> DataFrame:
    names = [n for r in ordered(rules) for n in r.provides]
    hits = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return inferred.select(id_col, F.explode(hits).alias("need"))


def tagged(inferred: DataFrame, rules: list[NeedRule], categories: dict[str, str], id_col: str = "user_id") -> DataFrame:
    """``(id, needs, categories, n_needs)`` with needs and their categories joined by bars."""
    names = [n for r in ordered(rules) for n in r.provides]
    hits = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    cats = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(n), F.lit(categories.get(n, "other"))) for n in names]))))
    return inferred.select(id_col, F.array_join(hits, "|").alias("needs"), F.array_join(cats, "|").alias("categories"), F.size(hits).alias("n_needs"))


def affected(rules: list[NeedRule], changed: set[str]) -> list[NeedRule]:
    """The changed rules and all that depend on them, and what those depend on, in order."""
    down, order = set(changed), ordered(rules)
    for r in order:
        if set(r.depends_on) & down:
            down.add(r.rule_id)
    need = set(down)
    for r in reversed(order):
        if r.rule_id in need:
            need |= set(r.depends_on)
    return [r for r in order if r.rule_id in need]


def rerun(users: DataFrame, rules: list[NeedRule], changed: set[str], known: DataFrame, id_col: str = "user_id") -> DataFrame:
    """Needs that a change of rules adds: only users with any of their inputs, only affected rules."""
    again = affected(rules, changed)
    inputs = sorted({x for r in again for x in r.reads})
    some = F.lit(False)
    for x in inputs:
        some = some | F.col(x).isNotNull()
    return need_rows(infer_needs(users.where(some), again), again, id_col).join(known.select(id_col, "need"), [id_col, "need"], "left_anti")


# ── journeys ───────────────────────────────────────────────────────────────

#: Events that a profile's stage implies.
STAGES = {
    "线索": ["E501", "E502", "E506"],
    "试驾": ["E501", "E502", "E503", "E505", "E401"],
    "小订": ["E501", "E502", "E503", "E504", "E505", "E506"],
    "大定": ["E501", "E502", "E503", "E504", "E505", "E506"],
}


def implied_events(stage: Column, inquiries: Column, n_views: Column, stages: dict[str, list[str]] | None = None) -> Column:
    """The sorted set of events that stage, inquiries and views imply."""
    def ids(xs):
        return F.array(*[F.lit(x) for x in xs])

    base = ids(["E501"])
    for name, events in (stages or STAGES).items():
        base = F.when(stage == name, ids(events)).otherwise(base)
    none = F.array().cast("array<string>")
    asked = F.when(inquiries >= 1, ids(["E202", "E303"])).otherwise(none)
    seen = F.when(n_views >= 1, ids(["E101", "E102", "E103"])).otherwise(none)
    return F.array_sort(F.array_union(F.array_union(base, asked), seen))


def journey_matches(users: DataFrame, journeys: DataFrame, id_col: str = "user_id") -> DataFrame:
    """Every user with every journey that scores: coverage x product of the probabilities up to the first missing event.

    ``users(id, events array)``, ``journeys(journey_id, nodes array<struct<event, p>>)``: the fixed handful of
    journeys is broadcast.  ``best`` marks the highest score (ties by journey_id).
    """
    j = users.join(F.broadcast(journeys))
    names = F.transform("nodes", lambda x: x["event"])
    matched = F.filter(names, lambda e: F.array_contains(F.col("events"), e))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(True).alias("on"))
    path = F.aggregate(
        "nodes",
        start,
        lambda a, x: F.struct(
            F.when(a["on"] & F.array_contains(F.col("events"), x["event"]), a["p"] * x["p"]).otherwise(a["p"]).alias("p"),
            (a["on"] & F.array_contains(F.col("events"), x["event"])).alias("on"),
        ),
        lambda a: a["p"],
    )
    share = F.size(matched) / F.size("nodes")
    j = j.select(id_col, "journey_id", F.round(share * path, 4).alias("score"), F.round(share, 4).alias("coverage"), F.array_join(F.array_except(names, matched), ",").alias("missing")).where("score > 0")
    return j.withColumn("best", F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("score"), "journey_id")) == 1)
