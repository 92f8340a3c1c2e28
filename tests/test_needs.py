import pytest
from pyspark.sql import functions as F

from cohortry.operators import needs as N

VIEW = "power_type string, body_type string, car_price_band string, car_size_level string"
USER = f"user_id string, policy_restriction_fuel string, generation_group string, device_price_tier string, travel_activity string, inquiry_frequency int, inquiry_price_band string, interaction_price_band string, commute_distance_delta string, views array<struct<{VIEW.replace(' ', ':').replace(',:', ',')}>>"

EV, PHEV, EREV, FUEL = "纯电", "插混", "增程", "燃油"
USERS = [
    ("U1", N.FUEL_PLATE, "中坚家庭", "中端", "低", 2, "20-30", "20-30", "15.0", [(EV, "SUV", "20-30", "大型")]),
    ("U2", N.UNKNOWN, "新锐青年", "低端", "低", 0, "10-20", "20-30", None, [(FUEL, "轿车", "10-20", "小型")]),
    ("U3", N.FUEL_FREE, "中坚家庭", "高端", "低", 1, "", "", "12.5", [(FUEL, "SUV", "30-40", "大型"), (FUEL, "MPV", "20-30", "大型")]),
    ("U4", N.UNKNOWN, "年轻新贵", "高端", "高", 1, "未知", "未知", "far", [(EREV, "SUV", "30-40", "中型"), (FUEL, "SUV", "30-40", "中型")]),
    ("U5", N.FUEL_ROAD, "银发群体", "中端", "高", 0, None, None, "1", [(EREV, "SUV", None, None)]),
    ("U6", None, None, None, None, None, None, None, None, []),
]
WANT = {
    "U1": {"green_plate", "six_seven_seats", "budget_locked", "long_commute"},
    "U2": {"single_commute"},
    "U3": {"plate_free", "six_seven_seats", "flexible_budget", "long_commute"},
    "U4": {"range_anxiety"},
    "U5": {"no_parking", "range_anxiety"},
    "U6": set(),
}


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, USER)


def test_golden_needs(users):
    rows = N.need_rows(N.infer_needs(users), N.need_rules()).collect()
    got = {u: set() for u in WANT}
    for r in rows:
        got[r["user_id"]].add(r["need"])
    assert got == WANT


def test_rules_run_after_what_they_depend_on():
    a = N.NeedRule("a", dict, ["b"])
    b = N.NeedRule("b", dict)
    assert [r.rule_id for r in N.ordered([a, b])] == ["b", "a"]
    with pytest.raises(ValueError):
        N.ordered([N.NeedRule("a", dict, ["b"]), N.NeedRule("b", dict, ["a"])])
    assert [r.rule_id for r in N.affected(N.need_rules(), {"license_plate"})] == ["license_plate", "range_anxiety"]
    assert [r.rule_id for r in N.affected(N.need_rules(), {"range_anxiety"})] == ["license_plate", "range_anxiety"]


def test_rerun_reports_new_needs_only(spark, users):
    known = spark.createDataFrame([("U1", "green_plate"), ("U4", "range_anxiety")], "user_id string, need string")
    got = {tuple(r) for r in N.rerun(users, N.need_rules(), {"license_plate"}, known).collect()}
    assert got == {("U3", "plate_free"), ("U5", "no_parking"), ("U5", "range_anxiety")}


def test_journeys(spark):
    users = spark.createDataFrame([(1, ["A", "C"]), (2, ["B"]), (3, [])], "user_id int, events array<string>")
    journeys = spark.createDataFrame([("j", [("A", 1.0), ("B", 0.5), ("C", 0.5)]), ("k", [("B", 0.8)])], "journey_id string, nodes array<struct<event:string,p:double>>")
    got = {(r["user_id"], r["journey_id"]): (r["score"], r["missing"], r["best"]) for r in N.journey_matches(users, journeys).collect()}
    assert got == {(1, "j"): (round(2 / 3, 4), "B", True), (2, "j"): (round(1 / 3, 4), "A,C", False), (2, "k"): (0.8, "", True)}


def test_policy_and_generation(spark):
    fuel, ev = N.car_policy(F.col("c"))
    rows = spark.createDataFrame([("北京",), ("成都市",), ("合肥",), (None,)], "c string").select(fuel, ev).collect()
    assert [tuple(r) for r in rows] == [(N.FUEL_PLATE, N.EV_PLATE), (N.FUEL_ROAD, N.EV_FREE), (N.UNKNOWN, N.UNKNOWN), (N.UNKNOWN, N.UNKNOWN)]
    g = spark.createDataFrame([("55岁以上",), ("?",)], "a string").select(N.generation(F.col("a"))).collect()
    assert [r[0] for r in g] == ["银发群体", "未来车主"]
