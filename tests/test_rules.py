import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.functions import rules as R
from cohortry.plans import rule_sets

RAW = "user_id long, event_type string, event_time timestamp, dwell double, attrs string"


@pytest.fixture(scope="module")
def small(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1 + h // 24, h % 24)
    rows = [
        (1, "a", t(0), 5.0, '{"brand": "x"}'), (1, "a", t(30), 50.0, '{"brand": "y"}'), (1, "b", t(40), 1.0, '{"brand": "x"}'), (1, "lead_submit", t(1), 9.0, "{}"),
        (2, "b", t(0), 1.0, '{"brand": "z"}'), (2, "a", t(2), None, '{"brand": null}'), (3, "lead_submit", t(0), 1.0, "{}"),
    ]
    profile = spark.createDataFrame([(1, "u", 10), (2, "v", None), (3, None, 3), (4, "u", 4)], "user_id long, city string, age int")
    return profile, spark.createDataFrame(rows, RAW)


CASES = [
    ({"raw": "a", "stat": "exists"}, {1, 2}),
    ({"raw": "lead_submit", "stat": "exists"}, set()),
    ({"raw": "a", "stat": "count", "op": ">=", "value": 2}, {1}),
    ({"raw": "a", "stat": "count", "op": "<", "value": 2}, {2}),
    ({"raw": ["a", "b"], "stat": "count", "op": "=", "value": 2}, {2}),
    ({"raw": "a", "stat": "days", "op": ">=", "value": 2}, {1}),
    ({"raw": "a", "stat": "dur_max", "op": ">", "value": 49.0}, {1}),
    ({"raw": "a", "stat": "distinct", "attr": "brand", "op": ">=", "value": 2}, {1}),
    ({"raw": "a", "stat": "contains", "value": '"y"'}, {1}),
    ({"raw": "b", "stat": "exists", "where": [("brand", "=", "z")]}, {2}),
    ({"raw": "a", "stat": "exists", "where": [("brand", "is null", None)]}, {2}),
    ({"before": ("a", "b")}, {1}),
    ({"before": ("b", "a")}, {2}),
    ({"same": ("a", "brand", "b", "brand")}, {1}),
    ({"profile": "city", "op": "in", "value": ["u"]}, {1, 4}),
    ({"profile": "city", "op": "not in", "value": ["u"]}, {2}),
    ({"profile": "age", "op": ">=", "value": 4}, {1, 4}),
    ({"not": {"raw": "a", "stat": "exists"}}, {3, 4}),
    ({"all": [{"raw": "a", "stat": "exists"}, {"not": {"profile": "city", "op": "=", "value": "v"}}]}, {1}),
]


def test_atoms(spark, small):
    profile, raw = small
    rules = {f"r{i}": r for i, (r, _) in enumerate(CASES)}
    got = {}
    for r in R.matches(R.rule_frame(profile, rules, raw), list(rules)).collect():
        got.setdefault(r["rule"], set()).add(r["user_id"])
    assert {k: got.get(k, set()) for k in rules} == {f"r{i}": w for i, (_, w) in enumerate(CASES)}


def test_derived_events_and_days_since(spark, small):
    profile, raw = small
    derived = raw.where("event_type = 'a'").select("user_id", F.col("event_type").alias("derived_event_type"), "event_time")
    rules = {"e": {"event": "a", "stat": "count", "op": ">=", "value": 2}, "s": {"event": "a", "stat": "days_since", "op": "<=", "value": 3}}
    f = R.rule_frame(profile, rules, derived=derived, run_date=F.lit("2024-01-05").cast("date"))
    assert {(r["user_id"], r["rule"]) for r in R.matches(f, ["e", "s"]).collect()} == {(1, "e"), (1, "s")}


leaf = st.sampled_from([c[0] for c in CASES])
tree = st.recursive(leaf, lambda s: st.one_of(st.lists(s, min_size=1, max_size=3).map(lambda x: {"all": x}), st.lists(s, min_size=1, max_size=3).map(lambda x: {"any": x}), s.map(lambda x: {"not": x})), max_leaves=5)


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rule=tree)
def test_algebra_over_all_users(spark, small, rule):
    profile, raw = small
    known = {str(r): w for r, w in CASES}

    def value(r):
        if str(r) in known:
            return known[str(r)]
        if "all" in r:
            return set.intersection(*map(value, r["all"]))
        if "any" in r:
            return set.union(*map(value, r["any"]))
        return {1, 2, 3, 4} - value(r["not"])

    frame = R.rule_frame(profile, {"r": rule, "not r": {"not": rule}}, raw)
    got = {(r["user_id"], r["rule"]) for r in R.matches(frame, ["r", "not r"]).collect()}
    assert got == {(u, "r") for u in value(rule)} | {(u, "not r") for u in {1, 2, 3, 4} - value(rule)}


def test_conditions_and_guards(spark):
    with pytest.raises(ValueError):
        R.condition("x", "~", 1)
    assert R.names_users([("city", "=", 1), ("user_id", "=", 7)]) and not R.names_users([("city", "=", 1)])
    assert spark.range(3).where(R.conditions([])).count() == 3


def test_bitmaps_agree_with_sets(spark):
    members = spark.createDataFrame([("a", 1), ("a", 40_000), ("b", 40_000), ("b", 3), ("a", 1)], "s string, user_id long")
    maps = R.bitmaps(members, "s")
    size = lambda m: R.bitmap_sizes(m.withColumn("s", F.lit("x")) if "s" not in m.columns else m, "s").collect()
    assert {r["s"]: r["users"] for r in size(maps)} == {"a": 2, "b": 2}
    assert size(R.combined(maps, "s", ["a", "b"]))[0]["users"] == 3
    assert size(R.combined(maps, "s", ["a", "b"], "and"))[0]["users"] == 1


def test_rule_sets_are_complete():
    assert len(rule_sets.BEHAVIOUR_RULES) + len(rule_sets.TOTAL_RULES) == 38
    assert len(rule_sets.ACTION_RULES) == 18 and len(rule_sets.NEED_RULES) == 30
    used = {a["event"] for r, _ in rule_sets.NEED_RULES.values() for a in R.atoms_of(r) if "event" in a}
    assert used <= set(rule_sets.ACTION_RULES)
