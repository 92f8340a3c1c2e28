"""Rules on bitmaps against rule columns."""

import random

import pytest

from cohortry.functions import rules as R
from cohortry.operators import bitmaps as BM
from cohortry.plans import audience_queries as Q
from cohortry.plans.driver_tables import profile, raw_events


def test_numbers_are_dense(spark):
    ids = spark.createDataFrame([(f"é{i % 700}",) for i in range(1500)] + [(None,)], "user_id string").repartition(7)
    got = sorted(r["number"] for r in BM.numbered_ids(ids).collect())
    assert got == list(range(1, 701)) and BM.numbered_ids(ids.limit(0)).count() == 0


def holds(rule, labels):
    if "all" in rule:
        return all(holds(r, labels) for r in rule["all"])
    if "any" in rule:
        return any(holds(r, labels) for r in rule["any"])
    return not holds(rule["not"], labels) if "not" in rule else rule["has"] in labels


@pytest.mark.parametrize("n", [300, 70_000])
def test_any_rules_over_several_buckets(spark, n):
    rng = random.Random(n)
    has = {f"id{i}": {a for a in "abcd" if rng.random() < (0.0005 if a == "d" else 0.3)} for i in range(n)}

    def made(depth):
        kind = rng.choice(["has", "all", "any", "not"]) if depth else "has"
        if kind == "has":
            return {"has": rng.choice("abcdx")}
        return {"not": made(depth - 1)} if kind == "not" else {kind: [made(depth - 1) for _ in range(rng.randint(0, 3))]}

    rules = {f"r{i}": made(3) for i in range(30)}
    numbers = BM.numbered_ids(spark.createDataFrame([(i,) for i in has], "user_id string"))
    members = spark.createDataFrame([(i, a) for i, own in has.items() for a in own] + [("stranger", "a")], "user_id string, rule string")
    maps = BM.rules_on_maps(BM.audience_maps(members, numbers), numbers, rules)
    got = {r["rule"]: r["n"] for r in maps.groupBy("rule").sum("users").withColumnRenamed("sum(users)", "n").collect()}
    want = {name: sum(holds(r, own) for own in has.values()) for name, r in rules.items()}
    assert got == {k: v for k, v in want.items() if v}
    if n < 1000:
        ids = {(r["rule"], r["id"]) for r in BM.members_of(maps, numbers).collect()}
        assert ids == {(name, i) for name, r in rules.items() for i, own in has.items() if holds(r, own)}


def test_batch_equals_rule_frame(spark, sf):
    frame = R.rule_frame(profile(spark, sf), Q._BATCH, raw_events(spark, sf))
    want = {r["rule"]: r["count"] for r in R.matches(frame, list(Q._BATCH)).groupBy("rule").count().collect()}
    assert {r["rule"]: r["users"] for r in Q.u4_bitmap_rules(spark, sf).collect()} == want and len(want) > 10
