"""Lift counted on flags against lift of exploded memberships."""

import random

from cohortry.functions import rules as R
from cohortry.operators import lift as L


def test_flags_equal_memberships(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("xyz"), int(rng.random() < 0.3), rng.random() < 0.5, rng.random() < 0.1, False) for i in range(300)]
    flags = spark.createDataFrame(rows, "user_id long, segment string, is_lead int, a boolean, b boolean, c boolean")
    names = ["a", "b", "c"]
    people = flags.select("user_id", "segment", "is_lead")
    rows_of = lambda f: sorted(map(tuple, f.collect()))
    assert rows_of(L.lift_of_flags(flags, names)) == rows_of(L.lift(R.matches(flags, names), people))
    events = R.matches(flags, names).withColumnRenamed("rule", "event")
    assert rows_of(L.lift_of_flags(flags, names, "segment", label="event")) == rows_of(L.lift_matrix(people, events, people))
    parts = L.lift_of_flags(flags, names, "segment", within=True)
    for s in "xyz":
        own = people.where(f"segment = '{s}'")
        assert rows_of(parts.where(f"segment = '{s}'").drop("segment")) == rows_of(L.lift(R.matches(flags, names), own))
    assert L.lift_of_flags(flags.limit(0), names).count() == 0


def test_hits_are_never_rows(spark):
    flags = spark.createDataFrame([(1, 1, True)], "user_id long, is_lead int, a boolean")
    plan = L.lift_of_flags(flags, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and "Join" not in plan
