"""Caps that bind: the latest rows by device and by account."""

from collections import Counter

from cohortry.operators import wide_table as T
from cohortry.plans import wide_queries as Q


def test_latest_rows_are_cut_at_their_caps(spark, sf):
    every = Q.w3_latest_installs(spark, sf).collect()
    few = Q.w3_latest_installs(spark, sf, 4, 1).collect()
    want = {(r["device"], r["kind"], r["row_num"]): r for r in every if r["row_num"] <= (4 if r["kind"] == "install" else 1)}
    assert {(r["device"], r["kind"], r["row_num"]): r for r in few} == want and len(few) == len(want) < len(every)
    ads = Counter((r["account"], r["event_type"]) for r in Q.w5_latest_ads(spark, sf, 3).collect())
    assert max(ads.values()) == 3


def test_rows_of_one_day_app_and_line_are_numbered_alike_in_any_order(spark):
    rows = [(1, 7, "2024-01-02", 3, 1, a, b) for a, b in (("O", "427"), ("F", "523"), ("F", "101"), (None, "9"))]
    columns = "account long, device long, day string, app long, line int, field1 string, field2 string"
    told = []
    for given in (rows, rows[::-1]):
        frame = spark.createDataFrame(given, columns).coalesce(1)
        out = T.latest_behaviours({"finance": frame, "shop": frame}, 3)
        told.append(sorted((r["source"], r["row_num"], r["field1"] or "", r["field2"]) for r in out.collect()))
    assert told[0] == told[1] == [(s, *x) for s in ("finance", "shop") for x in ((1, "", "9"), (2, "F", "101"), (3, "F", "523"))]
