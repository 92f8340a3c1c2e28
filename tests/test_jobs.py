import pytest
from pyspark.sql import functions as F

from cohortry.operators import models as M
from cohortry.operators import scoring as S
from cohortry.operators import wide_table as T
from cohortry.sources import files
from cohortry.streaming import events as E


def test_softmax_sums_to_one(spark):
    f = spark.createDataFrame([(1, 1000.0), (1, 999.0), (2, -5.0), (2, 3.0), (3, 0.0)], "user_id int, s double")
    got = f.withColumn("p", S.softmax(f, "s")).groupBy("user_id").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1.0) for r in got)


def test_poison_needs_are_never_dominant(spark):
    profile = spark.createDataFrame([(i, int(i < 5)) for i in range(10)], "user_id long, is_lead int")
    members = spark.createDataFrame([("bad", i) for i in range(5, 10)] + [("good", i) for i in range(6)], "need_name string, user_id long")
    acts = spark.createDataFrame([("good", "a")], "need_name string, action string")
    hits = spark.createDataFrame([(i, "a", "2024-01-01 00:00:00") for i in range(6)], "user_id long, derived_event_type string, event_time string").withColumn("event_time", F.col("event_time").cast("timestamp"))
    sat = spark.createDataFrame([("a", 1)], "action string, saturation int")
    s = S.rule_scores(members, profile, acts, sat, hits, F.lit("2024-01-08").cast("date")).collect()
    assert all(r["dominant_flag"] == 0 and r["raw_score"] < 0 for r in s if r["need_name"] == "bad")
    good = next(r for r in s if r["need_name"] == "good" and r["user_id"] == 0)
    assert good["dominant_flag"] == 1 and good["time_decay"] == 0.5 and good["fulfillment"] == 1


def test_sample_pool_is_disjoint_and_repeats(spark):
    leads = spark.range(20).select(F.col("id").alias("account")).union(spark.createDataFrame([(None,), (3,)], "account long"))
    clicks = spark.range(10, 60).select(F.col("id").alias("account"))
    binding = spark.range(100).select(F.when(F.col("id") > 0, F.col("id")).alias("account"))
    pool = T.sample_pool(leads, clicks, binding, 15)
    rows = sorted(map(tuple, pool.collect()))
    assert rows == sorted(map(tuple, T.sample_pool(leads, clicks, binding, 15).collect()))
    assert len({r[0] for r in rows}) == 45 and T.overlaps(pool).count() == 0
    assert dict(pool.groupBy("sample_label").count().collect()) == {"positive": 15, "negative_click": 15, "negative_random": 15}


def test_sequence_texts(spark):
    d = spark.createDataFrame([("u", "d1", "2024-01-01", "x"), ("u", "d1", "2024-01-02", None), ("u", "d2", "2024-01-01", "y"), ("v", "d3", "2024-01-01", "z")], "account string, device string, day string, app string")
    got = {r["account"]: r["seq"] for r in T.sequence_text(d, ["day", "app"], "day,app").collect()}
    assert got == {"v": "day,app\n2024-01-01,z", "u": "=== device d1 ===\nday,app\n2024-01-02,\n2024-01-01,x\n=== device d2 ===\nday,app\n2024-01-01,y"}


def test_column_kinds_and_missing_columns(spark, tmp_path):
    f = spark.createDataFrame([("1", "a,b", "x", None), ("2.5", "c", "y", ""), (None, "d,e", "z", None)], "n string, l string, c string, e string")
    assert dict(map(tuple, M.column_kinds(f, ["n", "l", "c", "e"]).collect())) == {"n": "numeric", "l": "list", "c": "categorical", "e": "empty"}
    files.write_csv(f, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="zz"):
        files.read_csv(spark, str(tmp_path / "c"), ["n", "zz"])


def test_model_learns_and_predicts_without_a_column(spark):
    f = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"), ((F.col("id") % 10) > 5).cast("int").alias("y"))
    model = M.train(f, "y", "binary", ["x"], ["c"], trees=3, depth=2)
    p = M.predict(model, f.drop("c"), "binary", ["x"], ["c"])
    assert M.auc(p, "y", "xgb_probability") > 0.99
    report = M.classification_report(p, "y", "xgb_prediction").first()
    assert report["accuracy"] > 0.99 and report["macro_f1"] > 0.99
    _, leaves = M.mined_paths(f, ["x"], "y", depth=3)
    assert any("x > 5.5" in r["leaf"] and r["lead_rate"] == 1 for r in M.leaf_rules(leaves, "y").collect())


def test_bad_event_lines_are_rejected(spark):
    lines = spark.createDataFrame([('{"event_id":"1","user_id":"u","kind":"view","field":"c","value":"1","ts":"2024-01-01T00:00:00"}',), ("{no",), ('{"user_id":"u"}',), ('{"kind":"view"}',), ('{"user_id":"u","kind":"view"}',)], "value string")
    events = E.parsed(lines)
    assert E.accepted(events).count() == 1
    assert sorted(r["error"] for r in E.rejected(events).collect()) == ["no kind", "no time", "no user_id", "not JSON"]


def test_triples_escape_literals(spark, tmp_path):
    f = spark.createDataFrame([(1, 'a "b"\n\\', None)], "k int, x string, y string")
    assert [tuple(r) for r in files.triples(f, "k", ["x", "y"]).collect()] == [("<urn:entity:1>", "<urn:entity:p:x>", '"a \\"b\\"\\n\\\\"')]


def test_last_line_of_the_last_file_counts(spark, tmp_path):
    from cohortry.sources import files as S

    (tmp_path / "a.tsv").write_text("user_id\tv\n1\tfirst\n2\told\n2\tnewer\n")
    (tmp_path / "b.tsv").write_text("user_id\tv\n" + "".join(f"x{i}\tfill\n" for i in range(500)) + "1\tlast\n")
    got = {r["user_id"]: r["v"] for r in S.read_profiles(spark, str(tmp_path), "tsv").where("user_id in ('1', '2')").collect()}
    assert got == {"1": "last", "2": "newer"}


def test_every_row_is_split_once_and_repeatably(spark):
    from cohortry.operators import lift as L

    rows = spark.range(3000).selectExpr("id user_id", "if(id < 2, null, id % 3) c")
    got = L.hash_split(rows, "user_id", "c", 0.25)
    by = {(r["c"], r["split"]): r["count"] for r in got.groupBy("c", "split").count().collect()}
    assert by == {(0, "val"): 249, (0, "train"): 750, (1, "val"): 249, (1, "train"): 750, (2, "val"): 250, (2, "train"): 750, (None, "val"): 1, (None, "train"): 1}
    assert got.exceptAll(L.hash_split(rows, "user_id", "c", 0.25)).count() == 0


def test_caps_of_apps_and_behaviours(spark):
    rows = [("u", "d", f"2024-01-{day:02d}", app, float(app + 10)) for day in (1, 2, 9) for app in range(5)]
    sums = spark.createDataFrame(rows, "account string, device string, day string, app int, seconds double")
    recent = T.top_apps(sums, "2024-01-08", True, 2).collect()
    assert sorted((r["day"], r["app"]) for r in recent) == [("2024-01-09", 3), ("2024-01-09", 4)]
    older = T.top_apps(sums, "2024-01-08", False, 3).collect()
    assert sorted((r["app"], r["day"]) for r in older) == [(3, "2024-01-01"), (4, "2024-01-01"), (4, "2024-01-02")]
    b = spark.createDataFrame([("u", "d", f"2024-01-{i:02d}", i, i) for i in range(1, 6)], "account string, device string, day string, app int, line int")
    got = T.latest_behaviours({"x": b, "y": b.where("app < 2")}, 2).collect()
    assert sorted((r["source"], r["app"]) for r in got) == [("x", 4), ("x", 5), ("y", 1)]


def test_classes_areas_and_folds(spark):
    f = spark.range(240).select(F.col("id").alias("user_id"), (F.col("id") % 12).cast("double").alias("x"), F.floor(F.col("id") % 12 / 4).cast("int").alias("y"))
    p = M.predict(M.train(f, "y", "multi", ["x"], trees=2, depth=2), f, "multi", ["x"])
    assert p.where("xgb_prediction <> y or abs(aggregate(xgb_probabilities, 0d, (a, x) -> a + x) - 1) > 1e-9").count() == 0
    report = M.classification_report(p, "y", "xgb_prediction", [F.get("xgb_probabilities", F.lit(k)) for k in range(3)]).first()
    assert report["accuracy"] == 1 and report["auc"] == 1
    folds = M.k_fold(f.withColumn("t", F.col("x") / 12), "t", "regression", ["x"], folds=2, trees=2, depth=3)
    assert folds.count() == 2 and M.fold_summary(folds).first()["mean"] > 0.9


def test_areas_by_counting_pairs(spark):
    rows = [(int(i * 7 % 5 < 2), float(i * 3 % 4)) for i in range(40)]
    pairs = [(a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z]
    assert M.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s") == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)
    assert M.auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s") is None
    assert M.auc(spark.createDataFrame([], "y int, s double"), "y", "s") is None


def test_rules_that_name_users_go(spark):
    from cohortry.functions import rules as R

    c = spark.createDataFrame([("a", "city"), ("a", "USER_ID "), ("b", "age"), ("c", None)], "rule string, field string")
    assert sorted(map(tuple, R.without_users(c).collect())) == [("b", 1), ("c", 1)]


def test_load_modes(spark, tmp_path):
    event = '{{"res_key": "{}", "timestamp": "t", "dur_time": 1.0}}'
    (tmp_path / "m.json").write_text('{"user_id": "1", "user_events": [' + event.format("留资_a") + ']}\n{"user_id": "2", "is_converted": 0, "user_events": null}\n')
    profiles, behaviours = files.load(spark, "merged", str(tmp_path / "m.json"))
    assert sorted((r["user_id"], r["is_converted"]) for r in profiles.collect()) == [("1", 1), ("2", 0)] and behaviours.count() == 1
    with pytest.raises(ValueError, match="other"):
        files.load(spark, "other")


def test_newest_versions_over_batches(spark, tmp_path):
    from cohortry.streaming.run import newest

    for i, rows in enumerate(["1 a\n2 b\n", "2 c\n3 d\n2 e\n"]):
        (tmp_path / f"{i}.txt").write_text(rows)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path))
    counts = lines.groupBy(F.substring("value", 1, 1).alias("k")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, newest(counts, ["k"]).collect())) == [("1", 1), ("2", 3), ("3", 1)]
    (tmp_path / "none").mkdir()
    empty = spark.readStream.text(str(tmp_path / "none")).groupBy("value").agg(F.count("*").alias("n"))
    assert newest(empty, ["value"]).count() == 0


def test_dimension_beyond_the_bound_is_not_broadcast(spark, monkeypatch):
    fact = spark.createDataFrame([(1,), (2,), (None,)], "app int")
    dim = spark.createDataFrame([(1, "one"), (3, "three")], "app int, app_name string")
    want = [("None", None), ("1", "one"), ("2", "2")]
    for most in (200_000, 1):
        monkeypatch.setattr(T, "SMALL", most)
        assert sorted(((str(r["app"]), r["app_name"]) for r in T.with_dimension(fact, dim, "app", "app_name").collect()), key=str) == sorted(want, key=str)
        assert sorted(r["app"] for r in T.not_listed(fact.where("app is not null"), dim, "app").collect()) == [2]
