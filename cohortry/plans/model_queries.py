"""Registered queries on features, models and their reports, and on readers and writers, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as M
from ..sources import files as S
from ..streaming.run import shared_folder, stored
from .driver_tables import KINDS, SQL, profile, raw_events, table

NAMES = sorted(set(KINDS.values()))
#: Columns of the feature matrix that models use.
NUMERIC = [f"{k}__{m}" for k in ("view_car_detail", "ad_click", "search_general", "test_drive") for m in ("count", "days", "dur_max", "dur_sum")] + ["n_brands", "n_models", "n_types", "n_actions", "balance"]


def a13_feature_matrix(spark, d):
    m = M.feature_matrix(profile(spark, d), raw_events(spark, d), NAMES)
    return m.select("user_id", "is_lead", *[F.round(c, 4).alias(c) for c in m.columns if "__" in c], "n_brands", "n_models", "n_types", "n_actions")


_COLS = ", ".join(
    f"COUNT(*) FILTER (event_type = '{k}') AS {k}__count, COUNT(DISTINCT CASE WHEN event_type = '{k}' THEN CAST(event_time AS DATE) END) AS {k}__days, "
    f"ROUND(COALESCE(MAX(dwell) FILTER (event_type = '{k}'), 0), 4) AS {k}__dur_max, ROUND(COALESCE(SUM(dwell) FILTER (event_type = '{k}'), 0), 4) AS {k}__dur_sum"
    for k in NAMES
)


def a16_event_flags(spark, d):
    return M.event_flags(raw_events(spark, d), NAMES)


def d30_column_kinds(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.concat_ws(",", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("pair"), F.lit("").alias("none"))
    return M.column_kinds(c, ["c_custkey", "c_mktsegment", "pair", "none"])


def _lists(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("tags"))


def d31_list_vocabulary(spark, d):
    return M.list_vocabulary(_lists(spark, d), "tags", 3)


def d31_multi_hot(spark, d):
    return M.multi_hot(_lists(spark, d), "tags", ["1-URGENT", "5-LOW"])


def _frame(spark, d) -> DataFrame:
    m = M.feature_matrix(profile(spark, d), raw_events(spark, d), NAMES).join(_lists(spark, d), "user_id", "left")
    return m.withColumn("value", F.col("n_actions") / 100).withColumn("fold", F.pmod(F.xxhash64("user_id"), F.lit(5)))


def d33_boosted_trees(spark, d):
    """Trained on four fifths of the users, predicting for all."""
    f = _frame(spark, d)
    model = M.train(f.where("fold > 0"), "is_lead", "binary", NUMERIC, ["segment"], ["tags"], trees=8, depth=3)
    p = M.predict(model, f, "binary", NUMERIC, ["segment"], ["tags"])
    return p.select("user_id", "is_lead", "fold", "xgb_prediction", F.round("xgb_probability", 6).alias("xgb_probability"))


def d34_clipped_regression(spark, d):
    f = _frame(spark, d)
    model = M.train(f.where("fold > 0"), "value", "regression", NUMERIC, ["segment"], trees=8, depth=3)
    return M.predict(model, f.drop("n_brands"), "regression", NUMERIC, ["segment"]).select("user_id", "value", F.round("xgb_prediction", 6).alias("xgb_prediction"))


def _classes(spark, d) -> DataFrame:
    return _frame(spark, d).withColumn("cls", F.least(F.floor(F.col("view_car_detail__count") / 2), F.lit(2)))


def d33_multi_class(spark, d):
    """Boosted trees for three classes, judged on the held-out fifth."""
    f = stored(_classes(spark, d))
    model = M.train(f.where("fold > 0"), "cls", "multi", NUMERIC, trees=3, depth=3)
    p = M.predict(model, f.where("fold = 0"), "multi", NUMERIC)
    return M.classification_report(p, "cls", "xgb_prediction", [F.get("xgb_probabilities", F.lit(k)) for k in range(3)])


def d34_class_probabilities(spark, d):
    """All users with the probabilities of three classes."""
    f = stored(_classes(spark, d))
    p = M.predict(M.train(f.where("fold > 0"), "cls", "multi", NUMERIC, trees=3, depth=3), f.drop("n_brands"), "multi", NUMERIC)
    return p.select("user_id", "cls", "xgb_prediction", *[F.round(F.get("xgb_probabilities", F.lit(k)), 6).alias(f"p{k}") for k in range(3)])


def d51_holdout_reports(spark, d):
    """Saved and reloaded models of two targets judged on the held-out fifth, one row for each target and measure."""
    f = stored(_frame(spark, d))
    out = None
    for target, kind in (("value", "regression"), ("is_lead", "binary")):
        path = f"{shared_folder(spark)}/model"
        M.train(f.where("fold > 0"), target, kind, NUMERIC, trees=5, depth=3).write().overwrite().save(path)
        p = M.predict(M.PipelineModel.load(path), f.where("fold = 0"), kind, NUMERIC)
        r = M.regression_report(p, target, "xgb_prediction") if kind == "regression" else M.classification_report(p, target, "xgb_prediction", [F.col("xgb_probability")])
        rows = r.select(F.lit(target).alias("target"), "*").unpivot("target", r.columns, "measure", "value")
        out = rows if out is None else out.unionAll(rows)
    return out


def d35_k_fold(spark, d):
    """R2 of a regression on three folds: mean and deviation."""
    return M.fold_summary(M.k_fold(stored(_frame(spark, d)), "value", "regression", NUMERIC, folds=3, trees=3, depth=3))


def d36_k_fold(spark, d):
    """Macro F1 of a classification on three folds: mean and deviation."""
    return M.fold_summary(M.k_fold(stored(_frame(spark, d)), "is_lead", "binary", NUMERIC, folds=3, trees=3, depth=3))


def t7_importances(spark, d):
    f = _frame(spark, d)
    model = M.train(f, "value", "regression", NUMERIC, trees=8, depth=3)
    return spark.createDataFrame(M.importances(model, NUMERIC, 10), "feature string, importance double").select("feature", F.round("importance", 6).alias("importance"))


def d28_mined_rules(spark, d):
    m = M.feature_matrix(profile(spark, d), raw_events(spark, d), NAMES)
    _, leaves = M.mined_paths(m, [f"{k}__count" for k in NAMES] + ["n_actions"], depth=6, least=10)
    return M.leaf_rules(leaves)


def _predictions(spark, d) -> DataFrame:
    """Order prices guessed from the customer's key: something to report on."""
    o = table(spark, d, "orders")
    return o.select((F.col("o_totalprice") / 500_000).alias("y"), ((F.col("o_totalprice") + F.col("o_custkey") % 50 * 1000) / 500_000).alias("p"), (F.col("o_orderkey") % 3).alias("label"), ((F.col("o_orderkey") + (F.col("o_custkey") % 4 == 0).cast("int")) % 3).alias("pred"))


def d35_regression_report(spark, d):
    return M.regression_report(_predictions(spark, d), "y", "p")


def d36_classification_report(spark, d):
    return M.classification_report(_predictions(spark, d), "label", "pred")


def d36_auc(spark, d):
    """Areas of three classes against the rest, by scores that lean to the class."""
    p = _predictions(spark, d)
    return M.auc_report(p, "label", [F.col("p") + (F.col("pred") == k).cast("double") / (k + 2) for k in range(3)])


def d36_confusion(spark, d):
    return M.confusion(_predictions(spark, d), "label", "pred")


# ── readers and writers ────────────────────────────────────────────────────


def s2_labelled_sets(spark, d):
    """JSON lines written and read back as positive and negative sets; the first record of a user counts."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("k:"), "event_type").alias("user_tag"), F.struct(F.col("event_type").alias("res_key"), F.col("ts").cast("string").alias("timestamp"), F.to_date("ts").cast("string").alias("time_str"), F.col("value").alias("dur_time")).alias("e"), "event_type")
    out = shared_folder(spark)
    for name, rows in (("pos", e.where("event_type = 'purchase'")), ("neg", e)):
        rows.groupBy("user_id").agg(F.min("user_tag").alias("user_tag"), F.collect_list("e").alias("user_events")).write.json(f"{out}/{name}")
    both = S.labelled_sets(S.read_users(spark, f"{out}/pos"), S.read_users(spark, f"{out}/neg"))
    return S.exploded_events(both).join(both.select("user_id", "is_lead"), "user_id").groupBy("user_id", "is_lead").agg(F.count("*").alias("n"), F.round(F.sum("dur_time"), 2).alias("dwell"))


def s3_profiles_last_line(spark, d):
    out = shared_folder(spark)
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("seg"))
    c.write.csv(f"{out}/p/a", sep="\t", header=True)
    c.where("user_id % 2 = 0").select("user_id", F.lit("later").alias("seg")).repartition(3).write.csv(f"{out}/p/b", sep="\t", header=True)
    return S.read_profiles(spark, f"{out}/p/*", "tsv").groupBy("seg").agg(F.count("*").alias("n"))


def s5_load_summary(spark, d):
    return S.load_summary(profile(spark, d).withColumnRenamed("is_lead", "is_converted"), raw_events(spark, d))


def s5_load_modes(spark, d):
    """The same users loaded from merged records, from profiles and behaviours, and from labelled sets."""
    out = shared_folder(spark)
    key = F.when(F.col("event_type") == "purchase", F.lit("留资_x")).otherwise(F.col("event_type"))
    flat = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), key.alias("res_key"), F.col("ts").cast("string").alias("timestamp"), F.col("value").alias("dur_time"))
    users = stored(flat.groupBy("user_id").agg(F.max((F.col("res_key") == "留资_x").cast("int")).alias("is_converted"), F.collect_list(F.struct("res_key", "timestamp", "dur_time")).alias("user_events")))
    users.drop("is_converted").write.json(f"{out}/merged")
    users.select("user_id", "is_converted").write.json(f"{out}/profiles")
    flat.write.json(f"{out}/behaviours")
    users.where("is_converted = 1").drop("is_converted").write.json(f"{out}/pos")
    users.drop("is_converted").write.json(f"{out}/neg")
    rows = None
    for mode, paths in (("merged", ["merged"]), ("split", ["profiles", "behaviours"]), ("labelled", ["pos", "neg"])):
        one = S.load_summary(*S.load(spark, mode, *[f"{out}/{p}" for p in paths])).withColumn("mode", F.lit(mode))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def s1_json_arrays(spark, d):
    """Users written as files that hold one JSON array each, and read back."""
    out = shared_folder(spark)
    e = table(spark, d, "events")
    users = e.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.collect_list(F.struct(F.col("event_type").alias("res_key"), F.col("value").alias("dur_time"))).alias("user_events"))
    # Sixteen files of arrays here; a large table takes JSON lines, which split.
    arrays = users.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(16)).alias("file")).agg(F.to_json(F.collect_list(F.struct("user_id", "user_events"))).alias("value"))
    arrays.write.partitionBy("file").text(f"{out}/arrays")
    return S.exploded_events(S.read_users(spark, f"{out}/arrays", lines=False)).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("dur_time"), 2).alias("dwell"))


def s6_csv_with_check(spark, d):
    out = shared_folder(spark)
    S.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), f"{out}/c")
    return S.read_csv(spark, f"{out}/c", ["c_custkey", "c_mktsegment"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def s8_partition_range(spark, d):
    out = shared_folder(spark)
    li = table(spark, d, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyyMM").alias("pt_d"))
    li.write.partitionBy("pt_d").parquet(f"{out}/li")
    return S.partition_range(spark, f"{out}/li", "199601", "199606").groupBy(F.col("pt_d").cast("string").alias("pt_d")).agg(F.count("*").alias("n"))


def s14_append_results(spark, d):
    out = f"{shared_folder(spark)}/r"
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment").withColumn("label", F.length("c_mktsegment"))
    S.append(c.where("c_custkey % 2 = 0"), out)
    S.append(c.where("c_custkey % 2 = 1"), out)
    return spark.read.schema(c.schema).parquet(out)


def s18_triples(spark, d):
    return S.triples(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", ["c_name", "c_mktsegment"])


def s19_rule_output(spark, d):
    out = f"{shared_folder(spark)}/rules"
    S.write_rules(d28_mined_rules(spark, d).select(F.md5(F.col("leaf").cast("binary")).alias("name"), F.col("leaf").alias("rule"), "tgi", "coverage", "lead_rate"), out)
    return spark.read.schema("name string, rule string, tgi double, coverage double, lead_rate double").json(out)


def d33_named_classes(spark, d):
    """The market segment of every customer by a model of text classes that stops early."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    model = M.train(c, "c_mktsegment", "multi", ["c_nationkey", "c_acctbal"], trees=4, depth=2, hold_out=0.2, id_col="c_custkey")
    return M.predict(model, c, "multi", ["c_nationkey", "c_acctbal"]).select("c_custkey", "xgb_prediction")


def a9_json_fields(spark, d):
    """Types of the fields of the events' properties."""
    return S.field_types(table(spark, d, "events"), "props")


def a9_field_types(spark, d):
    """Types of the fields of customers told as JSON, one of which is a number or a text."""
    c = table(spark, d, "customer")
    flat = F.struct("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), F.col("c_nationkey").alias("nation"), F.struct("c_mktsegment").alias("more"))
    odd = F.struct(F.col("c_custkey").cast("string").alias("nation"), (F.col("c_custkey") > 9).alias("late"), F.array("c_nationkey").alias("list"))
    told = F.when(F.col("c_custkey") % 7 == 0, "no json").when(F.col("c_custkey") % 2 == 0, F.to_json(flat)).otherwise(F.to_json(odd))
    return S.field_types(c.select(told.alias("json")), "json")


QUERIES = {f.__name__: f for f in (a13_feature_matrix, a16_event_flags, d30_column_kinds, d31_list_vocabulary, d31_multi_hot, d33_boosted_trees, d34_clipped_regression, d33_multi_class, d33_named_classes, d34_class_probabilities, d51_holdout_reports, d35_k_fold, d36_k_fold, d36_auc, t7_importances, d28_mined_rules, d35_regression_report, d36_classification_report, d36_confusion, s2_labelled_sets, s3_profiles_last_line, s5_load_summary, s5_load_modes, s1_json_arrays, s6_csv_with_check, s8_partition_range, s14_append_results, s18_triples, s19_rule_output, a9_json_fields, a9_field_types)}

_PRED = "p AS (SELECT o_totalprice / 500000 AS y, (o_totalprice + o_custkey % 50 * 1000) / 500000 AS p, o_orderkey % 3 AS label, (o_orderkey + CAST(o_custkey % 4 = 0 AS INT)) % 3 AS pred FROM orders)"
_TAGS = "l AS (SELECT o_custkey AS user_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS tags FROM orders GROUP BY 1)"
ORACLE = {
    "a13_feature_matrix": f"WITH {SQL} SELECT profile.user_id, ANY_VALUE(is_lead) AS is_lead, {_COLS}, COUNT(DISTINCT brand) AS n_brands, COUNT(DISTINCT model) AS n_models, COUNT(DISTINCT event_type) AS n_types, COUNT(raw.user_id) AS n_actions FROM profile LEFT JOIN (SELECT * FROM raw WHERE event_type <> 'lead_submit') raw USING (user_id) GROUP BY 1",
    "a16_event_flags": f"WITH {SQL} SELECT user_id, " + ", ".join(f"COUNT(*) FILTER (event_type = '{k}') > 0 AS {k}" for k in NAMES) + " FROM raw GROUP BY 1",
    "d30_column_kinds": "SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_mktsegment', 'categorical'), ('pair', 'list'), ('none', 'empty')) t(\"column\", kind)",
    "d31_list_vocabulary": f"WITH {_TAGS} SELECT item, COUNT(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS item FROM l) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "d31_multi_hot": f"WITH {_TAGS} SELECT *, CAST(contains(tags, '1-URGENT') AS INT) AS \"tags__1-URGENT\", CAST(contains(tags, '5-LOW') AS INT) AS \"tags__5-LOW\" FROM l",
    "d35_regression_report": f"WITH {_PRED}, r AS (SELECT *, rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2 AS rp, AVG(y) OVER () AS m FROM p) SELECT ROUND(AVG(abs(y - p)), 6) AS mae, ROUND(sqrt(AVG((y - p) ** 2)), 6) AS rmse, ROUND(1 - SUM((y - p) ** 2) / SUM((y - m) ** 2), 6) AS r2, ROUND(corr(y, p), 6) AS pearson, ROUND(corr(ry, rp), 6) AS spearman FROM r",
    "d36_classification_report": f"WITH {_PRED}, k AS (SELECT k, COUNT(*) FILTER (label = k) AS n, COUNT(*) FILTER (pred = k) AS q, COUNT(*) FILTER (label = k AND pred = k) AS tp FROM p, (VALUES (0), (1), (2)) v(k) GROUP BY k) SELECT ROUND(SUM(tp) / SUM(n), 6) AS accuracy, ROUND(AVG(2 * tp / (n + q)), 6) AS macro_f1, ROUND(SUM(2 * tp / (n + q) * n) / SUM(n), 6) AS weighted_f1 FROM k",
    "d36_auc": f"WITH {_PRED}, s AS (SELECT k, label = k AS y, p + CAST(pred = k AS DOUBLE) / (k + 2) AS v FROM p, (VALUES (0), (1), (2)) t(k)), r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY v) + (COUNT(*) OVER (PARTITION BY k, v) - 1) / 2 AS r FROM s), a AS (SELECT k, (SUM(r) FILTER (y) - COUNT(*) FILTER (y) * (COUNT(*) FILTER (y) + 1) / 2) / (COUNT(*) FILTER (y) * COUNT(*) FILTER (NOT y)) AS area FROM r GROUP BY k) SELECT ROUND(AVG(area), 6) AS auc FROM a",
    "s5_load_modes": "WITH u AS (SELECT user_id, MAX(CAST(event_type = 'purchase' AS INT)) AS y, COUNT(*) AS n FROM events GROUP BY 1) SELECT mode, COUNT(*) AS users, ROUND(AVG(y), 6) AS rate, CAST(SUM(n) AS BIGINT) AS behaviours, COUNT(*) AS active_users FROM u, (VALUES ('merged'), ('split'), ('labelled')) m(mode) GROUP BY 1",
    "s1_json_arrays": "SELECT CAST(user_id AS VARCHAR) AS user_id, COUNT(*) AS n, ROUND(SUM(value), 2) AS dwell FROM events GROUP BY 1",
    "d36_confusion": f"WITH {_PRED} SELECT CAST(label AS INT) AS label, CAST(pred AS INT) AS prediction, COUNT(*) AS n FROM p GROUP BY 1, 2",
    "s2_labelled_sets": "WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(user_id IN (SELECT user_id FROM p) AS INT) AS is_lead, COUNT(*) AS n, ROUND(SUM(value), 2) AS dwell FROM events WHERE event_type = 'purchase' OR user_id NOT IN (SELECT user_id FROM p) GROUP BY 1, 2",
    "s3_profiles_last_line": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'later' ELSE c_mktsegment END AS seg, COUNT(*) AS n FROM customer GROUP BY 1",
    "s5_load_summary": f"WITH {SQL} SELECT COUNT(*) AS users, ROUND(AVG(is_lead), 6) AS rate, (SELECT COUNT(*) FROM raw) AS behaviours, (SELECT COUNT(DISTINCT user_id) FROM raw) AS active_users FROM profile",
    "s6_csv_with_check": "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1",
    "s8_partition_range": "SELECT strftime(l_shipdate, '%Y%m') AS pt_d, COUNT(*) AS n FROM lineitem WHERE strftime(l_shipdate, '%Y%m') BETWEEN '199601' AND '199606' GROUP BY 1",
    "s14_append_results": "SELECT c_custkey, c_mktsegment, CAST(length(c_mktsegment) AS INT) AS label FROM customer",
    "s18_triples": "SELECT '<urn:entity:' || c_custkey || '>' AS s, '<urn:entity:p:' || n || '>' AS p, '\"' || v || '\"' AS o FROM (SELECT c_custkey, 'c_name' AS n, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer)",
    "a9_json_fields": "SELECT 'k' AS field, 'integer' AS type, COUNT(*) AS n, 'integer' AS merged FROM events",
    "a9_field_types": "WITH c AS (SELECT c_custkey % 2 = 0 AS flat, c_acctbal FROM customer WHERE c_custkey % 7 <> 0) SELECT * FROM (SELECT f.field, f.type, COUNT(*) AS n, f.merged FROM c JOIN (VALUES (TRUE, 'c_custkey', 'integer', 'integer'), (TRUE, 'c_name', 'text', 'text'), (TRUE, 'c_acctbal', 'number', 'number'), (TRUE, 'nation', 'integer', 'conflict'), (TRUE, 'more', 'object', 'object'), (FALSE, 'nation', 'text', 'conflict'), (FALSE, 'late', 'boolean', 'boolean'), (FALSE, 'list', 'array', 'array')) f(flat, field, type, merged) USING (flat) GROUP BY 1, 2, 4) ORDER BY 1, 2",
}
