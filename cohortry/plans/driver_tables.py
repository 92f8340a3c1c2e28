"""The given tables seen as profiles, behaviour events, facts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables end with these events; "now" of all jobs over them.
RUN_DATE = "2024-02-01"
#: Purchases that make a lead.
LEAD_PURCHASES = 14

# (event type, number modulo 4) of the given events as a kind of behaviour; purchases are the target.
KINDS = {
    ("view", 0): "view_car_detail",
    ("view", 1): "view_loan_calc",
    ("view", 2): "view_car_compare",
    ("view", 3): "view_floor_price",
    ("click", 0): "ad_click",
    ("click", 1): "search_general",
    ("click", 2): "search_vertical",
    ("click", 3): "view_short_video",
    ("signup", 0): "pass_dealership",
    ("signup", 1): "test_drive",
    ("signup", 2): "view_contact_sales",
    ("signup", 3): "map_app_use",
    ("error", 0): "search_entertainment",
    ("error", 1): "rental_app_use",
    ("error", 2): "order_placed",
    ("error", 3): "map_app_use",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, event_type, event_time, dwell, brand, model, attrs)``; a brand of 0 is none."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "purchase", F.lit("lead_submit"))
    for (given, n), name in KINDS.items():
        kind = kind.when((F.col("event_type") == given) & (k % 4 == n), F.lit(name))
    brand = F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("b"), (k % 10).cast("string")))
    model = F.concat(F.lit("m"), (k % 25).cast("string"))
    return e.select(
        "user_id",
        kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("event_time"),
        (F.col("value") * 10).alias("dwell"),
        brand.alias("brand"),
        model.alias("model"),
        F.to_json(F.struct(brand.alias("brand"), model.alias("model"), k.alias("k"))).alias("attrs"),
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, segment, nation, balance, is_lead)`` of customers with events."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") >= LEAD_PURCHASES).cast("int").alias("is_lead"))
    c = table(spark, sf_dir, "customer")
    return c.join(e, c["c_custkey"] == e["user_id"]).select("user_id", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "is_lead")


#: The same two tables for DuckDB, as leading common table expressions.
SQL = (
    """raw AS (
  SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'lead_submit' """
    + " ".join(f"WHEN event_type = '{t}' AND k % 4 = {n} THEN '{kind}'" for (t, n), kind in KINDS.items())
    + """ END AS event_type, CAST(ts AS TIMESTAMP) AS event_time, value * 10 AS dwell,
         CASE WHEN k % 10 = 0 THEN NULL ELSE 'b' || (k % 10) END AS brand, 'm' || (k % 25) AS model, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
), profile AS (
  SELECT c_custkey AS user_id, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance, is_lead
  FROM customer JOIN (SELECT user_id, CAST(COUNT(*) FILTER (event_type = 'purchase') >= """
    + str(LEAD_PURCHASES)
    + """ AS INT) AS is_lead FROM events GROUP BY user_id) ON c_custkey = user_id
)"""
)
