"""Usage bucketed by account: later verticals move no facts."""

from pyspark.sql import functions as F

from cohortry.operators import wide_table as T
from cohortry.plans import wide_queries as Q


def test_a_vertical_from_bucketed_usage_moves_the_pool_only(spark, sf):
    usage = T.write_usage(Q.usage(spark, sf), Q.binding(spark, sf), "bucketed_usage", 4)
    pool = usage.select("account").distinct().orderBy("account").limit(20).withColumn("sample_label", F.lit("x"))
    pool.write.mode("overwrite").saveAsTable("bucketed_pool")
    pool = spark.table("bucketed_pool")
    out = T.apps_of_accounts(Q.LOAN, pool, usage)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan, plan
    assert out.count() == 20
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = T.apps_of_accounts(Q.PAYMENT, pool, usage)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The pool, which is not bucketed, moves to the texts' buckets.
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("Bucketed: true"), plan
    spark.sql("DROP TABLE bucketed_usage")
    spark.sql("DROP TABLE bucketed_pool")
