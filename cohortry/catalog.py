"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import audience_queries, extra_queries, model_queries, need_queries, stream_queries, web_queries, wide_queries

FLAGSHIP = "d1_rule_lift"
MODULES = (audience_queries, wide_queries, need_queries, web_queries, model_queries, stream_queries, extra_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
