"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.plans import contract_queries, feature_queries, order_queries, record_queries, relational_queries, shape_queries, signal_queries, source_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**shape_queries.QUERIES, **signal_queries.QUERIES, **record_queries.QUERIES, **relational_queries.QUERIES, **contract_queries.QUERIES, **feature_queries.QUERIES, **order_queries.QUERIES, **source_queries.QUERIES, **table_queries.QUERIES}
SQL: dict[str, str] = {**shape_queries.SQL, **signal_queries.SQL, **record_queries.SQL, **relational_queries.SQL, **contract_queries.SQL, **feature_queries.SQL, **order_queries.SQL, **source_queries.SQL, **table_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["nearest_reference_decision"](spark, sf_dir)
