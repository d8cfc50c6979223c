"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import core_problems, query_documents, query_extra, query_graph, query_predicates

MODULES = [core_problems, query_predicates, query_documents, query_graph, query_extra]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """A grouped event query over line items."""
    return query_documents.QUERIES["group_by_sum"](spark, folder)
