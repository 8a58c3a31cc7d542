"""All queries over the tables with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import eval_queries, graph_queries, kg_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (kg_queries, graph_queries, eval_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
