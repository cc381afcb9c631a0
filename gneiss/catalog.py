"""All queries of the library and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.plans import code_queries, graph_queries, history_queries, text_queries
from gneiss.session import importable

Query = Callable[[SparkSession, str], DataFrame]

_GROUPS = (history_queries.QUERIES, graph_queries.QUERIES, text_queries.QUERIES, code_queries.QUERIES)


def _ready(query: Query) -> Query:
    return lambda spark, sf_dir: query(importable(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {name: _ready(query) for group in _GROUPS for name, (query, _) in group.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, (_, sql) in group.items() if sql}
