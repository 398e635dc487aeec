"""All registered queries and their SQL reference answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans import analytics_catalog, analytics_sql, eval_catalog, graph_catalog, graph_catalog_sql, text_catalog, text_sql
from riskloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]


def _configured(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)
    return run


def queries() -> dict[str, Query]:
    return {name: _configured(query) for name, query in {
        **analytics_catalog.QUERIES,
        **graph_catalog.QUERIES,
        **text_catalog.QUERIES,
        **eval_catalog.QUERIES,
    }.items()}


def oracle_sql() -> dict[str, str]:
    return {
        **analytics_sql.ORACLES,
        **graph_catalog_sql.ORACLES,
        **text_sql.ORACLES,
    }
