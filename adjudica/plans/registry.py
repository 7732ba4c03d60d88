"""Names of the runnable queries, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from adjudica.plans import analysis_queries, ingest_queries, market_queries, model_queries, tender_queries

    return [tender_queries, market_queries, model_queries, ingest_queries, analysis_queries]


def queries() -> dict[str, Query]:
    return {name: fn for module in _modules() for name, (fn, _) in module.CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, (_, sql) in module.CATALOGUE.items() if sql}
