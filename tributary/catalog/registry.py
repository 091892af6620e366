"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.sources.corpus import check_sql, corpus_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None, steps: dict[str, str] | None = None,
          sql_views: list[str] | None = None):
    """Register ``build(*views)`` under ``name``; ``sql`` states the same result for DuckDB."""

    def register(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*[corpus_view(spark, sf_dir, view) for view in views])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = check_sql(sql_views if sql_views is not None else list(views), sql, steps)
        return build

    return register
