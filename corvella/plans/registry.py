"""Where query modules register what they offer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvella.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*tables: str, oracle: str | None = None):
    """Register a function of the named tables; ``oracle`` is the same query in DuckDB's SQL."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*(read_table(spark, sf_dir, t) for t in tables))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if oracle:
            ORACLE_SQL[build.__name__] = oracle
        return build

    return register
