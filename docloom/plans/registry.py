"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Query]:
    """Register a function of a table reader under a name; sql: the same in DuckDB, where SQL can express it."""

    def add(build: Callable) -> Query:
        from ..sources.tables import read

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: read(spark, sf_dir, table))

        run.__name__, run.__doc__ = name, build.__doc__
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return add
