"""Where query modules put their queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its DuckDB text."""
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query exists already: {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
