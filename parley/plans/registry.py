"""Where query modules register what they offer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql is what DuckDB answers the same with, None where SQL can't."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(name: str, spark_sql: str, duckdb_sql: str | None = None) -> None:
    """Register a query written in SQL; {table} stands for a table. duckdb_sql: its form for DuckDB, if that differs."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", spark_sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in tables})

    query(name, re.sub(r"\{(\w+)\}", r"\1", duckdb_sql or spark_sql))(run)
