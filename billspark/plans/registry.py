"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL over the base tables that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table as it lies."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def half_even(numerator: str, denominator: str) -> str:
    """SQL for numerator / denominator of integers, rounded to an even neighbour on ties."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return (
        f"CAST(({n} // {d}) + CASE WHEN 2 * ({n} % {d}) > {d} OR "
        f"(2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT)"
    )
