"""Registered queries, each with the SQL that computes the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    query: Query
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(query: Query) -> Query:
        key = name or query.__name__
        if key in PLANS:
            raise ValueError(f"query {key} is registered twice")
        PLANS[key] = Plan(query, sql)
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
