"""Helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(expression: str, digits: int) -> str:
    """SQL for half-up rounding of a double's shortest decimal form, which is how Spark rounds doubles."""
    return f"CAST(round(CAST(CAST(CAST({expression} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def percent(part: str, whole: str) -> str:
    return rounded(f"coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0) * 100, 0)", 2)
