"""Relational databases through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

# JDBC driver classes by URL prefix; the jars are the cluster's.
DRIVERS = {
    "jdbc:postgresql:": "org.postgresql.Driver",
    "jdbc:mysql:": "com.mysql.cj.jdbc.Driver",
    "jdbc:mariadb:": "org.mariadb.jdbc.Driver",
    "jdbc:sqlserver:": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "jdbc:sqlite:": "org.sqlite.JDBC",
    "jdbc:duckdb:": "org.duckdb.DuckDBDriver",
}


@dataclass(frozen=True)
class Split:
    """Equal-width ranges of a numeric or time column that are read in parallel."""

    column: str
    lower: str
    upper: str
    partitions: int


def jdbc_options(url: str, table: str, split: Split | None = None, fetch_rows: int = 10_000, **more: str) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows), **more}
    for prefix, driver in DRIVERS.items():
        if url.startswith(prefix):
            options.setdefault("driver", driver)
    if split:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
            "numPartitions": str(split.partitions),
        }
    return options


def histogram_query(table: str, column: str, buckets: int) -> str:
    """SQL for the database: (low, high, rows) of ``buckets`` ranges of about equally many rows; a null range has null ends.

    Rows of one value stay together, so a frequent value is a range of its own.
    """
    return f"""SELECT min({column}) AS low, max({column}) AS high, count(*) AS n FROM
        (SELECT {column}, min(tile) OVER (PARTITION BY {column}) AS part FROM
          (SELECT {column}, ntile({buckets}) OVER (ORDER BY {column}) AS tile FROM {table}) t) u
        GROUP BY CASE WHEN {column} IS NULL THEN -1 ELSE part END ORDER BY 1"""


def predicates(column: str, buckets: Sequence[tuple], quote: str = "'") -> list[str]:
    """One predicate per range of a histogram (low, high, rows), and one for nulls: every row fits exactly one.

    Ranges are half-open up to the next one's low end, and the outer ones have
    no end, so rows that arrive between the histogram and the read are read too.
    """
    text = lambda v: str(v) if isinstance(v, (int, float, Decimal)) else f"{quote}{str(v).replace(quote, quote * 2)}{quote}"
    lows = sorted({low for low, _, _ in buckets if low is not None})
    cuts = lows[1:]
    if not cuts:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inner = [f"{column} >= {text(a)} AND {column} < {text(b)}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {text(cuts[0])}", *inner, f"{column} >= {text(cuts[-1])}", f"{column} IS NULL"]


def read_balanced(spark: SparkSession, url: str, table: str, column: str, partitions: int, **more: str) -> DataFrame:
    """A database table in parallel ranges that follow the data: the database counts its own histogram first."""
    options = jdbc_options(url, f"({histogram_query(table, column, partitions)}) h", **more)
    buckets = [(r[0], r[1], r[2]) for r in spark.read.format("jdbc").options(**options).load().collect()]  # a row per range
    own = {k: v for k, v in jdbc_options(url, table, **more).items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(url, table, predicates=predicates(column, buckets), properties=own)


def read_table(spark: SparkSession, url: str, table: str, split: Split | None = None, **more: str) -> DataFrame:
    """A database table; filters, columns and limits are pushed to the database by Spark.

    Without ``split`` the table is read by one task.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, table, split, **more)).load()
