"""Writers of findings, schema snapshots and drift baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesight.functions.columns import sanitise
from lakesight.functions.sketches import K, rank_error, sketched
from lakesight.operators.catalog import Catalog
from lakesight.operators.data_drift import baseline_statistics, upsert_baseline, value_counts
from lakesight.operators.schema_drift import snapshot
from lakesight.session import materialise
from lakesight.sources.store import VersionedStore, stores_below


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines without NaN or infinities; NULL fields are kept."""
    sanitise(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    sanitise(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The columns of all schema snapshots below ``path``, None when nothing was stored yet."""
    return _union([s.read_all("columns") for s in stores_below(spark, path)])


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    result = None
    for part in parts:
        if part is not None:
            result = part if result is None else result.unionByName(part)
    return result


def append_schema_snapshot(catalog: Catalog, database: str, path: str, observed: bool = False) -> int:
    """Append the catalog's columns as the database's next numbered snapshot; returns its number.

    Writers at the same time get different numbers, and a snapshot is there as a whole or not at all.
    """
    spark = next(iter(catalog.values())).df.sparkSession
    return VersionedStore(spark, f"{path}/{database}").commit(
        lambda number, last: {"columns": snapshot(catalog, database, number, observed).coalesce(1)})


def save_baseline(df: DataFrame, database: str, table: str, path: str, exact: bool = False, k: int = K) -> DataFrame:
    """Store a table's statistics and distributions, unique per (database, table, column).

    Distributions are quantile sketches of size ``k`` per column, so that a
    baseline is as small for any number of rows; with ``exact`` they are the
    counts of every distinct value. Statistics and distributions become a new
    version together; columns stored before and not in ``df`` are kept.
    """
    store = VersionedStore(df.sparkSession, f"{path}/{database}.{table}")
    fresh = materialise(baseline_statistics(df, database, table))
    kind = "values" if exact else "sketches"
    values = materialise(value_counts(df) if exact else sketched(df, k=k).withColumn("error", F.lit(rank_error(k))))

    def build(number: int, last: int | None) -> dict[str, DataFrame]:
        old, old_values = (None, None) if last is None else (store.read("statistics", last), store.read(kind, last))
        kept = values if old_values is None else values.unionByName(old_values.join(values.select("column_name").distinct(), "column_name", "left_anti"))
        return {"statistics": upsert_baseline(old, fresh).coalesce(1), kind: kept}

    store.commit(build)
    return store.read("statistics")


def load_baseline(spark: SparkSession, database: str, table: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(statistics, sketches or value counts) of the last version of one table's stored baseline."""
    store = VersionedStore(spark, f"{path}/{database}.{table}")
    last = store.versions()[-1]
    sketches = store.read("sketches", last)
    return store.read("statistics", last), store.read("values", last) if sketches is None else sketches


def read_baselines(spark: SparkSession, path: str) -> DataFrame | None:
    """The last statistics of every stored baseline below ``path``."""
    return _union([s.read("statistics") for s in stores_below(spark, path)])
