"""Schema snapshots and the changes between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesight.operators.catalog import Catalog, column_metadata, observed_columns

# Statuses and the severity of each kind of change.
STABLE, DRIFTED, INITIAL, DROPPED = "STABLE", "DRIFT_DETECTED", "INITIAL_BASELINE", "TABLE_DROPPED"
SEVERITY_OF = {"removed": "CRITICAL", "modified": "HIGH", "added": "MEDIUM"}


def snapshot(catalog: Catalog, database: str, taken: int, observed: bool = False) -> DataFrame:
    """One row per column: (database_name, taken, table_name, column_name, type, nullable, primary_key).

    ``taken`` numbers the snapshots. Nullability is the declared one and no data
    is read; ``observed`` finds out which columns hold a NULL instead.
    """
    columns = observed_columns(catalog) if observed else column_metadata(catalog)
    return columns.select(
        F.lit(database).alias("database_name"), F.lit(taken).alias("taken"), "table_name", "column_name",
        "type", "nullable", "primary_key",
    )


def schema_hashes(columns: DataFrame) -> DataFrame:
    """SHA-256 per table over its columns in name order, each as name:type:nullable:key."""
    flag = lambda c: F.initcap(F.col(c).cast("string"))
    text = F.concat_ws(":", "column_name", "type", flag("nullable"), flag("primary_key"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("column_name").alias("n"), text.alias("t"))))
    return columns.groupBy("database_name", "taken", "table_name").agg(
        F.count("*").alias("column_count"),
        F.sha2(F.array_join(F.transform(ordered, lambda c: c["t"]), "|"), 256).alias("schema_hash"),
    )


def baseline_of(history: DataFrame) -> DataFrame:
    """Per table, the older of its last two snapshots."""
    latest = Window.partitionBy("database_name", "table_name").orderBy(F.desc("taken"))
    ranked = history.withColumn("_age", F.dense_rank().over(latest)).filter("_age <= 2")
    oldest = Window.partitionBy("database_name", "table_name")
    return ranked.withColumn("_oldest", F.max("_age").over(oldest)).filter("_age = _oldest").drop("_age", "_oldest")


def column_changes(current: DataFrame, history: DataFrame) -> DataFrame:
    """Added, removed and retyped columns of tables known on both sides."""
    old = baseline_of(history).select(
        "database_name", "table_name", "column_name", F.upper("type").alias("old_type"))
    new = current.select("database_name", "table_name", "column_name", F.upper("type").alias("new_type"))
    both = old.select("database_name", "table_name").distinct().join(
        new.select("database_name", "table_name").distinct(), ["database_name", "table_name"])
    joined = old.join(new, ["database_name", "table_name", "column_name"], "full")
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "modified")
    )
    return joined.withColumn("change", change).filter("change is not null").join(
        both, ["database_name", "table_name"], "left_semi")


def detect_schema_drift(current: DataFrame, history: DataFrame) -> DataFrame:
    """Status, severity and current hash per table: compared, first seen, or dropped since."""
    key = ["database_name", "table_name"]
    changes = column_changes(current, history).groupBy(*key).agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("column_name")))), ", ").alias(f"{kind}_columns")
        for kind in SEVERITY_OF
    ])
    now = current.groupBy(*key).agg(F.count("*").alias("current_columns_count"))
    before = baseline_of(history).groupBy(*key).agg(F.count("*").alias("baseline_columns_count"))
    hashes = schema_hashes(current).select(*key, "schema_hash")
    tables = now.join(before, key, "full").join(changes, key, "left").join(hashes, key, "left").fillna(
        "", [f"{kind}_columns" for kind in SEVERITY_OF])
    changed = F.concat_ws("", *[f"{kind}_columns" for kind in SEVERITY_OF]) != ""
    status = (
        F.when(F.col("current_columns_count").isNull(), DROPPED)
        .when(F.col("baseline_columns_count").isNull(), INITIAL)
        .when(changed, DRIFTED)
        .otherwise(STABLE)
    )
    severity = F.when(F.col("status") == DROPPED, "CRITICAL")
    for kind, level in SEVERITY_OF.items():
        severity = severity.when(F.col(f"{kind}_columns") != "", level)
    return tables.withColumn("status", status).select(
        *key,
        "status",
        severity.otherwise("NONE").alias("severity"),
        F.col("status").isin(DROPPED, DRIFTED).alias("drift_detected"),
        *[f"{kind}_columns" for kind in SEVERITY_OF],
        F.coalesce("current_columns_count", F.lit(0)).alias("current_columns_count"),
        F.coalesce("baseline_columns_count", F.lit(0)).alias("baseline_columns_count"),
        "schema_hash",
    )


def overall_status(tables: DataFrame) -> DataFrame:
    drifts = F.count_if("drift_detected")
    return tables.agg(
        F.count("*").alias("total_tables"),
        drifts.alias("drift_detected_count"),
        F.when(F.count_if(F.col("severity") == "CRITICAL") > 0, "CRITICAL_DRIFT")
        .when(drifts > 0, "DRIFT_DETECTED").otherwise("STABLE").alias("overall_status"),
    )
