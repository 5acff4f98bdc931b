"""Lineage records and run logs as tables: chains, graph and filtered pages.

Records are rows (id, item_type, item_id, item_label, source_db, source_table,
source_query, parent_id); the row with the largest id of an item is its latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesight.session import materialise

PAGE_ROWS = 100


def latest_records(records: DataFrame) -> DataFrame:
    """The newest record of every item."""
    others = [c for c in records.columns if c != "item_id"]
    newest = records.groupBy("item_id").agg(F.max_by(F.struct(*others), "id").alias("r"))
    return newest.select("item_id", "r.*")


def lineage_chains(records: DataFrame, starts: DataFrame) -> DataFrame:
    """Every item on the way from each start to its root: (start_id, depth, item_id, ...).

    Links are doubled in every round (parent, grandparent, 4, 8 ... steps up),
    so a chain of any length takes a logarithmic number of joins. An item met
    twice keeps its smallest depth, which also ends cycles.
    """
    latest = materialise(latest_records(records))
    step = latest.select("item_id", F.col("parent_id").alias("up")).filter("up is not null")
    known = latest.select(F.col("item_id").alias("up"))
    jumps = materialise(step.join(known, "up", "left_semi").select("item_id", "up"))
    reached = starts.select(F.col("item_id").alias("start_id")).distinct()
    reached = materialise(
        reached.join(latest.select(F.col("item_id").alias("start_id")), "start_id", "left_semi")
        .select("start_id", F.col("start_id").alias("item_id"), F.lit(0).cast("long").alias("depth"))
    )
    distance, size = 1, reached.count()
    while True:
        further = reached.join(jumps, "item_id").select(
            "start_id", F.col("up").alias("item_id"), (F.col("depth") + distance).alias("depth"))
        reached = materialise(
            reached.unionByName(further).groupBy("start_id", "item_id").agg(F.min("depth").alias("depth")))
        grown = reached.count()
        if grown == size:
            break
        size, distance = grown, distance * 2
        onward = jumps.select(F.col("item_id").alias("up"), F.col("up").alias("far"))
        jumps = materialise(jumps.join(onward, "up").select("item_id", F.col("far").alias("up")))
    return reached.join(latest, "item_id").select("start_id", "depth", *records.columns)


def newest_records(records: DataFrame, limit: int | None = None) -> DataFrame:
    """All records, or the ``limit`` newest."""
    return records if limit is None else records.orderBy(F.desc("id")).limit(limit)


def _node_id(kind: Column, item: Column) -> Column:
    return F.concat_ws(":", kind, item)


def _table_name() -> Column:
    return F.concat(F.coalesce("source_db", F.lit("None")), F.lit("."), F.col("source_table"))


def _table_id() -> Column:
    return F.concat(F.lit("TABLE:"), _table_name())


def graph_nodes(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of the newest records, each once, and the tables that items without parent read."""
    recent = newest_records(records, limit)
    items = (
        recent.withColumn("node", _node_id(F.col("item_type"), F.col("item_id")))
        .groupBy("node")
        .agg(F.max_by(F.struct("item_type", "item_label", "source_db", "source_table"), "id").alias("r"))
        .select("node", F.col("r.item_type").alias("type"), F.col("r.item_label").alias("label"), "r.source_db", "r.source_table")
    )
    tables = (
        recent.filter("coalesce(parent_id, '') = '' and coalesce(source_table, '') <> ''")
        .select(
            _table_id().alias("node"), F.lit("TABLE").alias("type"), _table_name().alias("label"),
            "source_db", "source_table")
        .dropDuplicates(["node"])
    )
    return items.unionByName(tables.join(items.select("node"), "node", "left_anti"))


def graph_links(records: DataFrame, limit: int | None = None) -> DataFrame:
    """DERIVED_FROM links to parents, QUERIES links to source tables."""
    node = _node_id(F.col("item_type"), F.col("item_id"))
    has_parent = F.coalesce("parent_id", F.lit("")) != ""
    return newest_records(records, limit).filter(has_parent | (F.coalesce("source_table", F.lit("")) != "")).select(
        F.when(has_parent, F.col("parent_id")).otherwise(_table_id()).alias("source"),
        node.alias("target"),
        F.when(has_parent, "DERIVED_FROM").otherwise("QUERIES").alias("relation"),
    )


def filter_log(
    log: DataFrame, action: str | None = None, status: str | None = None, database: str | None = None
) -> DataFrame:
    """Run-log rows (id, created_at, action, status, database_name, ...) that match all given filters."""
    for column, wanted in (("action", action), ("status", status), ("database_name", database)):
        if wanted is not None:
            log = log.filter(F.col(column) == wanted)
    return log


def log_page(log: DataFrame, limit: int = PAGE_ROWS, offset: int = 0, **filters) -> DataFrame:
    """One page of the log, newest first."""
    return filter_log(log, **filters).orderBy(F.desc("id")).offset(offset).limit(limit)


def log_count(log: DataFrame, **filters) -> DataFrame:
    return filter_log(log, **filters).agg(F.count("*").alias("total"))
