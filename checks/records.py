"""Lineage and run-log tables derived from conversations and events."""

from pyspark.sql import functions as F

from checks.common import table
from lakesight.operators import lineage as L


def turn_records(spark, folder):
    """Every turn is an item derived from the turn before it; first turns read the conversation table.

    Turns are recorded twice, so that the newest record of an item matters, and
    every seventh conversation's first turn points back to its third: a cycle.
    """
    turns = table(spark, folder, "conversations")
    item = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    parent = F.when(F.col("turn") > 0, item(F.col("turn") - 1)).when(F.col("conv_id") % 7 == 0, item(F.lit(2)))
    return turns.select(
        "conv_id", "turn", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"),
        item(F.col("turn")).alias("item_id"), parent.alias("parent_id"), "role",
    ).select(
        (F.col("again") * 1_000_000_000 + F.col("conv_id") * 1_000 + F.col("turn")).alias("id"),
        F.upper("role").alias("item_type"),
        "item_id",
        F.format_string("%s, record %d", F.col("role"), F.col("again")).alias("item_label"),
        F.lit("chat").alias("source_db"),
        F.when(F.col("turn") == 0, "conversations").alias("source_table"),
        F.lit("SELECT 1").alias("source_query"),
        "parent_id",
    )


RECORDS = """(SELECT again * 1000000000 + conv_id * 1000 + turn AS id, upper(role) AS item_type,
    conv_id || '-' || turn AS item_id, role || ', record ' || again AS item_label, 'chat' AS source_db,
    CASE WHEN turn = 0 THEN 'conversations' END AS source_table, 'SELECT 1' AS source_query,
    CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) WHEN conv_id % 7 = 0 THEN conv_id || '-2' END AS parent_id
  FROM conversations, (VALUES (0), (1)) a(again))"""


def last_turns(spark, folder):
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"))


def event_log(spark, folder):
    """Events as a run log."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.upper("event_type").alias("action"),
        F.when(F.col("value") > 100, "VIOLATION").otherwise("PASSED").alias("status"),
        F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("database_name"),
    )


LOG = """(SELECT event_id AS id, ts AS created_at, upper(event_type) AS action,
    CASE WHEN value > 100 THEN 'VIOLATION' ELSE 'PASSED' END AS status, 'db' || (user_id % 3) AS database_name FROM events)"""
LATEST = f"(SELECT * FROM {RECORDS} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY id DESC) = 1)"

QUERIES = {
    "lineage_latest_records": lambda s, d: L.latest_records(turn_records(s, d)),
    "lineage_chains": lambda s, d: L.lineage_chains(turn_records(s, d), last_turns(s, d)),
    "lineage_graph_nodes": lambda s, d: L.graph_nodes(turn_records(s, d)),
    "lineage_graph_links": lambda s, d: L.graph_links(turn_records(s, d)),
    "run_log_page": lambda s, d: L.log_page(event_log(s, d), 50, 100, action="CLICK", database="db1"),
    "run_log_count": lambda s, d: L.log_count(event_log(s, d), status="VIOLATION"),
}

ORACLE = {
    "lineage_latest_records": f"SELECT * FROM {LATEST}",
    "lineage_chains": f"""WITH RECURSIVE latest AS {LATEST},
      chain AS (SELECT item_id AS start_id, 0 AS depth, l.*, [item_id] AS seen FROM latest l
          WHERE item_id IN (SELECT conv_id || '-' || max(turn) FROM conversations GROUP BY conv_id)
        UNION ALL SELECT start_id, depth + 1, l.*, list_append(seen, l.item_id) FROM chain c JOIN latest l
          ON l.item_id = c.parent_id WHERE NOT list_contains(seen, l.item_id))
      SELECT * EXCLUDE (seen) FROM chain""",
    "lineage_graph_nodes": f"""WITH n AS {RECORDS}
      SELECT node, item_type AS type, item_label AS label, source_db, source_table FROM
        (SELECT *, item_type || ':' || item_id AS node FROM n
         QUALIFY row_number() OVER (PARTITION BY item_type, item_id ORDER BY id DESC) = 1)
      UNION SELECT 'TABLE:' || source_db || '.' || source_table, 'TABLE', source_db || '.' || source_table, source_db, source_table
        FROM n WHERE parent_id IS NULL AND source_table IS NOT NULL""",
    "lineage_graph_links": f"""SELECT coalesce(parent_id, 'TABLE:' || source_db || '.' || source_table) AS source,
        item_type || ':' || item_id AS target, CASE WHEN parent_id IS NULL THEN 'QUERIES' ELSE 'DERIVED_FROM' END AS relation
      FROM {RECORDS} WHERE parent_id IS NOT NULL OR source_table IS NOT NULL""",
    "run_log_page": f"SELECT * FROM {LOG} WHERE action = 'CLICK' AND database_name = 'db1' ORDER BY id DESC LIMIT 50 OFFSET 100",
    "run_log_count": f"SELECT count(*) AS total FROM {LOG} WHERE status = 'VIOLATION'",
}
