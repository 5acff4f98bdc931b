"""Catalog, keys and relationships of the given tables, as they are and under entity-style names."""

from pyspark.sql import functions as F

from checks.common import rounded, table
from lakesight.operators import catalog as K

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
    "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
TYPES = {
    "r_regionkey": "int", "n_nationkey": "int", "n_regionkey": "int", "c_nationkey": "int", "s_nationkey": "int",
    "p_size": "int", "l_linenumber": "int", "label": "int", "quality": "int", "toxic": "int",
    "c_custkey": "bigint", "s_suppkey": "bigint", "p_partkey": "bigint", "o_orderkey": "bigint", "o_custkey": "bigint",
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "event_id": "bigint", "user_id": "bigint",
    "doc_id": "bigint", "n_chars": "bigint", "vec_id": "bigint", "page_id": "bigint", "item_id": "bigint",
    "conv_id": "bigint", "turn": "bigint",
    "c_acctbal": "double", "s_acctbal": "double", "p_retailprice": "double", "o_totalprice": "double",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "value": "double",
    "o_orderdate": "timestamp_ntz", "l_shipdate": "timestamp_ntz", "ts": "timestamp_ntz", "embedding": "array<float>",
}
FOREIGN = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
]


def whole(spark, folder):
    return {
        n: K.TableInfo(table(spark, folder, n), KEYS[n], (), tuple(f[1:] for f in FOREIGN if f[0] == n))
        for n in COLUMNS
    }


# the same tables under entity-style names, for the name-based inference
RENAMED = {
    "countries": ("nation", {"n_nationkey": "id", "n_name": "name"}, ["id"], []),
    "customers": ("customer", {"c_custkey": "id", "c_nationkey": "country_id", "c_acctbal": "balance"}, ["id"], []),
    "suppliers": ("supplier", {"s_suppkey": "supplier_id", "s_nationkey": "country_id"}, ["supplier_id"], []),
    "orders": ("orders", {"o_orderkey": "id", "o_custkey": "customer_id", "o_totalprice": "amount"}, ["id"],
               [("customer_id", "customers", "id"), ("branch_id", "branches", "id")]),
    "items": ("lineitem", {"l_orderkey": "order_id", "l_suppkey": "supplier_id", "l_linenumber": "line"}, ["line"], []),
    "documents": ("documents", {"doc_id": "id", "lang": "lang"}, ["id"], []),
}
INFERRED = [
    ("orders", "customer_id", "customers", "id", "EXPLICIT_FK"),
    ("customers", "country_id", "countries", "id", "INFERRED_FK"),
    ("suppliers", "country_id", "countries", "id", "INFERRED_FK"),
    ("items", "order_id", "orders", "id", "INFERRED_FK"),
    ("items", "supplier_id", "suppliers", "supplier_id", "INFERRED_FK"),
]


def renamed(spark, folder):
    result = {}
    for name, (source, names, keys, foreign) in RENAMED.items():
        df = table(spark, folder, source).select(*[F.col(old).alias(new) for old, new in names.items()])
        result[name] = K.TableInfo(df, keys, (), tuple(foreign))
    return result


def _original(name, column):
    source, names, _, _ = RENAMED[name]
    return source, next(old for old, new in names.items() if new == column)


def inclusion_sql(edges, original=lambda t, c: (t, c)):
    parts = []
    for source, column, target, other in edges:
        (a, x), (b, y) = original(source, column), original(target, other)
        parts.append(f"""SELECT '{source}' AS source, '{column}' AS source_column, '{target}' AS target,
            '{other}' AS target_column, count(DISTINCT {x}) AS distinct_keys,
            count(DISTINCT {x}) FILTER (WHERE {x} IN (SELECT {y} FROM {b})) AS matched_keys,
            {rounded(f'coalesce(count(DISTINCT {x}) FILTER (WHERE {x} IN (SELECT {y} FROM {b})) * 1.0 / nullif(count(DISTINCT {x}), 0), 0)', 4)} AS inclusion
          FROM {a}""")
    return "\nUNION ALL\n".join(parts)


def edges_with_inclusion(spark, folder):
    """Inferred and declared edges joined with the check of each on the data."""
    catalog = renamed(spark, folder)
    edges = K.relationships(catalog)
    pairs = [tuple(e[c] for c in K.EDGES[:4]) for e in edges.collect()]
    return edges.drop("label").join(K.inclusion(catalog, pairs), list(K.EDGES[:4]))


EDGE_TYPES = ", ".join(str(e) for e in INFERRED)
COUNTS = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, {len(c)} AS column_count, count(*) AS row_count FROM {n}" for n, c in COLUMNS.items())

QUERIES = {
    "catalog_table_counts": lambda s, d: K.table_counts(whole(s, d)),
    "catalog_totals": lambda s, d: K.catalog_totals(whole(s, d)),
    "catalog_observed_columns": lambda s, d: K.observed_columns(whole(s, d)),
    "catalog_key_verification": lambda s, d: K.verify_keys(whole(s, d)),
    "relationship_inclusion_declared": lambda s, d: K.inclusion(whole(s, d), FOREIGN),
    "relationship_edges_verified": edges_with_inclusion,
    "relationship_nodes": lambda s, d: K.nodes(renamed(s, d)),
    "relationship_roots": lambda s, d: K.root_entities(renamed(s, d)).join(K.table_counts(renamed(s, d)), "table_name"),
}

ORACLE = {
    "catalog_table_counts": COUNTS,
    "catalog_totals": f"""SELECT count(*) AS table_count, CAST(sum(column_count) AS BIGINT) AS total_columns,
        CAST(sum(row_count) AS BIGINT) AS total_rows FROM ({COUNTS})""",
    "catalog_observed_columns": "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{TYPES.get(c, 'string')}' AS type,
          {str(c in KEYS[t]).lower()} AS primary_key, {str(c in KEYS[t]).lower()} AS is_unique,
          {str(any(f[0] == t and f[1] == c for f in FOREIGN)).lower()} AS foreign_key,
          count(*) - count({c}) AS null_count, count(*) > count({c}) AS nullable FROM {t}"""
        for t, columns in COLUMNS.items() for i, c in enumerate(columns)),
    "catalog_key_verification": "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS table_name, '{', '.join(k)}' AS primary_key, CAST(sum(n) AS BIGINT) AS row_count,
          CAST(coalesce(sum(n) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in k)}), 0) AS BIGINT) AS null_rows,
          CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
          sum(n - 1) = 0 AND coalesce(sum(n) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in k)}), 0) = 0 AS valid
        FROM (SELECT {', '.join(k)}, count(*) AS n FROM {t} GROUP BY ALL)""" for t, k in KEYS.items()),
    "relationship_inclusion_declared": inclusion_sql(FOREIGN),
    "relationship_edges_verified": f"""SELECT * FROM (VALUES {EDGE_TYPES})
        e(source, source_column, target, target_column, relationship_type)
      JOIN ({inclusion_sql([e[:4] for e in INFERRED], _original)}) i USING (source, source_column, target, target_column)""",
    "relationship_nodes": "\nUNION ALL\n".join(
        f"""SELECT '{n}' AS table_name, {len(names)} AS column_count, count(*) AS row_count,
          '{', '.join(names.values())}' AS columns, '{', '.join(keys)}' AS primary_keys FROM {source}"""
        for n, (source, names, keys, _) in RENAMED.items()),
    "relationship_roots": "\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, {len(RENAMED[n][1])} AS column_count, count(*) AS row_count FROM {RENAMED[n][0]}"
        for n in ("countries", "documents")),
}
