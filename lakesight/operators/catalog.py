"""Tables, columns, keys and the relationships between tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesight.functions import columns as C
from lakesight.session import small_frame

ID_SUFFIX = "_id"  # fixed value: a column X_id points to the table X, Xs, Xes or, for X ending in y, ..ies


@dataclass(frozen=True)
class TableInfo:
    """A table with the keys its files cannot declare.

    ``foreign_keys`` are (column, other table, other column).
    """

    df: DataFrame
    primary_keys: Sequence[str] = ()
    unique_columns: Sequence[str] = ()
    foreign_keys: Sequence[tuple[str, str, str]] = field(default_factory=tuple)


Catalog = dict[str, TableInfo]


def _spark(catalog: Catalog):
    return next(iter(catalog.values())).df.sparkSession


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def table_counts(catalog: Catalog) -> DataFrame:
    """(table_name, column_count, row_count); file sources answer the count from their footers."""
    return _union([
        t.df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(len(t.df.columns)).alias("column_count"), "row_count")
        for name, t in catalog.items()
    ])


def catalog_totals(catalog: Catalog) -> DataFrame:
    return table_counts(catalog).agg(
        F.count("*").alias("table_count"),
        F.sum("column_count").alias("total_columns"),
        F.sum("row_count").alias("total_rows"),
    )


def column_metadata(catalog: Catalog) -> DataFrame:
    """Declared facts of every column; no data is read."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.nullable, f.name in t.primary_keys,
         f.name in t.primary_keys or f.name in t.unique_columns, any(fk[0] == f.name for fk in t.foreign_keys))
        for name, t in catalog.items()
        for i, f in enumerate(t.df.schema.fields)
    ]
    return small_frame(
        _spark(catalog), rows,
        "table_name string, ordinal int, column_name string, type string, nullable boolean, "
        "primary_key boolean, is_unique boolean, foreign_key boolean",
    )


def observed_columns(catalog: Catalog) -> DataFrame:
    """Column metadata with nullability as seen in the data: files carry no constraints."""
    seen = _union([
        t.df.agg(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.count_if(C.present(t.df, c).isNull()).alias("null_count"))
            for c in t.df.columns
        ]).alias("c")).select(F.lit(name).alias("table_name"), F.inline("c"))
        for name, t in catalog.items()
    ])
    return (
        column_metadata(catalog).drop("nullable").join(seen, ["table_name", "column_name"])
        .withColumn("nullable", F.col("null_count") > 0)
    )


def verify_keys(catalog: Catalog) -> DataFrame:
    """Whether each declared primary key, taken as a whole, is free of NULLs and repeats."""
    parts = []
    for name, t in catalog.items():
        if not t.primary_keys:
            continue
        keys = [C.present(t.df, k).alias(k) for k in t.primary_keys]
        any_null = F.lit(False)
        for k in t.primary_keys:
            any_null = any_null | C.named(k).isNull()
        # each key value is counted before the shuffle, so a hot key is one row per task
        grouped = t.df.select(*keys).groupBy(*[C.named(k) for k in t.primary_keys]).count()
        repeats = F.coalesce(F.sum(F.col("count") - 1), F.lit(0))
        nulls = F.coalesce(F.sum(F.when(any_null, F.col("count"))), F.lit(0))
        parts.append(grouped.agg(
            F.lit(name).alias("table_name"),
            F.lit(", ".join(t.primary_keys)).alias("primary_key"),
            F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"),
            nulls.alias("null_rows"),
            repeats.alias("duplicate_rows"),
            ((nulls == 0) & (repeats == 0)).alias("valid"),
        ))
    return _union(parts)


EDGES = ("source", "source_column", "target", "target_column", "relationship_type")


def explicit_edges(catalog: Catalog) -> DataFrame:
    """Declared foreign keys whose other table is known."""
    rows = [(name, *fk) for name, t in catalog.items() for fk in t.foreign_keys]
    declared = small_frame(
        _spark(catalog), rows, "source string, source_column string, target string, target_column string")
    known = small_frame(_spark(catalog), [(n,) for n in catalog], "target string")
    return declared.join(known, "target", "left_semi").dropDuplicates().withColumn("relationship_type", F.lit("EXPLICIT_FK"))


def inferred_edges(catalog: Catalog) -> DataFrame:
    """Foreign keys read from names: column X_id and a table named after X with a fitting key."""
    meta = column_metadata(catalog)
    keys = meta.filter("primary_key").select(
        F.col("table_name").alias("target"), F.col("column_name").alias("target_key"))
    entity = F.expr(f"left(lower(column_name), length(column_name) - {len(ID_SUFFIX)})")
    guesses = F.array_compact(F.array(
        entity,
        F.concat(entity, F.lit("s")),
        F.concat(entity, F.lit("es")),
        F.when(entity.endswith("y"), F.concat(F.regexp_replace(entity, "y$", ""), F.lit("ies"))),
    ))
    candidates = (
        meta.filter(~F.col("primary_key") & F.lower("column_name").endswith(ID_SUFFIX))
        .select("table_name", "column_name", F.posexplode(guesses).alias("guess", "target"))
        .filter(F.col("target") != F.col("table_name"))
        .join(keys, "target")
    )
    own_name = F.lower("target_key") == F.lower("column_name")
    has_id = F.lower("target_key") == "id"
    first = Window.partitionBy("table_name", "column_name").orderBy("guess", F.desc(has_id))
    return (
        candidates.filter(has_id | own_name)
        .withColumn("_r", F.row_number().over(first)).filter("_r = 1")
        .select(
            F.col("table_name").alias("source"),
            F.col("column_name").alias("source_column"),
            "target",
            F.when(has_id, "id").otherwise(F.col("column_name")).alias("target_column"),
            F.lit("INFERRED_FK").alias("relationship_type"),
        )
    )


def relationships(catalog: Catalog) -> DataFrame:
    """Declared edges, then inferred ones that are not declared."""
    declared = explicit_edges(catalog).select(*EDGES)
    inferred = inferred_edges(catalog).join(declared, list(EDGES[:4]), "left_anti").select(*EDGES)
    return declared.unionByName(inferred).withColumn(
        "label", F.concat_ws("", "source", F.lit("."), "source_column", F.lit(" -> "), "target", F.lit("."), "target_column"))


def nodes(catalog: Catalog) -> DataFrame:
    """One node per table with its size, columns and keys."""
    info = column_metadata(catalog).groupBy("table_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]), ", ").alias("columns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("primary_key"), F.struct("ordinal", "column_name")))), lambda c: c["column_name"]), ", ").alias("primary_keys"),
    )
    return table_counts(catalog).join(info, "table_name")


def root_entities(catalog: Catalog, edges: DataFrame | None = None) -> DataFrame:
    """Tables that point to no other; the first table when every one does."""
    edges = relationships(catalog) if edges is None else edges
    listed = small_frame(_spark(catalog), [(i, n) for i, n in enumerate(catalog)], "ordinal int, table_name string")
    sources = edges.select(F.col("source").alias("table_name"), F.lit(True).alias("is_source")).distinct()
    marked = listed.join(sources, "table_name", "left").withColumn("root", F.col("is_source").isNull())
    ranked = marked.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("root"), "ordinal")))
    return ranked.filter(F.col("root") | (F.col("_r") == 1)).select("table_name")


def inclusion(catalog: Catalog, edges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """How many distinct child keys of each edge exist in the parent.

    Both sides are reduced to distinct keys before they meet, so a key shared
    by a third of all rows is one row in the join.
    """
    parts = []
    for source, column, target, other in edges:
        child = catalog[source].df.select(C.named(column).alias("k")).dropna().distinct()
        parent = catalog[target].df.select(C.named(other).alias("k"), F.lit(1).alias("found")).dropna().distinct()
        parts.append(
            child.join(parent, "k", "left").agg(F.count("*").alias("distinct_keys"), F.count("found").alias("matched_keys"))
            .select(
                F.lit(source).alias("source"), F.lit(column).alias("source_column"), F.lit(target).alias("target"),
                F.lit(other).alias("target_column"), "distinct_keys", "matched_keys",
                F.round(F.coalesce(F.try_divide("matched_keys", "distinct_keys"), F.lit(0.0)), 4).alias("inclusion"),
            )
        )
    return _union(parts)
