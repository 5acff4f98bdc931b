"""Parquet and CSV folders as named views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv")


def view_name(stem: str) -> str:
    """File stem in lower case, with dashes and spaces as underscores."""
    return re.sub(r"[-\s]", "_", stem.lower())


def list_datasets(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """Names of the files or dataset folders ending in .parquet or .csv directly below ``folder``."""
    base = folder.rstrip("/")
    # only paths are listed; the content column is pruned, so no file is opened
    entry = F.regexp_extract("path", f"/([^/]+\\.{kind})(?:/|$)", 1)
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        .select(entry.alias("name")).filter("name <> ''").distinct()
    )
    return sorted(r.name for r in listed.collect())


def read_dataset(spark: SparkSession, path: str, kind: str, schema: T.StructType | None = None) -> DataFrame:
    """One dataset. CSV types are inferred by an extra pass unless a schema is given."""
    if kind == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def register_files(
    spark: SparkSession, folder: str, kind: str = "parquet", schemas: dict[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    """Create a temporary view per dataset in ``folder`` and return them by name."""
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {', '.join(FORMATS)}")
    views = {}
    for entry in list_datasets(spark, folder, kind):
        name = view_name(entry.removesuffix(f".{kind}"))
        df = read_dataset(spark, f"{folder.rstrip('/')}/{entry}", kind, (schemas or {}).get(name))
        df.createOrReplaceTempView(name)
        views[name] = df
    return views


def describe(df: DataFrame, primary_keys: tuple[str, ...] = ()) -> DataFrame:
    """(name, type, nullable, primary_key) of a dataset's columns."""
    from lakesight.operators.catalog import TableInfo, column_metadata

    return column_metadata({"t": TableInfo(df, primary_keys)}).select(
        F.col("column_name").alias("name"), "type", "nullable", "primary_key"
    )
