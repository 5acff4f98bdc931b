"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target


def build_session(app: str = "lakesight", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings win where it has any."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _scratch_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/lakesight/{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name under the shared folder the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session takes a folder below the warehouse; on a cluster that is an error.
    """
    return f"{_scratch_base(spark)}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch copies of this application; call it when no result that reads them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_scratch_base(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later stages then restart from files, not from the whole lineage, when an
    executor is lost, and every reader sees the same rows in the same partitions.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A few rows of scalars as a local relation, which Spark folds into the plan."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table({f.name: list(c) for f, c in zip(schema, columns)}), schema)


def side_by_side(spark: SparkSession, steps: Sequence[Callable], at_once: int = 4) -> list:
    """Results of the steps, in their order; a few at a time send their jobs to Spark, which shares out its cores among them."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda step: inheritable_thread_target(spark)(step)(), steps))
