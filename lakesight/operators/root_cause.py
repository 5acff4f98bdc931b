"""Drill-down tree: the branches with the largest change at every level of a dimension list."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesight.functions.columns import named
from lakesight.functions.stats import change_percent
from lakesight.operators.variance import clean_rows, find_split, period_sums
from lakesight.session import materialise

BRANCHES = 3  # fixed value: children kept per node
TOTAL = "TOTAL"
_SEPARATOR = " > "


def _nodes(level: DataFrame, number: int, dimension: str, dims: Sequence[str]) -> DataFrame:
    """Tree rows of one level; ``_path`` holds the keys down to the node."""
    path = [F.col(f"_d{i}").cast("string") for i in range(number)]
    delta = F.col("p2") - F.col("p1")
    grew_from_zero = F.when(F.col("p2") > 0, 100.0).otherwise(0.0) if number else F.lit(0.0)
    pct = change_percent(F.col("p2"), F.col("p1"), grew_from_zero)
    text = lambda parts: F.concat_ws(_SEPARATOR, F.lit(TOTAL), *parts)
    return level.select(
        F.lit(number).alias("level"),
        F.lit(dimension).alias("dimension"),
        (path[-1] if number else F.lit(None).cast("string")).alias("key"),
        text(path).alias("path"),
        (text(path[:-1]) if number else F.lit(None).cast("string")).alias("parent_path"),
        F.round("p2", 2).alias("value"),
        F.round(delta, 2).alias("delta"),
        F.format_string("%+.1f%%", F.round(pct, 1)).alias("percentage_change"),
    )


def _rest(kept: DataFrame, level: DataFrame, parents: DataFrame, number: int, dimension: str, dims: Sequence[str]) -> DataFrame:
    """What a parent has besides its kept children, as one row per parent; missing values are part of it."""
    above = [f"_d{i}" for i in range(number - 1)]
    signed = lambda df, sign, n: df.select(*above, (F.col("p1") * sign).alias("p1"), (F.col("p2") * sign).alias("p2"), F.lit(n).alias("n"))
    summed = signed(parents, 1, 0).unionByName(signed(kept, -1, -1)).unionByName(signed(level, 0, 1)).groupBy(*above).agg(
        F.sum("p1").alias("p1"), F.sum("p2").alias("p2"), F.sum("n").alias("n"))
    name = F.concat(F.lit("other ("), F.col("n").cast("string"), F.lit(")"))
    return _nodes(summed.withColumn(f"_d{number - 1}", name), number, dimension, dims)


def drill_down(
    df: DataFrame, metric: str, date: str, dimensions: Sequence[str], split: datetime | None = None,
    branches: int = BRANCHES, rest: bool = False,
) -> DataFrame:
    """Flat tree rows (level, dimension, key, path, parent_path, value, delta, percentage_change).

    Level by level: the rows of surviving parents are summed per child and cut
    to ``branches`` children per parent, so that no level has more groups than
    children of survivors. ``rest`` adds a row ``other (n)`` per parent with the
    sums of its n further values, so that children add up to their parent.
    """
    dims = [d for d in dimensions if d in df.columns]
    split = split or find_split(df, metric, date)
    totals = period_sums(split)
    rows = clean_rows(df, metric, date).select("_ts", "_v", *[named(d).alias(f"_d{i}") for i, d in enumerate(dims)])
    kept = materialise(rows.agg(*totals))
    tree = _nodes(kept, 0, TOTAL, dims)
    for number in range(1, len(dims) + 1):
        keys = [f"_d{i}" for i in range(number)]
        level, parents = rows.dropna(subset=keys), kept
        if number > 1:
            # at most branches ** (number - 1) surviving parents
            level = level.join(F.broadcast(parents.select(*keys[:-1])), keys[:-1], "left_semi")
        level = materialise(level.groupBy(*keys).agg(*totals))
        largest = [F.desc(F.round(F.abs(F.col("p2") - F.col("p1")), 2)), F.col(keys[-1]).cast("string").asc()]
        if number == 1:
            kept = level.orderBy(*largest).limit(branches)
        else:
            place = Window.partitionBy(*keys[:-1]).orderBy(*largest)
            kept = level.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= branches).drop("_r")
        kept = materialise(kept)
        tree = tree.unionByName(_nodes(kept, number, dims[number - 1], dims))
        if rest:
            tree = tree.unionByName(_rest(kept, level, parents, number, dims[number - 1], dims))
    return tree
