"""Outliers of one metric: z-score, IQR fences and rolling windows, and the combined scan.

Every detector returns the same columns. Statistics of the whole column are one
row of scalars; they enter the detecting scan as literals, so it is a filter
and a projection without any join or shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesight.functions import columns as C
from lakesight.functions.grading import severity, severity_counts
from lakesight.functions.summary import Summary, summarise
from lakesight.operators.ordering import POSITION, ordered_copy, with_position
from lakesight.session import side_by_side

# Minimum rows, thresholds, window length and list length.
MIN_ROWS = 10
Z_THRESHOLD = 2.5
NORMAL_SIGMAS = 2.0
FENCE = 1.5
ROLLING_ROWS = 5
TOP_ANOMALIES = 100

ANOMALY = (
    "row_id", "entity", "metric", "observed_value", "normal_range_min", "normal_range_max",
    "deviation_pct", "severity", "method", "score", "explanation",
)
BLOCK_ROWS = 100_000
_NOISE = 1e-12  # a window spread below this share of its mean is rounding noise


def row_id(keys: Sequence[str]) -> Column:
    """The caller's key columns as one text; different keys give different texts.

    A missing value is written as \\N, and a separator or backslash in a value gets a backslash before it.
    """
    escaped = lambda k: F.replace(F.replace(C.named(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", *[F.coalesce(escaped(k), F.lit("\\N")) for k in keys])


def _label(entity: str | None, keys: Sequence[str]) -> Column:
    return C.named(entity).cast("string") if entity else F.concat(F.lit("Row "), row_id(keys))


def anomalies(
    found: DataFrame, metric: str, method: str, value: Column, low: Column, high: Column,
    center: Column, score: Column, level: Column, explanation: Column,
) -> DataFrame:
    """Shape rows holding row_id and entity into anomaly rows."""
    deviation = F.when(center != 0, (value - center) / F.abs(center) * 100).otherwise(100.0)
    return found.select(
        "row_id",
        "entity",
        F.lit(metric).alias("metric"),
        F.round(value, 2).alias("observed_value"),
        F.round(low, 2).alias("normal_range_min"),
        F.round(high, 2).alias("normal_range_max"),
        F.round(deviation, 2).alias("deviation_pct"),
        level.alias("severity"),
        F.lit(method).alias("method"),
        F.round(score, 2).alias("score"),
        explanation.alias("explanation"),
    )


def _rows(df: DataFrame, metric: str, keys: Sequence[str], entity: str | None) -> DataFrame:
    return df.select(row_id(keys).alias("row_id"), _label(entity, keys).alias("entity"), C.finite(df, metric).alias("v"))


def metric_summary(df: DataFrame, metric: str, with_quartiles: bool = True) -> Summary:
    probabilities = (0.25, 0.5, 0.75) if with_quartiles else ()
    return summarise(df, {metric: C.finite(df, metric)}, probabilities)[0][metric]


def detect_zscore(
    df: DataFrame, metric: str, keys: Sequence[str], entity: str | None = None,
    threshold: float = Z_THRESHOLD, summary: Summary | None = None,
) -> DataFrame:
    """Values at least ``threshold`` sample standard deviations from the mean."""
    s = summary or metric_summary(df, metric, with_quartiles=False)
    usable = s.count >= MIN_ROWS and (s.std or 0) > 0
    mean, std = (F.lit(s.mean), F.lit(s.std)) if usable else (F.lit(0.0), F.lit(1.0))
    z = (F.col("v") - mean) / std
    if usable:
        # a slightly wider range on the bare column, which the file scan can use to skip row groups
        reach = threshold * s.std * (1 - 1e-9)
        df = df.filter((C.named(metric) <= s.mean - reach) | (C.named(metric) >= s.mean + reach))
    found = _rows(df, metric, keys, entity).filter((F.abs(z) >= threshold) if usable else F.lit(False))
    low, high = mean - NORMAL_SIGMAS * std, mean + NORMAL_SIGMAS * std
    text = F.format_string("%.1f is %.2f standard deviations from the mean %.1f", F.col("v"), z, mean)
    return anomalies(found, metric, "Z-SCORE", F.col("v"), low, high, mean, F.abs(z), severity(z), text)


def detect_iqr(
    df: DataFrame, metric: str, keys: Sequence[str], entity: str | None = None,
    width: float = FENCE, summary: Summary | None = None,
) -> DataFrame:
    """Values outside the quartiles by more than ``width`` interquartile ranges."""
    s = summary or metric_summary(df, metric)
    usable = s.count >= MIN_ROWS and s.iqr > 0
    iqr = s.iqr if usable else 1.0
    low = F.lit(s.quantile(0.25) - width * iqr if usable else 0.0)
    high = F.lit(s.quantile(0.75) + width * iqr if usable else 0.0)
    median = F.lit(s.quantile(0.5) if usable else 0.0)
    v = F.col("v")
    if usable:  # on the bare column, for the file scan
        df = df.filter((C.named(metric) < low) | (C.named(metric) > high))
    found = _rows(df, metric, keys, entity).filter(((v < low) | (v > high)) if usable else F.lit(False))
    beyond = F.when(v > high, v - high).otherwise(low - v) / iqr
    score = beyond + 2.0
    text = F.format_string("%.1f lies %.1f times the IQR outside %.1f to %.1f", v, beyond, low, high)
    return anomalies(found, metric, "IQR", v, low, high, median, score, severity(score), text)


def detect_rolling(
    df: DataFrame, metric: str, time: str, keys: Sequence[str], entity: str | None = None,
    window: int = ROLLING_ROWS, threshold: float = Z_THRESHOLD, per: str | None = None,
) -> DataFrame:
    """Values far from the ``window`` rows before them in time order (``keys`` break ties).

    The order is global, or within each value of ``per``. The sorted rows are cut
    into blocks; each block also gets the last ``window`` rows of the one before,
    so no task ever holds more than a block, however long the series or however
    large one ``per`` group is.
    """
    order_keys = [f"_k{i}" for i in range(len(keys))]
    rows = _rows(df, metric, keys, entity)
    rows = df.select(
        *[c.alias(n) for n, c in zip(rows.columns, [row_id(keys), _label(entity, keys), C.finite(df, metric)])],
        C.wall_time(df, time).alias("_ts"),
        *[C.named(k).alias(n) for k, n in zip(keys, order_keys)],
        *([C.named(per).alias("_per")] if per else []),
    ).filter(F.col("v").isNotNull())
    order = ([F.col("_per").asc_nulls_last()] if per else []) + [F.col("_ts").asc_nulls_last()] + [F.col(k) for k in order_keys]
    copy = ordered_copy(rows, order)
    if not per and copy.count() < window + 2:
        copy = copy.limit(0)
    placed = with_position(copy).drop("_ts", *order_keys)
    block = F.floor(F.col(POSITION) / BLOCK_ROWS)
    halo = F.when(F.col(POSITION) % BLOCK_ROWS >= BLOCK_ROWS - window, block + 1)
    spread = placed.select("*", block.alias("_own"), F.explode(F.array(block, halo)).alias("_block")).filter(
        F.col("_block").isNotNull())
    group = ["_per", "_block"] if per else ["_block"]
    before = Window.partitionBy(*group).orderBy(POSITION).rowsBetween(-window, -1)
    scored = (
        spread.withColumn("mean", F.avg("v").over(before))
        .withColumn("std", F.stddev_samp("v").over(before))
        .withColumn("seen", F.count("v").over(before))
        .filter(
            (F.col("_own") == F.col("_block")) & (F.col("seen") == window)
            & (F.col("std") > 0) & (F.col("std") > _NOISE * F.abs("mean"))
        )
        .withColumn("z", (F.col("v") - F.col("mean")) / F.col("std"))
        .filter(F.abs("z") >= threshold)
    )
    v, mean, std, z = F.col("v"), F.col("mean"), F.col("std"), F.col("z")
    text = F.format_string("%.1f is %.2f standard deviations from the mean %.2f of the " + str(window) + " rows before", v, z, mean)
    return anomalies(
        scored, metric, "ROLLING_WINDOW", v, mean - NORMAL_SIGMAS * std, mean + NORMAL_SIGMAS * std,
        mean, F.abs(z), severity(z), text,
    )


METHODS = ("ZSCORE", "IQR", "ROLLING", "ISOLATION_FOREST", "ALL")


def scan_table(
    df: DataFrame, metric: str, keys: Sequence[str], entity: str | None = None,
    method: str = "ALL", time: str | None = None,
) -> DataFrame:
    """Anomalies of one metric by one method, or by z-score, IQR and isolation forest together."""
    from lakesight.operators.isolation_forest import detect_isolation_forest

    chosen = method.upper()
    if chosen not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if chosen == "ROLLING" and not time:
        raise ValueError("the rolling method needs a time column")
    summary = metric_summary(df, metric) if chosen in ("ZSCORE", "IQR", "ALL") else None
    parts = []
    if chosen in ("ZSCORE", "ALL"):
        parts.append(detect_zscore(df, metric, keys, entity, summary=summary))
    if chosen in ("IQR", "ALL"):
        parts.append(detect_iqr(df, metric, keys, entity, summary=summary))
    if chosen == "ROLLING":
        parts.append(detect_rolling(df, metric, time, keys, entity))
    if chosen in ("ISOLATION_FOREST", "ALL"):
        parts.append(detect_isolation_forest(df, [metric], keys, entity))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found  # a method finds a row once, so rows that share a key all stay


def strongest_per_row(found: DataFrame) -> DataFrame:
    """One detection per row and method: the highest score."""
    best = Window.partitionBy("row_id", "method").orderBy(F.desc("score"), F.desc("observed_value"))
    return found.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def top_anomalies(found: DataFrame, n: int = TOP_ANOMALIES) -> DataFrame:
    return found.orderBy(F.desc("score"), "method", "row_id").limit(n)


def severity_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total_anomalies"), *severity_counts())


def first_metric(df: DataFrame, keys: Sequence[str]) -> str | None:
    """The first numeric column that is no key, else the first numeric column."""
    numeric = C.numeric_columns(df)
    return next((c for c in numeric if c not in keys), next(iter(numeric), None))


def sweep(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]], method: str = "ALL") -> DataFrame | None:
    """Scan the first metric of every table; rows of a table without a key are named by all their columns."""
    steps = []
    for name, df in tables.items():
        own = list(keys.get(name) or ())
        metric = first_metric(df, own)
        if metric is not None:
            steps.append(partial(scan_table, df, metric, own or df.columns, method=method))
            steps[-1].table = name
    if not steps:
        return None
    result = None
    for step, found in zip(steps, side_by_side(next(iter(tables.values())).sparkSession, steps)):
        part = found.select(F.lit(step.table).alias("table_name"), *ANOMALY)
        result = part if result is None else result.unionByName(part)
    return result
