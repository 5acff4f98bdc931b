"""Trend direction, moving averages, sudden changes and volatility of many series at once.

A series is rows (metric, period, value): one row per calendar period and metric,
as ``kpi.monthly_series`` makes them, so one metric is a small group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesight.functions.stats import change_percent, slope_p_value

# Thresholds of direction, moving average, sudden change and volatility.
MIN_SLOPE = 0.02
MAX_P = 0.05
AVERAGED_PERIODS = 3
SUDDEN_Z = 1.6
SUDDEN_SHARE = 0.25
MIN_STEPS = 2
VOLATILE_CV = 15.0


def _by_period():
    return Window.partitionBy("metric").orderBy("period")


def _points(series: DataFrame) -> DataFrame:
    return series.select("metric", "period", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def moving_average(series: DataFrame, periods: int = AVERAGED_PERIODS) -> DataFrame:
    """Mean of the last ``periods`` values, of fewer at the start."""
    frame = _by_period().rowsBetween(1 - periods, 0)
    return _points(series).select("metric", "period", F.round(F.avg("value").over(frame), 2).alias("moving_avg"))


def _steps(series: DataFrame) -> DataFrame:
    """Each point with its step from the point before and whether that step is sudden."""
    order, whole = _by_period(), Window.partitionBy("metric")
    points = (
        _points(series)
        .withColumn("index", F.row_number().over(order) - 1)
        .withColumn("from_period", F.lag("period").over(order))
        .withColumn("previous", F.lag("value").over(order))
        .withColumn("step", F.col("value") - F.col("previous"))
    )
    spread = F.stddev_pop("step").over(whole)
    z = F.when(spread > 0, F.abs(F.col("step") - F.avg("step").over(whole)) / spread).otherwise(0.0)
    share = F.when(F.col("previous") != 0, F.try_divide(F.abs("step"), F.abs("previous"))).otherwise(0.0)
    return (
        points.withColumn("z", F.when(F.col("step").isNotNull(), z))
        .withColumn("steps", F.count("step").over(whole))
        .withColumn(
            "sudden",
            F.coalesce(
                (F.col("steps") >= MIN_STEPS) & ((F.col("z") >= SUDDEN_Z) | (share >= SUDDEN_SHARE))
                & F.col("step").isNotNull(),
                F.lit(False),
            ),
        )
        .withColumn("change_pct", F.round(change_percent(F.col("value"), F.col("previous"), F.lit(0.0)), 2))
    )


def sudden_changes(series: DataFrame) -> DataFrame:
    """Steps far from the usual step, or of at least a quarter of the value before."""
    return _steps(series).filter("sudden").select(
        "metric",
        "from_period",
        F.col("period").alias("to_period"),
        F.round("previous", 2).alias("previous_value"),
        F.round("value", 2).alias("new_value"),
        F.col("change_pct").alias("change_percentage"),
        F.round("z", 2).alias("z_score"),
    )


def analyse_series(series: DataFrame, unit: str = "") -> DataFrame:
    """One row per metric: growth, regression, direction, volatility and a sentence on them."""
    stats = _steps(series).groupBy("metric").agg(
        F.count("*").alias("n"),
        F.min_by("value", "period").alias("first"),
        F.max_by("value", "period").alias("last"),
        F.regr_slope("value", "index").alias("slope"),
        F.regr_intercept("value", "index").alias("intercept"),
        F.regr_r2("value", "index").alias("r2"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("spread"),
        F.count_if("sudden").alias("sudden_changes"),
        F.min_by(
            F.when(F.col("sudden"), F.struct("from_period", F.col("period").alias("to_period"), "change_pct")),
            F.when(F.col("sudden"), F.col("period")),
        ).alias("first_sudden"),
    )
    enough = F.col("n") >= 2
    flat = F.col("spread") == 0
    stats = (
        stats.withColumn("r2", F.when(flat, 0.0).otherwise(F.col("r2")))
        .withColumn("p", F.when(flat, 1.0).otherwise(slope_p_value(F.col("r2"), F.col("n"))))
        .withColumn(
            "growth",
            change_percent(F.col("last"), F.col("first"), F.when(F.col("last") > 0, 100.0).otherwise(0.0)),
        )
        .withColumn("relative", F.when(F.col("mean") != 0, F.try_divide("slope", F.abs("mean"))).otherwise(F.col("slope")))
        .withColumn("cv", F.coalesce(F.try_divide(F.col("spread"), F.abs("mean")) * 100, F.lit(0.0)))
        .withColumn(
            "direction",
            F.when(~enough, "INSUFFICIENT_DATA")
            .when((F.col("relative") > MIN_SLOPE) & (F.col("p") < MAX_P), "UPWARD")
            .when((F.col("relative") < -MIN_SLOPE) & (F.col("p") < MAX_P), "DOWNWARD")
            .otherwise("STABLE"),
        )
    )
    known = lambda c, digits: F.when(enough, F.round(c, digits))
    return stats.select(
        F.col("metric").alias("metric_name"),
        F.col("n").alias("data_points"),
        F.col("direction").alias("trend_direction"),
        F.round(F.when(enough, F.col("growth")).otherwise(0.0), 2).alias("total_growth_percentage"),
        known("slope", 4).alias("linear_slope"),
        known("intercept", 4).alias("intercept"),
        known("r2", 4).alias("r_squared"),
        known("p", 4).alias("p_value"),
        known("cv", 2).alias("volatility_cv"),
        (enough & (F.col("cv") > VOLATILE_CV) & (F.col("sudden_changes") > 1)).alias("seasonality_detected"),
        F.col("sudden_changes").alias("sudden_change_count"),
        F.col("first_sudden.to_period").alias("first_sudden_period"),
        _sentence(enough, f" {unit}" if unit else "").alias("explanation"),
    )


def _sentence(enough, unit: str):
    growth = F.col("growth")
    verb = F.when(growth > 0, "increased").when(growth < 0, "decreased").otherwise("remained flat")
    number = lambda c: F.format_string("%.1f", F.round(c, 1))
    course = (
        F.when(F.col("direction") == "UPWARD", F.format_string(" It rises consistently (R² = %.2f).", F.round("r2", 2)))
        .when(F.col("direction") == "DOWNWARD", F.format_string(" It falls consistently (R² = %.2f).", F.round("r2", 2)))
        .otherwise(" It has no clear direction.")
    )
    jump = F.coalesce(
        F.format_string(
            " The first sudden change came between %s and %s (%+.1f%%).",
            F.col("first_sudden.from_period"),
            F.col("first_sudden.to_period"),
            F.round("first_sudden.change_pct", 1),
        ),
        F.lit(""),
    )
    told = F.concat(
        F.col("metric"), F.lit(" "), verb, F.lit(" "), number(F.abs(growth)), F.lit("% over the period (from "),
        number("first"), F.lit(f"{unit} to "), number("last"), F.lit(f"{unit})."), course,
        F.when(F.col("sudden_changes") > 0, jump).otherwise(""),
    )
    short = F.format_string("%s has too few data points (%d) for a trend.", F.col("metric"), F.col("n"))
    return F.when(enough, told).otherwise(short)


def kpi_trend(monthly: DataFrame, metric: str, unit: str = "") -> DataFrame:
    """Trend of one KPI's monthly series."""
    return analyse_series(monthly.select(F.lit(metric).alias("metric"), "period", "value"), unit)
