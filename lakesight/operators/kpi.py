"""KPI formulas: totals, monthly series, growth and targets in one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesight.functions import columns as C
from lakesight.functions.stats import change_percent
from lakesight.plans.guard import check_formula, zero_safe

MONTHS_PER_YEAR = 12


@dataclass(frozen=True)
class Kpi:
    """A named aggregate formula over one table."""

    name: str
    table: str
    formula: str
    date_column: str | None = None
    target: float | None = None
    unit: str = ""
    description: str = ""


def _value(formula: str) -> Column:
    return F.coalesce(F.expr(zero_safe(formula)).cast("double"), F.lit(0.0))


def monthly_series(df: DataFrame, formula: str, date_column: str) -> DataFrame:
    """(period, value, previous_value, mom_pct, previous_year_value, yoy_pct) per month present.

    Growth is positional: against the row before and the row twelve back.
    """
    check_formula(formula)
    months = (
        df.withColumn("_ts", C.wall_time(df, date_column))
        .filter(F.col("_ts").isNotNull())
        .groupBy(F.date_format("_ts", "yyyy-MM").alias("period"))
        .agg(F.round(_value(formula), 2).alias("value"))
    )
    return with_growth(months)


def with_growth(months: DataFrame, within: str | None = None) -> DataFrame:
    """Add month-over-month and year-over-year columns to (period, value) rows.

    One row per calendar month (of each ``within`` group), so the ordered window is small.
    """
    by_period = Window.partitionBy(within).orderBy("period") if within else Window.orderBy("period")
    previous = F.lag("value", 1).over(by_period)
    year_ago = F.lag("value", MONTHS_PER_YEAR).over(by_period)
    return months.select(
        "*",
        previous.alias("previous_value"),
        F.round(change_percent(F.col("value"), previous), 2).alias("mom_pct"),
        year_ago.alias("previous_year_value"),
        F.round(change_percent(F.col("value"), year_ago), 2).alias("yoy_pct"),
    )


def evaluate_kpi(df: DataFrame, kpi: Kpi) -> DataFrame:
    """One row: overall value, comparison with the target, and growth of the latest month.

    Total and months come from one scan and one shuffle; rows without a date
    count in the total only.
    """
    check_formula(kpi.formula)
    value = _value(kpi.formula)
    if kpi.date_column:
        month = F.date_format(C.wall_time(df, kpi.date_column), "yyyy-MM")
        rolled = df.withColumn("_month", month).rollup("_month").agg(value.alias("v"), F.grouping("_month").alias("g"))
    else:
        rolled = df.agg(value.alias("v")).select("v", F.lit(None).cast("string").alias("_month"), F.lit(1).alias("g"))
    kind = F.when(F.col("g") == 1, "total").when(F.col("_month").isNull(), "undated").otherwise("month")
    rows = with_growth(
        rolled.select("v", kind.alias("kind"), F.col("_month").alias("period"), F.round("v", 2).alias("value")), "kind"
    )
    growth = F.when(F.col("kind") == "month", F.struct("previous_value", "mom_pct", "yoy_pct"))
    target = F.lit(kpi.target).cast("double")
    usable_target = F.when(target != 0, target)
    # an empty table has no total row
    return rows.agg(
        F.coalesce(F.max(F.when(F.col("kind") == "total", F.col("v"))), F.lit(0.0)).alias("total"),
        F.max_by(growth, F.when(F.col("kind") == "month", F.col("period"))).alias("g"),
    ).select(
        F.lit(kpi.name).alias("name"),
        F.lit(kpi.table).alias("table_name"),
        F.lit(kpi.formula).alias("formula"),
        F.lit(kpi.unit).alias("unit"),
        F.round("total", 2).alias("current_value"),
        target.alias("target_value"),
        F.round(F.col("total") - usable_target, 2).alias("target_diff"),
        F.round(F.col("total") / usable_target * 100, 2).alias("target_achievement_pct"),
        F.col("g.previous_value").alias("previous_period_value"),
        F.col("g.mom_pct").alias("growth_rate_mom_pct"),
        F.col("g.yoy_pct").alias("growth_rate_yoy_pct"),
    )


def evaluate_kpis(tables: dict[str, DataFrame], kpis: list[Kpi]) -> DataFrame:
    """All KPIs as one result; each is an independent scan of its own columns."""
    results = [evaluate_kpi(tables[k.table], k) for k in kpis]
    combined = results[0]
    for other in results[1:]:
        combined = combined.unionByName(other)
    return combined
