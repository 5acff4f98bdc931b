"""Chart-ready result sets of guarded queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesight.functions.columns import named
from lakesight.plans.guard import run_read_only

KINDS = ("kpi_card", "bar_chart", "line_chart", "donut_chart", "table")


@dataclass(frozen=True)
class Widget:
    """A query and how its result is shown; ``config`` names columns, prefix and suffix."""

    kind: str
    sql: str
    config: dict[str, str] = field(default_factory=dict)


def kpi_card(df: DataFrame, value_column: str | None = None, prefix: str = "", suffix: str = "") -> DataFrame:
    """The first row's value, 0 when there is none."""
    value = named(value_column or df.columns[0])
    first = df.select(value.alias("v")).limit(1).agg(F.first("v").alias("v"))
    return first.select(
        F.coalesce("v", F.lit(0)).alias("kpi_value"), F.lit(prefix).alias("prefix"), F.lit(suffix).alias("suffix"))


def labelled_values(df: DataFrame, label_column: str | None = None, value_column: str | None = None) -> DataFrame:
    """(label, value) rows of bar, line and donut charts: labels as text, missing values as 0."""
    label = label_column or df.columns[0]
    value = value_column or df.columns[min(1, len(df.columns) - 1)]
    return df.select(named(label).cast("string").alias("label"), F.coalesce(named(value), F.lit(0)).alias("value"))


def widget_data(spark: SparkSession, widget: Widget, max_rows: int | None = None) -> DataFrame:
    """Run a widget's query and shape it for its kind; all rows unless the caller asks for fewer."""
    if widget.kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    df = run_read_only(spark, widget.sql, max_rows=max_rows)
    c = widget.config
    if widget.kind == "kpi_card":
        return kpi_card(df, c.get("value_column"), c.get("prefix", ""), c.get("suffix", ""))
    if widget.kind == "donut_chart":
        return labelled_values(df, c.get("label_column"), c.get("value_column"))
    if widget.kind == "table":
        return df
    return labelled_values(df, c.get("x_column"), c.get("y_column"))
