"""Attribution of a metric's change between two periods to dimension values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesight.functions import columns as C
from lakesight.functions.stats import change_percent
from lakesight.functions.summary import exact_quantiles

# Minimum rows, period length, dimension sizes and the share of a driver.
MIN_ROWS = 10
RECENT_DAYS = 30
MIN_VALUES, MAX_VALUES = 2, 50
AUTO_DIMENSIONS = 3
DRIVER_SHARE = 15.0

# Approximate counts only rule out columns far above the limit; the rest are counted exactly.
_CANDIDATE_VALUES = 2 * MAX_VALUES


class NotEnoughData(ValueError):
    """Too few dated rows, or all of them on one side of the split."""


@dataclass(frozen=True)
class Change:
    """Where the periods split and the metric's total on either side."""

    split: datetime
    prior: float
    current: float

    @property
    def delta(self) -> float:
        return self.current - self.prior

    @property
    def percent(self) -> float:
        return self.delta / abs(self.prior) * 100 if self.prior else 0.0


def clean_rows(df: DataFrame, metric: str, date: str) -> DataFrame:
    """Rows with a readable date and a value, as (_ts, _v, original columns)."""
    value = C.present(df, metric).cast("double")
    return df.withColumn("_ts", C.wall_time(df, date)).withColumn("_v", value).filter(
        F.col("_ts").isNotNull() & F.col("_v").isNotNull()
    )


def find_split(df: DataFrame, metric: str, date: str) -> datetime:
    """Thirty days before the last date; the median date when that leaves no earlier rows."""
    clean = clean_rows(df, metric, date)
    facts = clean.agg(F.count("*").alias("n"), F.min("_ts").alias("lo"), F.max("_ts").alias("hi")).first()
    if facts.n < MIN_ROWS:
        raise NotEnoughData("not enough dated rows")
    split = facts.hi - timedelta(days=RECENT_DAYS)
    if split > facts.lo:
        return split
    median = exact_quantiles(clean, C.epoch_micros(F.col("_ts")), (0.5,))[0.5]
    return datetime(1970, 1, 1) + timedelta(microseconds=math.floor(median))


def period_sums(split: datetime) -> list[Column]:
    """Sums and counts of ``_v`` before and from ``split`` on."""
    recent = F.col("_ts") >= F.lit(split.isoformat(sep=" ")).cast("timestamp_ntz")
    return [
        F.coalesce(F.sum(F.when(~recent, F.col("_v"))), F.lit(0.0)).alias("p1"),
        F.coalesce(F.sum(F.when(recent, F.col("_v"))), F.lit(0.0)).alias("p2"),
        F.count_if(~recent).alias("n1"),
        F.count_if(recent).alias("n2"),
    ]


def measure_change(df: DataFrame, metric: str, date: str, split: datetime | None = None) -> Change:
    split = split or find_split(df, metric, date)
    total = clean_rows(df, metric, date).agg(*period_sums(split)).first()
    if total is None or not total.n1 or not total.n2:
        raise NotEnoughData("all dated rows lie in one period")
    return Change(split, total.p1, total.p2)


def headline(df: DataFrame, metric: str, date: str, split: datetime | None = None) -> DataFrame:
    """One row: both totals, net change, and a sentence."""
    change = measure_change(df, metric, date, split)
    verb = "increased" if change.delta > 0 else "decreased"
    row = df.sparkSession.range(1)
    percent = F.lit(change.percent)
    return row.select(
        F.lit(metric).alias("metric"),
        F.lit(verb).alias("direction"),
        F.round(percent, 2).alias("percentage_change"),
        F.round(F.lit(change.prior), 2).alias("prior_period_total"),
        F.round(F.lit(change.current), 2).alias("current_period_total"),
        F.lit(change.split.isoformat()).alias("period_split_timestamp"),
        F.format_string(
            f"%s {verb} %.1f%% in the current period (from %s to %s)", F.lit(metric), F.round(F.abs(percent), 1),
            F.format_number(F.lit(change.prior), 1), F.format_number(F.lit(change.current), 1),
        ).alias("headline"),
    )


def find_dimensions(df: DataFrame, metric: str, date: str, limit: int = AUTO_DIMENSIONS) -> list[str]:
    """The first columns with 2 to 50 distinct values."""
    names = [n for n in df.columns if n not in (metric, date)]
    if not names:
        return []
    rough = df.agg(F.array(*[F.approx_count_distinct(C.present(df, n)) for n in names]).alias("n")).first().n
    small = [n for n, count in zip(names, rough) if count <= _CANDIDATE_VALUES]
    if not small:
        return []
    # at most a few hundred values per column by now, so exact sets fit in one row
    sizes = df.agg(F.array(*[F.size(F.collect_set(C.present(df, n))) for n in small]).alias("n")).first().n
    return [n for n, size in zip(small, sizes) if MIN_VALUES <= size <= MAX_VALUES][:limit]


def _branch_columns(total_delta: float) -> dict[str, Column]:
    delta = F.col("p2") - F.col("p1")
    pct = change_percent(F.col("p2"), F.col("p1"), F.when(F.col("p2") > 0, 100.0).otherwise(0.0))
    share = delta / F.lit(total_delta) * 100 if total_delta else F.lit(0.0)
    return {"delta": delta, "pct": pct, "share": share}


def breakdown(
    df: DataFrame, metric: str, date: str, dimensions: Sequence[str] | None = None, split: datetime | None = None,
    change: Change | None = None,
) -> DataFrame:
    """Prior, current, delta and share of the net change per value of each dimension.

    ``position`` orders each dimension by contribution to the net direction.
    """
    dims = list(dimensions or find_dimensions(df, metric, date))
    change = change or measure_change(df, metric, date, split)
    # stacked before they are summed: a group per value of each dimension, never per combination
    per_value = [F.struct(F.lit(d).alias("dimension"), C.named(d).cast("string").alias("dimension_value")) for d in dims]
    values = (
        clean_rows(df, metric, date).select("_ts", "_v", F.inline(F.array(*per_value)))
        .filter(F.col("dimension_value").isNotNull())
        .groupBy("dimension", "dimension_value")
        .agg(*period_sums(change.split))
    )
    c = _branch_columns(change.delta)
    along = F.col("delta") if change.delta < 0 else -F.col("delta")
    place = Window.partitionBy("dimension").orderBy(along, "dimension_value")
    return values.select(
        "dimension",
        "dimension_value",
        F.round("p1", 2).alias("prior_value"),
        F.round("p2", 2).alias("current_value"),
        F.round(c["delta"], 2).alias("delta"),
        F.round(c["pct"], 2).alias("percentage_change"),
        F.round(c["share"], 2).alias("share_of_variance"),
    ).withColumn("position", F.row_number().over(place))


def top_drivers(items: DataFrame) -> DataFrame:
    """The leading value of each dimension when it carries more than 15 % of the net change."""
    share = F.col("share_of_variance")
    verb = F.when(share > 0, "accounted for").otherwise("counterbalanced")
    return items.filter((F.col("position") == 1) & (F.abs(share) > DRIVER_SHARE)).select(
        "dimension",
        F.col("dimension_value").alias("key"),
        share.alias("share_of_variance_pct"),
        F.format_string(
            "%s %s %s %.1f%% of the net change (from %s to %s, %+.1f%%)",
            F.col("dimension"), F.col("dimension_value"), verb, F.round(F.abs(share), 1),
            F.format_number("prior_value", 1), F.format_number("current_value", 1), F.round("percentage_change", 1),
        ).alias("statement"),
    )


@dataclass(frozen=True)
class VarianceReport:
    headline: DataFrame
    breakdown: DataFrame
    drivers: DataFrame


def analyse_variance(
    df: DataFrame, metric: str, date: str, dimensions: Sequence[str] | None = None, split: datetime | None = None
) -> VarianceReport:
    """Headline, breakdown per dimension and top drivers of a metric's change."""
    split = split or find_split(df, metric, date)
    change = measure_change(df, metric, date, split)
    items = breakdown(df, metric, date, dimensions, change=change)
    return VarianceReport(headline(df, metric, date, split), items, top_drivers(items))
