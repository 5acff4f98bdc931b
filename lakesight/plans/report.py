"""The combined findings report: every operator over one catalog, section by section."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesight.functions import columns as C
from lakesight.operators import anomaly, kpi, quality, rules, trend, variance
from lakesight.operators.catalog import Catalog, table_counts
from lakesight.operators.kpi import Kpi
from lakesight.operators.rules import Rule
from lakesight.session import materialise, side_by_side

# Section names, name fragments that mark dates, metrics and transaction tables, and list lengths.
EXECUTIVE, KPIS, TRENDS, ANOMALIES, QUALITY, RULES, ROOT_CAUSE = (
    "Executive Summary", "KPI Summary", "Trend Analysis", "Anomaly Report", "Data Quality",
    "Business Rule Violations", "Root Cause Analysis",
)
SECTIONS = (EXECUTIVE, KPIS, TRENDS, ANOMALIES, QUALITY, RULES, ROOT_CAUSE, "Detailed Tables", "Recommendations", "Appendix")
DATE_NAMES = ("date", "time")
METRIC_NAMES = ("amount", "total", "price", "revenue", "cost", "val")
TRANSACTION_TABLES = ("order", "sale", "transact", "production", "expense")
FACTORS_PER_INSIGHT = 2
READ_AGAIN = ("kpis", "anomalies", "rule_violations", "factors")
FINDINGS = ("Category", "Item", "Metric_Value", "Unit", "Status", "Details")


def first_named(df: DataFrame, fragments: Sequence[str]) -> str | None:
    """The first column whose name holds one of the fragments."""
    return next((c for c in df.columns if any(f in c.lower() for f in fragments)), None)


def transaction_tables(catalog: Catalog) -> dict[str, tuple[str, str]]:
    """(metric, date) of every table that looks transactional."""
    found = {}
    for name, t in catalog.items():
        if any(f in name.lower() for f in TRANSACTION_TABLES):
            date, metric = first_named(t.df, DATE_NAMES), first_named(t.df, METRIC_NAMES)
            if date and metric:
                found[name] = (metric, date)
    return found


def _union(parts: list[DataFrame]) -> DataFrame | None:
    result = None
    for part in parts:
        result = part if result is None else result.unionByName(part)
    return result


@dataclass
class Report:
    """DataFrames per section; None where a section was not asked for or has nothing to say."""

    catalog: DataFrame
    kpis: DataFrame | None = None
    trends: DataFrame | None = None
    anomalies: DataFrame | None = None
    quality_checks: DataFrame | None = None
    quality_tables: DataFrame | None = None
    quality: DataFrame | None = None
    rule_violations: DataFrame | None = None
    insights: DataFrame | None = None
    factors: DataFrame | None = None
    skipped: list[str] = field(default_factory=list)

    def kept(self) -> Report:
        """The same report with the sections that observations and findings read again written once, a few at a time."""
        again = [n for n in READ_AGAIN if getattr(self, n) is not None]
        return replace(self, **dict(zip(again, side_by_side(self.catalog.sparkSession, [partial(materialise, getattr(self, n)) for n in again]))))

    def sections(self) -> dict[str, DataFrame]:
        named = {n: v for n, v in vars(self).items() if isinstance(v, DataFrame)}
        return {**named, "observations": observations(self), "findings": findings(self)}


def report_anomalies(catalog: Catalog, method: str = "ALL") -> DataFrame | None:
    """All anomalies of the first metric of every table."""
    return anomaly.sweep({n: t.df for n, t in catalog.items()}, {n: t.primary_keys for n, t in catalog.items()}, method)


def build_report(
    catalog: Catalog, kpis: Sequence[Kpi] = (), rule_list: Sequence[Rule] = (), sections: Sequence[str] = SECTIONS,
    method: str = "ALL",
) -> Report:
    """Run the operators the chosen sections need. A failing insight is skipped and named."""
    wanted = set(sections)
    tables = {n: t.df for n, t in catalog.items()}
    report = Report(table_counts(catalog))
    if kpis and wanted & {KPIS, EXECUTIVE}:
        report.kpis = kpi.evaluate_kpis(tables, list(kpis))
        dated = [k for k in kpis if k.date_column]
        if TRENDS in wanted and dated:
            report.trends = _union([
                trend.kpi_trend(kpi.monthly_series(tables[k.table], k.formula, k.date_column), k.name, k.unit) for k in dated
            ]).filter("data_points >= 2")
    if ANOMALIES in wanted:
        report.anomalies = report_anomalies(catalog, method)
    if wanted & {QUALITY, EXECUTIVE}:
        keys = {n: t.primary_keys for n, t in catalog.items()}
        report.quality_checks, report.quality_tables, report.quality = quality.evaluate_database(tables, keys)
    if RULES in wanted and rule_list:
        report.rule_violations = rules.execute_all_rules(tables, rule_list).filter("status = 'VIOLATION'")
    if wanted & {ROOT_CAUSE, EXECUTIVE}:
        headlines, factors = [], []
        for i, (name, (metric, date)) in enumerate(transaction_tables(catalog).items()):
            df = tables[name]
            try:
                dims = variance.find_dimensions(df, metric, date)
                found = variance.analyse_variance(df, metric, date, dims)
            except variance.NotEnoughData as error:
                report.skipped.append(f"{name}: {error}")
                continue
            order = F.array_position(F.array(*map(F.lit, dims)), F.col("dimension"))
            headlines.append(found.headline.withColumn("table_name", F.lit(name)))
            factors.append(found.drivers.select(
                F.lit(name).alias("table_name"), F.lit(i).alias("table_order"), order.alias("dimension_order"), "*"))
        report.insights, report.factors = _union(headlines), _union(factors)
    return report


def observations(report: Report) -> DataFrame:
    """Sentences derived from the findings, in reading order."""
    rows = []
    line = lambda df, section, order, text: df.select(
        F.lit(section).alias("section"), order.alias("position"), text.alias("observation"))
    if report.kpis is not None:
        growth = F.col("growth_rate_mom_pct")
        rows.append(line(
            report.kpis.filter(growth.isNotNull()), 1, F.col("name"),
            F.concat("name", F.lit(": "), F.when(growth > 0, F.lit("+")).otherwise(""), growth.cast("string"),
                     F.lit(" % on the month before"))))
    if report.factors is not None:
        # a few drivers per insight at most
        place = Window.partitionBy("table_name").orderBy("dimension_order")
        top = report.factors.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= FACTORS_PER_INSIGHT)
        rows.append(line(top, 2, F.format_string("%05d %05d", "table_order", "_r"), F.col("statement")))
    if report.quality is not None:
        score = F.format_string("%.0f", F.round("overall_quality_score", 0))
        rows.append(line(report.quality, 3, F.lit(""), F.when(
            F.col("critical_violations") > 0,
            F.concat(F.lit("Data quality is "), score, F.lit("/100 with "), F.col("critical_violations").cast("string"),
                     F.lit(" critical violations to repair.")),
        ).otherwise(F.concat(F.lit("Data quality is "), score, F.lit("/100 ("), F.col("overall_grade"), F.lit(").")))))
    if report.anomalies is not None:
        n = F.count_if(F.col("severity") == "CRITICAL")
        rows.append(line(report.anomalies.agg(n.alias("n")).filter("n > 0"), 4, F.lit(""),
                         F.format_string("%d critical anomalies were found.", "n")))
    if report.rule_violations is not None:
        rows.append(line(report.rule_violations.agg(F.count("*").alias("n")).filter("n > 0"), 5, F.lit(""),
                         F.format_string("%d business rules are violated.", "n")))
    spark = report.catalog.sparkSession
    told = _union(rows)
    clear = F.lit("All metrics, quality scores and rules are within their normal limits.")
    if told is None:
        return line(spark.range(1), 6, F.lit(""), clear)
    told = materialise(told)  # a few sentences, read twice
    return told.unionByName(line(told.agg(F.count("*").alias("n")).filter("n = 0"), 6, F.lit(""), clear))


def findings(report: Report) -> DataFrame:
    """KPIs, anomalies and rule violations as one flat text table."""
    parts = []
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    number = lambda c: C.number_text(F.col(c))
    row = lambda df, category, *values: df.select(
        F.lit(category).alias("Category"), *[text(v).alias(n) for n, v in zip(FINDINGS[1:], values)])
    if report.kpis is not None:
        mom = F.col("growth_rate_mom_pct")
        status = F.when(mom != 0, F.concat(F.lit("MoM: "), number("growth_rate_mom_pct"), F.lit("%"))).otherwise("Current")
        parts.append(row(report.kpis, "KPI", "name", number("current_value"), "unit", status, "formula"))
    if report.anomalies is not None:
        sign = F.when(F.col("deviation_pct") > 0, "+").otherwise("")
        parts.append(row(
            report.anomalies, "Anomaly", F.concat_ws(" - ", "entity", "metric"), number("observed_value"),
            F.concat(sign, number("deviation_pct"), F.lit("%")), "severity", "explanation"))
    if report.rule_violations is not None:
        parts.append(row(
            report.rule_violations, "Business Rule Violation", "rule_name", "violation_count", F.lit("violations"),
            "severity", "alert_message"))
    joined = _union(parts)
    if joined is None:
        empty = ", ".join(f"{c} string" for c in FINDINGS)
        return report.catalog.sparkSession.createDataFrame([], empty)
    return joined
