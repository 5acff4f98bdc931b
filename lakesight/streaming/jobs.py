"""Recurring jobs as batch functions, and an adapter that runs one whenever files arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakesight.operators import anomaly, quality
from lakesight.operators.catalog import Catalog
from lakesight.operators.kpi import Kpi
from lakesight.operators.rules import Rule
from lakesight.plans.report import build_report
from lakesight.session import small_frame
from lakesight.sources import sinks


def nightly_scan(databases: dict[str, Catalog], method: str = "ALL") -> DataFrame:
    """Quality score and anomaly count of all tables per database; a failing database is listed with its error."""
    result = None
    for name, catalog in databases.items():
        try:
            tables = {n: t.df for n, t in catalog.items()}
            keys = {n: t.primary_keys for n, t in catalog.items()}
            score = quality.evaluate_database(tables, keys)[2]
            found = anomaly.sweep(tables, keys, method)
            counts = anomaly.severity_summary(found).first() if found is not None else None
            part = score.select(
                F.lit(name).alias("database_name"),
                "overall_quality_score",
                "overall_grade",
                F.lit(counts.total_anomalies if counts else 0).cast("bigint").alias("total_anomalies"),
                F.lit(counts.critical_count if counts else 0).cast("bigint").alias("critical_count"),
                F.lit(None).cast("string").alias("error"),
            )
        except Exception as error:  # noqa: BLE001 - one database must not stop the others
            part = small_frame(
                next(iter(catalog.values())).df.sparkSession, [(name, str(error))], "database_name string, error string")
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result


def monthly_report(
    databases: dict[str, Catalog], kpis: dict[str, Sequence[Kpi]], rules: dict[str, Sequence[Rule]], folder: str,
    method: str = "ALL",
) -> list[str]:
    """Write every database's report: findings as CSV, each section as JSON. Returns the written paths."""
    written = []
    for name, catalog in databases.items():
        report = build_report(catalog, kpis.get(name, ()), rules.get(name, ()), method=method).kept()
        for section, df in report.sections().items():
            path = f"{folder.rstrip('/')}/{name}/{section}"
            if section == "findings":
                sinks.write_csv(df, path)
            else:
                sinks.write_json(df, path)
            written.append(path)
    return written


def drift_snapshot(
    databases: dict[str, Catalog], store: str, baselines: bool = True, only_table: str | None = None
) -> dict[str, int]:
    """Append schema snapshots and refresh the drift baselines of all tables, or of one. Returns counts."""
    counts = {"snapshots": 0, "baselines": 0}
    for name, catalog in databases.items():
        sinks.append_schema_snapshot(catalog, name, f"{store}/schemas")
        counts["snapshots"] += len(catalog)
        for table, info in catalog.items() if baselines else ():
            if only_table in (None, table):
                sinks.save_baseline(info.df, name, table, f"{store}/baselines")
                counts["baselines"] += 1
    return counts


def on_arrival(
    stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Run a batch job on each micro-batch of new rows.

    Without ``every`` it works off what has arrived and stops, for an outside
    timer; with it the job repeats at that interval.
    """
    writer = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
