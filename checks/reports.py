"""The combined report and the recurring jobs over the given tables."""

from checks import anomalies, kpis, quality, variances
from checks.catalogs import KEYS
from checks.common import rounded, table
from checks.rule_results import RULES, rule_sql
from lakesight.operators.catalog import TableInfo
from lakesight.plans import report as R
from lakesight.session import scratch_folder
from lakesight.streaming import jobs


def catalog(spark, folder):
    return {n: TableInfo(table(spark, folder, n), KEYS[n]) for n in KEYS}


def built(spark, folder, sections=R.SECTIONS, method="ALL"):
    return R.build_report(catalog(spark, folder), kpis.KPIS, RULES, sections, method)


def written_findings(spark, folder, method="ALL"):
    """A monthly report written as files; its findings read back from CSV."""
    target = scratch_folder(spark)
    jobs.monthly_report({"sales": catalog(spark, folder)}, {"sales": kpis.KPIS}, {"sales": RULES}, target, method)
    return spark.read.option("header", "true").option("escape", '"').csv(f"{target}/sales/findings")


_ACTIVE = [r for r in RULES if r.active]
_VIOLATED = "\nUNION ALL\n".join(
    rule_sql(r) for r in _ACTIVE if r.name not in ("Unknown column", "Two statements"))
_KPIS = kpis.ORACLE["kpi_evaluation"]
FINDINGS = f"""SELECT 'KPI' AS "Category", name AS "Item", CAST(current_value AS VARCHAR) AS "Metric_Value", unit AS "Unit",
    CASE WHEN growth_rate_mom_pct <> 0 THEN 'MoM: ' || growth_rate_mom_pct || '%' ELSE 'Current' END AS "Status",
    formula AS "Details" FROM ({_KPIS})
  UNION ALL SELECT 'Business Rule Violation', rule_name, CAST(violation_count AS VARCHAR), 'violations', severity, alert_message
    FROM ({_VIOLATED}) WHERE status = 'VIOLATION'"""
_ALL_METHODS, _IQR = (anomalies.sweep_sql(KEYS, anomalies.METRICS, f) for f in (anomalies.all_methods_sql, anomalies.iqr_sql))
_NUMBER = lambda c: f"CAST({c} AS VARCHAR)"
with_anomalies = lambda found: f"""{FINDINGS}
  UNION ALL SELECT 'Anomaly', entity || ' - ' || metric, {_NUMBER('observed_value')},
    CASE WHEN deviation_pct > 0 THEN '+' ELSE '' END || {_NUMBER('deviation_pct')} || '%', severity, explanation FROM ({found})"""
_SCORE = f"""(SELECT {rounded('avg(quality_score)', 1)} AS score, CAST(sum(critical_count) AS BIGINT) AS critical
    FROM ({quality.scores_sql(quality.ALL_CHECKS, KEYS)}))"""
observations = lambda found: f"""SELECT 1 AS section, name AS position, name || ': ' || CASE WHEN growth_rate_mom_pct > 0 THEN '+' ELSE '' END
      || growth_rate_mom_pct || ' % on the month before' AS observation
    FROM ({_KPIS}) WHERE growth_rate_mom_pct IS NOT NULL
  UNION ALL SELECT 2, printf('%05d %05d', 0, row_number() OVER (ORDER BY list_position(['o_orderstatus', 'o_orderpriority'], dimension))),
      statement FROM ({variances.drivers_sql(*variances.ORDERS, variances.ORDER_DIMS)})
  UNION ALL SELECT 3, '', CASE WHEN critical > 0
      THEN 'Data quality is ' || CAST(round(score) AS INT) || '/100 with ' || critical || ' critical violations to repair.'
      ELSE 'Data quality is ' || CAST(round(score) AS INT) || '/100 (' || CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD'
        WHEN score >= 60 THEN 'FAIR' ELSE 'POOR' END || ').' END FROM {_SCORE}
  UNION ALL SELECT 4, '', count(*) || ' critical anomalies were found.' FROM ({found}) WHERE severity = 'CRITICAL' HAVING count(*) > 0
  UNION ALL SELECT 5, '', count(*) || ' business rules are violated.' FROM ({_VIOLATED}) WHERE status = 'VIOLATION'"""

QUERIES = {
    "report_findings": lambda s, d: R.findings(built(s, d, (R.KPIS, R.RULES))),
    "report_observations": lambda s, d: R.observations(built(s, d)),
    "report_trends": lambda s, d: built(s, d, (R.KPIS, R.TRENDS)).trends.drop("explanation"),
    "report_insights": lambda s, d: built(s, d, (R.ROOT_CAUSE,)).insights,
    "report_findings_all_sections": lambda s, d: R.findings(built(s, d)),
    "job_monthly_report_findings": written_findings,
    "job_nightly_scan": lambda s, d: jobs.nightly_scan({"sales": catalog(s, d)}),
    "report_observations_iqr": lambda s, d: R.observations(built(s, d, method="IQR")),
    "report_findings_iqr": lambda s, d: R.findings(built(s, d, method="IQR")),
    "job_monthly_report_findings_iqr": lambda s, d: written_findings(s, d, "IQR"),
    "job_nightly_scan_iqr": lambda s, d: jobs.nightly_scan({"sales": catalog(s, d)}, "IQR"),
}


def _trend(kpi):
    from checks.trends import trend_sql

    series = f"(SELECT '{kpi.name}' AS metric, period, value FROM ({kpis.series_sql(kpi.formula, kpi.table, kpi.date_column)}))"
    return f"SELECT * EXCLUDE (explanation) FROM ({trend_sql(series)})"


def nightly_sql(found):
    return f"""SELECT 'sales' AS database_name, overall_quality_score, overall_grade, total_anomalies, critical_count,
        CAST(NULL AS VARCHAR) AS error FROM ({quality.ORACLE['quality_database_score']}),
        (SELECT count(*) AS total_anomalies, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count FROM ({found}))"""


ORACLE = {
    "report_findings": FINDINGS,
    "report_trends": "\nUNION ALL\n".join(_trend(k) for k in kpis.KPIS if k.date_column),
    "report_insights": f"SELECT *, 'orders' AS table_name FROM ({variances.headline_sql(*variances.ORDERS)})",
    "report_observations": observations(_ALL_METHODS),
    "report_findings_all_sections": with_anomalies(_ALL_METHODS),
    "job_monthly_report_findings": with_anomalies(_ALL_METHODS),
    "job_nightly_scan": nightly_sql(_ALL_METHODS),
    "report_observations_iqr": observations(_IQR),
    "report_findings_iqr": with_anomalies(_IQR),
    "job_monthly_report_findings_iqr": with_anomalies(_IQR),
    "job_nightly_scan_iqr": nightly_sql(_IQR),
}
