"""KPI totals and monthly series."""

from checks.common import rounded, table
from lakesight.operators import kpi as K

REVENUE = K.Kpi("Revenue", "orders", "SUM(o_totalprice)", "o_orderdate", 3.0e9, "USD")
ORDER_VALUE = K.Kpi("Order value", "orders", "SUM(o_totalprice) / COUNT(o_orderkey)", "o_orderdate", 250000.0, "USD")
SPREAD = K.Kpi("Spread", "orders", "MAX(o_totalprice) - MIN(o_totalprice)", "o_orderdate", None, "USD")
ORDERS = K.Kpi("Orders", "orders", "COUNT(*)", None, 0.0, "orders")
MEAN_DISCOUNT = K.Kpi("Mean discount", "lineitem", "AVG(l_discount) * 100", "l_shipdate", 5.0, "%")
KPIS = [REVENUE, ORDER_VALUE, SPREAD, ORDERS, MEAN_DISCOUNT]


def series_sql(value, source="orders", ts="o_orderdate"):
    growth = lambda old: f"""CASE WHEN {old} <> 0 THEN {rounded(f'(value - {old}) / abs({old}) * 100', 2)} END"""
    return f"""SELECT period, value, previous_value, {growth('previous_value')} AS mom_pct, previous_year_value,
        {growth('previous_year_value')} AS yoy_pct
      FROM (SELECT period, value, lag(value, 1) OVER (ORDER BY period) AS previous_value,
              lag(value, 12) OVER (ORDER BY period) AS previous_year_value
            FROM (SELECT strftime({ts}, '%Y-%m') AS period, {rounded(value, 2)} AS value
                  FROM {source} WHERE {ts} IS NOT NULL GROUP BY 1))"""


def kpi_sql(kpi):
    total = f"SELECT coalesce(CAST({kpi.formula} AS DOUBLE), 0) AS total FROM {kpi.table}"
    target = "NULL" if kpi.target is None else repr(kpi.target)
    usable = "CAST(NULL AS DOUBLE)" if not kpi.target else repr(kpi.target)
    last = (f"(SELECT * FROM ({series_sql(kpi.formula, kpi.table, kpi.date_column)}) ORDER BY period DESC LIMIT 1)"
            if kpi.date_column else
            "(SELECT CAST(NULL AS DOUBLE) AS previous_value, CAST(NULL AS DOUBLE) AS mom_pct, CAST(NULL AS DOUBLE) AS yoy_pct)")
    return f"""SELECT '{kpi.name}' AS name, '{kpi.table}' AS table_name, '{kpi.formula}' AS formula, '{kpi.unit}' AS unit,
        {rounded('total', 2)} AS current_value, CAST({target} AS DOUBLE) AS target_value,
        {rounded(f'total - {usable}', 2)} AS target_diff, {rounded(f'total / {usable} * 100', 2)} AS target_achievement_pct,
        previous_value AS previous_period_value, mom_pct AS growth_rate_mom_pct, yoy_pct AS growth_rate_yoy_pct
      FROM ({total}) CROSS JOIN {last} l"""


QUERIES = {
    "kpi_monthly_sum": lambda s, d: K.monthly_series(table(s, d, "orders"), "SUM(o_totalprice)", "o_orderdate"),
    "kpi_monthly_count": lambda s, d: K.monthly_series(table(s, d, "orders"), "COUNT(*)", "o_orderdate"),
    "kpi_monthly_average": lambda s, d: K.monthly_series(table(s, d, "orders"), "AVG(o_totalprice)", "o_orderdate"),
    "kpi_monthly_ratio": lambda s, d: K.monthly_series(
        table(s, d, "orders"), "SUM(o_totalprice) / COUNT(o_orderkey)", "o_orderdate"),
    "kpi_monthly_min_max": lambda s, d: K.monthly_series(
        table(s, d, "lineitem"), "MAX(l_extendedprice) - MIN(l_extendedprice)", "l_shipdate"),
    "kpi_monthly_arithmetic": lambda s, d: K.monthly_series(
        table(s, d, "lineitem"), "SUM(l_extendedprice) * 1.18", "l_shipdate"),
    "kpi_evaluation": lambda s, d: K.evaluate_kpis(
        {n: table(s, d, n) for n in ("orders", "lineitem")}, KPIS),
}

ORACLE = {
    "kpi_monthly_sum": series_sql("SUM(o_totalprice)"),
    "kpi_monthly_count": series_sql("COUNT(*)"),
    "kpi_monthly_average": series_sql("AVG(o_totalprice)"),
    "kpi_monthly_ratio": series_sql("SUM(o_totalprice) / COUNT(o_orderkey)"),
    "kpi_monthly_min_max": series_sql("MAX(l_extendedprice) - MIN(l_extendedprice)", "lineitem", "l_shipdate"),
    "kpi_monthly_arithmetic": series_sql("SUM(l_extendedprice) * 1.18", "lineitem", "l_shipdate"),
    "kpi_evaluation": "\nUNION ALL\n".join(kpi_sql(k) for k in KPIS),
}
