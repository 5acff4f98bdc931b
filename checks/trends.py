"""Trends of monthly series per order status and priority."""

from pyspark.sql import functions as F

from checks.common import rounded, table
from checks.kpis import series_sql
from lakesight.operators import kpi as K
from lakesight.operators import trend as T


def monthly_by(spark, folder, column, formula="SUM(o_totalprice)"):
    return (
        table(spark, folder, "orders")
        .groupBy(F.col(column).alias("metric"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
        .agg(F.round(F.expr(formula), 2).alias("value"))
    )


def series(column):
    return f"""(SELECT {column} AS metric, strftime(o_orderdate, '%Y-%m') AS period,
      {rounded('SUM(o_totalprice)', 2)} AS value FROM orders GROUP BY 1, 2)"""


def steps(source):
    return f"""(SELECT *, coalesce(steps >= 2 AND step IS NOT NULL AND (z >= 1.6 OR share >= 0.25), false) AS sudden,
        CASE WHEN previous <> 0 THEN {rounded('(value - previous) / abs(previous) * 100', 2)} ELSE 0 END AS change_pct
      FROM (SELECT *, count(step) OVER (PARTITION BY metric) AS steps,
              CASE WHEN step IS NULL THEN NULL WHEN stddev_pop(step) OVER (PARTITION BY metric) > 0
                THEN abs(step - avg(step) OVER (PARTITION BY metric)) / stddev_pop(step) OVER (PARTITION BY metric)
                ELSE 0 END AS z,
              CASE WHEN previous <> 0 THEN abs(step) / abs(previous) ELSE 0 END AS share
            FROM (SELECT *, value - previous AS step FROM
                   (SELECT *, row_number() OVER w - 1 AS idx, lag(period) OVER w AS from_period,
                      lag(value) OVER w AS previous
                    FROM {source} WINDOW w AS (PARTITION BY metric ORDER BY period)))))"""


# Student's t tail with integer degrees of freedom: the series' terms are running products
P_VALUE = """CASE WHEN spread = 0 THEN 1.0 WHEN n < 3 THEN 0.0 WHEN r2 >= 1 THEN 0.0 ELSE
  greatest(0.0, 1 - CASE WHEN (n - 2) % 2 = 1
    THEN 2 / pi() * (theta + CASE WHEN n > 3 THEN sin(theta) * cos(theta) * (1 + coalesce((SELECT sum(term) FROM
        (SELECT exp(sum(ln(2.0 * i / (2.0 * i + 1) * pow(cos(theta), 2))) OVER (ORDER BY i)) AS term
         FROM range(1, CAST((n - 2) // 2 AS BIGINT)) r(i)) q), 0)) ELSE 0 END)
    ELSE sin(theta) * (1 + coalesce((SELECT sum(term) FROM
        (SELECT exp(sum(ln((2.0 * i - 1) / (2.0 * i) * pow(cos(theta), 2))) OVER (ORDER BY i)) AS term
         FROM range(1, CAST((n - 2) // 2 AS BIGINT)) r(i)) q), 0)) END) END"""


def trend_sql(source, metric_filter=""):
    n = "%.1f"
    number = lambda e: f"printf('{n}', {rounded(e, 1)})"
    return f"""WITH s AS {steps(source)},
      a AS (SELECT metric, count(*) AS n, min_by(value, period) AS first, max_by(value, period) AS last,
              regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS intercept, regr_r2(value, idx) AS raw_r2,
              avg(value) AS mean, stddev_pop(value) AS spread, count(*) FILTER (WHERE sudden) AS sudden_changes,
              min(period) FILTER (WHERE sudden) AS to_period,
              min_by(from_period, period) FILTER (WHERE sudden) AS from_period,
              min_by(change_pct, period) FILTER (WHERE sudden) AS change_pct
            FROM s GROUP BY metric),
      b AS (SELECT *, CASE WHEN spread = 0 THEN 0.0 ELSE raw_r2 END AS r2 FROM a),
      c AS (SELECT *, CASE WHEN r2 < 1 AND n > 2 THEN atan(sqrt(r2 * (n - 2) / (1 - r2)) / sqrt(n - 2)) END AS theta FROM b),
      d AS (SELECT *, {P_VALUE} AS p,
              CASE WHEN first <> 0 THEN (last - first) / abs(first) * 100 WHEN last > 0 THEN 100.0 ELSE 0.0 END AS growth,
              CASE WHEN mean <> 0 THEN slope / abs(mean) ELSE slope END AS relative,
              coalesce(spread / nullif(abs(mean), 0) * 100, 0) AS cv FROM c),
      e AS (SELECT *, CASE WHEN n < 2 THEN 'INSUFFICIENT_DATA' WHEN relative > 0.02 AND p < 0.05 THEN 'UPWARD'
              WHEN relative < -0.02 AND p < 0.05 THEN 'DOWNWARD' ELSE 'STABLE' END AS direction FROM d)
      SELECT metric AS metric_name, n AS data_points, direction AS trend_direction,
        {rounded('CASE WHEN n >= 2 THEN growth ELSE 0 END', 2)} AS total_growth_percentage,
        {rounded('slope', 4)} AS linear_slope, {rounded('intercept', 4)} AS intercept, {rounded('r2', 4)} AS r_squared,
        {rounded('p', 4)} AS p_value, {rounded('cv', 2)} AS volatility_cv,
        (cv > 15 AND sudden_changes > 1) AS seasonality_detected, sudden_changes AS sudden_change_count,
        to_period AS first_sudden_period,
        metric || ' ' || CASE WHEN growth > 0 THEN 'increased' WHEN growth < 0 THEN 'decreased' ELSE 'remained flat' END
          || ' ' || {number('abs(growth)')} || '% over the period (from ' || {number('first')} || ' to '
          || {number('last')} || ').' ||
          CASE direction WHEN 'UPWARD' THEN ' It rises consistently (R² = ' || printf('%.2f', {rounded('r2', 2)}) || ').'
            WHEN 'DOWNWARD' THEN ' It falls consistently (R² = ' || printf('%.2f', {rounded('r2', 2)}) || ').'
            ELSE ' It has no clear direction.' END ||
          CASE WHEN sudden_changes > 0 THEN ' The first sudden change came between ' || from_period || ' and '
            || to_period || ' (' || printf('%+.1f', {rounded('change_pct', 1)}) || '%).' ELSE '' END AS explanation
      FROM e {metric_filter}"""


def cumulative(spark, folder):
    """Orders and events that have arrived up to each month: rising series."""
    from pyspark.sql import Window

    monthly = monthly_by(spark, folder, "o_orderpriority", "COUNT(*)")
    upto = Window.partitionBy("metric").orderBy("period")
    return monthly.select("metric", "period", F.sum("value").over(upto).cast("double").alias("value"))


CUMULATIVE = """(SELECT metric, period, CAST(sum(value) OVER (PARTITION BY metric ORDER BY period) AS DOUBLE) AS value FROM
  (SELECT o_orderpriority AS metric, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS value FROM orders GROUP BY 1, 2))"""

QUERIES = {
    "trend_by_status": lambda s, d: T.analyse_series(monthly_by(s, d, "o_orderstatus")),
    "trend_by_priority": lambda s, d: T.analyse_series(monthly_by(s, d, "o_orderpriority")),
    "trend_rising": lambda s, d: T.analyse_series(cumulative(s, d)),
    "trend_of_kpi": lambda s, d: T.kpi_trend(
        K.monthly_series(table(s, d, "orders"), "SUM(o_totalprice)", "o_orderdate"), "Revenue"),
    "trend_moving_average": lambda s, d: T.moving_average(monthly_by(s, d, "o_orderpriority")),
    "trend_sudden_changes": lambda s, d: T.sudden_changes(monthly_by(s, d, "o_orderpriority")),
}

ORACLE = {
    "trend_by_status": trend_sql(series("o_orderstatus")),
    "trend_by_priority": trend_sql(series("o_orderpriority")),
    "trend_rising": trend_sql(CUMULATIVE),
    "trend_of_kpi": trend_sql(f"(SELECT 'Revenue' AS metric, period, value FROM ({series_sql('SUM(o_totalprice)')}))"),
    "trend_moving_average": f"""SELECT metric, period, {rounded('avg(value) OVER (PARTITION BY metric ORDER BY period '
        'ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)} AS moving_avg FROM {series('o_orderpriority')}""",
    "trend_sudden_changes": f"""SELECT metric, from_period, period AS to_period, {rounded('previous', 2)} AS previous_value,
        {rounded('value', 2)} AS new_value, change_pct AS change_percentage, {rounded('z', 2)} AS z_score
        FROM {steps(series('o_orderpriority'))} WHERE sudden""",
}
