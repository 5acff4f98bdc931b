"""Variance attribution and drill-down trees."""

from datetime import datetime

from checks.common import rounded, table
from lakesight.operators import root_cause as R
from lakesight.operators import variance as V

YEAR_2000 = datetime(2000, 1, 1)


def split_sql(source, metric, ts, split=None):
    """One-row relation with the split timestamp."""
    if split:
        return f"(SELECT TIMESTAMP '{split}' AS split)"
    return f"""(SELECT CASE WHEN max({ts}) - INTERVAL 30 DAY > min({ts}) THEN max({ts}) - INTERVAL 30 DAY
        ELSE make_timestamp(CAST(floor(quantile_cont(epoch_us({ts})::DOUBLE, 0.5)) AS BIGINT)) END AS split
      FROM {source} WHERE {metric} IS NOT NULL AND {ts} IS NOT NULL)"""


def sums(metric, ts):
    return (f"coalesce(sum({metric}) FILTER (WHERE {ts} < split), 0) AS p1, "
            f"coalesce(sum({metric}) FILTER (WHERE {ts} >= split), 0) AS p2")


def headline_sql(source, metric, ts, split=None):
    return f"""SELECT '{metric}' AS metric, CASE WHEN p2 > p1 THEN 'increased' ELSE 'decreased' END AS direction,
        {rounded('pct', 2)} AS percentage_change, {rounded('p1', 2)} AS prior_period_total,
        {rounded('p2', 2)} AS current_period_total, strftime(split, '%Y-%m-%dT%H:%M:%S') AS period_split_timestamp,
        '{metric} ' || CASE WHEN p2 > p1 THEN 'increased ' ELSE 'decreased ' END || printf('%.1f', {rounded('abs(pct)', 1)})
          || '% in the current period (from ' || format('{{:,.1f}}', p1) || ' to ' || format('{{:,.1f}}', p2) || ')' AS headline
      FROM (SELECT *, CASE WHEN p1 <> 0 THEN (p2 - p1) / abs(p1) * 100 ELSE 0 END AS pct FROM
        (SELECT split, {sums(metric, ts)} FROM {source}, {split_sql(source, metric, ts, split)} s GROUP BY split))"""


def breakdown_sql(source, metric, ts, dims, split=None):
    parts = "\nUNION ALL\n".join(
        f"""SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS dimension_value, {sums(metric, ts)}
          FROM {source}, {split_sql(source, metric, ts, split)} s WHERE {d} IS NOT NULL GROUP BY {d}""" for d in dims)
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY dimension
          ORDER BY CASE WHEN net < 0 THEN delta ELSE -delta END, dimension_value) AS INT) AS position FROM
      (SELECT dimension, dimension_value, {rounded('p1', 2)} AS prior_value, {rounded('p2', 2)} AS current_value,
        {rounded('p2 - p1', 2)} AS delta,
        {rounded('CASE WHEN p1 <> 0 THEN (p2 - p1) / abs(p1) * 100 WHEN p2 > 0 THEN 100 ELSE 0 END', 2)} AS percentage_change,
        {rounded('CASE WHEN net <> 0 THEN (p2 - p1) / net * 100 ELSE 0 END', 2)} AS share_of_variance, net
       FROM ({parts}) b, (SELECT p2 - p1 AS net FROM (SELECT {sums(metric, ts)} FROM {source},
         {split_sql(source, metric, ts, split)} s)) t)"""


def drivers_sql(*args):
    return f"""SELECT dimension, dimension_value AS key, share_of_variance AS share_of_variance_pct,
        dimension || ' ' || dimension_value || CASE WHEN share_of_variance > 0 THEN ' accounted for ' ELSE ' counterbalanced ' END
          || printf('%.1f', {rounded('abs(share_of_variance)', 1)}) || '% of the net change (from ' ||
          format('{{:,.1f}}', prior_value) || ' to ' || format('{{:,.1f}}', current_value) || ', ' ||
          printf('%+.1f', {rounded('percentage_change', 1)}) || '%)' AS statement
      FROM ({breakdown_sql(*args)}) WHERE position = 1 AND abs(share_of_variance) > 15"""


def sizes_sql(source, columns):
    return " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS name, count(DISTINCT {c}) AS n FROM {source}" for i, c in enumerate(columns))


def without_net(sql):
    return f"SELECT * EXCLUDE (net) FROM ({sql})"


def tree_sql(source, metric, ts, dims, split=None):
    ctes, out = [f"base AS (SELECT *, split FROM {source}, {split_sql(source, metric, ts, split)} s)"], []
    pct = lambda zero: f"CASE WHEN p1 <> 0 THEN (p2 - p1) / abs(p1) * 100 {zero} ELSE 0 END"
    shown = lambda zero: f"printf('%+.1f', {rounded(pct(zero), 1)}) || '%'"
    out.append(f"""SELECT 0 AS level, 'TOTAL' AS dimension, CAST(NULL AS VARCHAR) AS key, 'TOTAL' AS path,
        CAST(NULL AS VARCHAR) AS parent_path, {rounded('p2', 2)} AS value, {rounded('p2 - p1', 2)} AS delta,
        {shown('')} AS percentage_change FROM (SELECT {sums(metric, ts)} FROM base)""")
    for n in range(1, len(dims) + 1):
        keys = ", ".join(dims[:n])
        parents = ", ".join(dims[: n - 1])
        keep = f"AND ({parents}) IN (SELECT ({parents}) FROM l{n - 1})" if n > 1 else ""
        over = f"PARTITION BY {parents}" if n > 1 else ""
        ctes.append(f"""l{n} AS (SELECT * FROM (SELECT *, row_number() OVER ({over}
            ORDER BY {rounded('abs(p2 - p1)', 2)} DESC, CAST({dims[n - 1]} AS VARCHAR)) AS r
          FROM (SELECT {keys}, {sums(metric, ts)} FROM base WHERE {dims[n - 1]} IS NOT NULL {keep} GROUP BY {keys})) WHERE r <= 3)""")
        path = " || ' > ' || ".join(["'TOTAL'"] + [f"CAST({d} AS VARCHAR)" for d in dims[:n]])
        parent = " || ' > ' || ".join(["'TOTAL'"] + [f"CAST({d} AS VARCHAR)" for d in dims[: n - 1]])
        out.append(f"""SELECT {n}, '{dims[n - 1]}', CAST({dims[n - 1]} AS VARCHAR), {path}, {parent}, {rounded('p2', 2)},
            {rounded('p2 - p1', 2)}, {shown('WHEN p2 > 0 THEN 100')} FROM l{n}""")
    return f"WITH {', '.join(ctes)}\n" + "\nUNION ALL\n".join(out)


ORDERS = ("orders", "o_totalprice", "o_orderdate")
ORDER_DIMS = ["o_orderstatus", "o_orderpriority"]
LINES = ("lineitem", "l_extendedprice", "l_shipdate")
LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_DIMS = ["l_returnflag", "l_linestatus", "l_linenumber"]
EVENTS = ("events", "value", "ts")


def on(args, fn, *rest, **kw):
    return lambda s, d: fn(table(s, d, args[0]), *args[1:], *rest, **kw)


QUERIES = {
    "variance_headline_orders": on(ORDERS, V.headline),
    "variance_breakdown_orders": on(ORDERS, V.breakdown, ORDER_DIMS),
    "variance_breakdown_found_dimensions": on(LINES, V.breakdown, None, YEAR_2000),
    "variance_breakdown_median_split": on(EVENTS, V.breakdown, ["event_type"]),
    "variance_drivers_lineitem": lambda s, d: V.analyse_variance(
        table(s, d, "lineitem"), *LINES[1:], LINE_DIMS, YEAR_2000).drivers,
    "root_cause_orders": on(ORDERS, R.drill_down, ORDER_DIMS),
    "root_cause_lineitem": on(LINES, R.drill_down, ["l_linenumber", "l_returnflag", "l_linestatus"], YEAR_2000),
    "root_cause_suppliers": on(LINES, R.drill_down, ["l_returnflag", "l_suppkey", "l_partkey"], YEAR_2000),
}

ORACLE = {
    "variance_headline_orders": headline_sql(*ORDERS),
    "variance_breakdown_orders": without_net(breakdown_sql(*ORDERS, ORDER_DIMS)),
    "variance_breakdown_found_dimensions": f"""SELECT * EXCLUDE (net) FROM ({breakdown_sql(*LINES, LINE_COLUMNS, YEAR_2000)})
        WHERE dimension IN (SELECT name FROM ({sizes_sql('lineitem', LINE_COLUMNS)}) WHERE n BETWEEN 2 AND 50 ORDER BY place LIMIT 3)""",
    "variance_breakdown_median_split": without_net(breakdown_sql(*EVENTS, ["event_type"])),
    "variance_drivers_lineitem": drivers_sql(*LINES, LINE_DIMS, YEAR_2000),
    "root_cause_orders": tree_sql(*ORDERS, ORDER_DIMS),
    "root_cause_lineitem": tree_sql(*LINES, ["l_linenumber", "l_returnflag", "l_linestatus"], YEAR_2000),
    "root_cause_suppliers": tree_sql(*LINES, ["l_returnflag", "l_suppkey", "l_partkey"], YEAR_2000),
}
