"""Guarded SQL and widget datasets over a sales view of the given tables."""

from checks.common import rounded, table
from lakesight.plans import guard as G
from lakesight.plans import widgets as W

SALES = """SELECT o_orderkey AS order_no, c_mktsegment AS segment, o_orderpriority AS priority, o_totalprice AS price,
    CAST(o_custkey % 40 AS DOUBLE) / 100 AS rebate, n_name AS country, r_name AS continent, o_orderdate AS ordered
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""


def with_sales(spark, folder):
    for name in ("orders", "customer", "nation", "region", "lineitem"):
        table(spark, folder, name).createOrReplaceTempView(name)
    spark.sql(SALES).createOrReplaceTempView("purchases")
    return spark


def widget(kind, sql, **config):
    return lambda s, d: W.widget_data(with_sales(s, d), W.Widget(kind, sql, config))


def guarded(sql, **kw):
    return lambda s, d: G.run_read_only(with_sales(s, d), sql, **kw)


LARGEST = "SELECT max(price) AS largest FROM purchases WHERE continent = 'ASIA'"
REBATE = "SELECT 1000 * avg(rebate) AS per_mille FROM purchases WHERE segment = 'BUILDING'"
BUYERS = "SELECT count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_returnflag = 'R'"
BY_YEAR = "SELECT year(l_shipdate) AS shipped, sum(l_quantity) AS pieces FROM lineitem GROUP BY year(l_shipdate)"
BY_COUNTRY = "SELECT country, count(*) AS n FROM purchases WHERE priority = '1-URGENT' GROUP BY country"
POOREST = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 12"
MONTHS = """SELECT date_format(ordered, 'yyyy-MM') AS month, sum(CASE WHEN priority = '5-LOW' AND continent = 'ASIA'
  AND rebate > 0.38 THEN price END) AS low FROM purchases GROUP BY 1"""
RANKED = """WITH totals AS (SELECT continent, segment, sum(price) AS total FROM purchases GROUP BY continent, segment)
  SELECT continent, segment, round(total, 2) AS total, rank() OVER (PARTITION BY continent ORDER BY total DESC) AS place
  FROM totals -- every continent
  ;"""
UNLIMITED = "SELECT order_no, price FROM purchases ORDER BY price DESC, order_no"
SETS = """SELECT continent FROM purchases WHERE price > 400000 INTERSECT
  SELECT continent FROM purchases WHERE segment IN (SELECT max(segment) FROM purchases)"""
MARKS = """SELECT segment, '-- no /* comment */' AS note, count(*) AS n FROM purchases
  WHERE priority <> 'drop; delete' /* nor '-- here */ GROUP BY segment"""


def on_sales(sql):
    return f"WITH purchases AS ({SALES}) {sql}"


QUERIES = {
    "widget_largest_order": widget("kpi_card", LARGEST, value_column="largest", prefix="$"),
    "widget_mean_rebate": widget("kpi_card", REBATE, suffix=" per mille"),
    "widget_returning_suppliers": widget("kpi_card", BUYERS, value_column="suppliers", suffix=" suppliers"),
    "widget_empty_card": widget("kpi_card", "SELECT price FROM purchases WHERE price < 0"),
    "widget_pieces_by_year": widget("bar_chart", BY_YEAR, x_column="shipped", y_column="pieces"),
    "widget_urgent_by_country": widget("donut_chart", BY_COUNTRY, label_column="country", value_column="n"),
    "widget_line_with_gaps": widget("line_chart", MONTHS),
    "widget_poorest_customers": widget("table", POOREST),
    "sql_rank_over_cte": guarded(RANKED),
    "sql_default_limit": guarded(UNLIMITED, default_limit=G.DEFAULT_LIMIT, max_rows=G.MAX_ROWS),
    "sql_no_limit": guarded(UNLIMITED),
    "sql_marks_in_literals": guarded(MARKS),
    "sql_own_limit": guarded(UNLIMITED + " LIMIT 1500"),
    "sql_clamped_limit": guarded(UNLIMITED + " LIMIT 1500", max_rows=700),
    "sql_set_operation": guarded(SETS),
}

ORACLE = {
    "widget_largest_order": on_sales("SELECT max(price) AS kpi_value, '$' AS prefix, '' AS suffix FROM purchases WHERE continent = 'ASIA'"),
    "widget_mean_rebate": on_sales("""SELECT 1000 * avg(rebate) AS kpi_value, '' AS prefix, ' per mille' AS suffix
        FROM purchases WHERE segment = 'BUILDING'"""),
    "widget_returning_suppliers": """SELECT count(DISTINCT l_suppkey) AS kpi_value, '' AS prefix, ' suppliers' AS suffix
        FROM lineitem WHERE l_returnflag = 'R'""",
    "widget_empty_card": on_sales("""SELECT coalesce(max(price), 0) AS kpi_value, '' AS prefix, '' AS suffix
        FROM purchases WHERE price < 0"""),
    "widget_pieces_by_year": "SELECT CAST(year(l_shipdate) AS VARCHAR) AS label, sum(l_quantity) AS value FROM lineitem GROUP BY 1",
    "widget_urgent_by_country": on_sales("""SELECT country AS label, count(*) AS value FROM purchases
        WHERE priority = '1-URGENT' GROUP BY 1"""),
    "widget_line_with_gaps": on_sales("""SELECT strftime(ordered, '%Y-%m') AS label, coalesce(sum(price) FILTER
        (WHERE priority = '5-LOW' AND continent = 'ASIA' AND rebate > 0.38), 0) AS value FROM purchases GROUP BY 1"""),
    "widget_poorest_customers": POOREST,
    "sql_rank_over_cte": f"""WITH purchases AS ({SALES}), totals AS (SELECT continent, segment, sum(price) AS total
        FROM purchases GROUP BY ALL) SELECT continent, segment, {rounded('total', 2)} AS total,
        rank() OVER (PARTITION BY continent ORDER BY total DESC) AS place FROM totals""",
    "sql_default_limit": on_sales(UNLIMITED + " LIMIT 1000"),
    "sql_no_limit": on_sales(UNLIMITED),
    "sql_marks_in_literals": on_sales("""SELECT segment, '-- no /* comment */' AS note, count(*) AS n FROM purchases GROUP BY segment"""),
    "sql_own_limit": on_sales(UNLIMITED + " LIMIT 1500"),
    "sql_clamped_limit": on_sales(UNLIMITED + " LIMIT 700"),
    "sql_set_operation": on_sales(SETS),
}
