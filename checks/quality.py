"""Quality rules on whole tables, with defects injected by expressions where the data has none."""

from pyspark.sql import functions as F

from checks.catalogs import COLUMNS, KEYS, TYPES
from checks.common import rounded, table
from lakesight.operators import quality as Q


def damaged_orders(spark, folder):
    """orders with missing customers, repeated keys, negative prices and unreadable dates."""
    return table(spark, folder, "orders").select(
        (F.col("o_orderkey") - F.when(F.col("o_orderkey") % 50 == 7, 1).otherwise(0)).alias("o_orderkey"),
        F.when(F.col("o_custkey") % 20 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 1000 == 3, -F.col("o_totalprice"))
        .when(F.col("o_orderkey") % 997 == 5, F.col("o_totalprice") * 40)
        .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 300 == 9, F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"),
    )


DAMAGED = """(SELECT o_orderkey - CASE WHEN o_orderkey % 50 = 7 THEN 1 ELSE 0 END AS o_orderkey,
    CASE WHEN o_custkey % 20 <> 0 THEN o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS o_orderpriority,
    CASE WHEN o_orderkey % 1000 = 3 THEN -o_totalprice WHEN o_orderkey % 997 = 5 THEN o_totalprice * 40
      ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 300 = 9 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate
  FROM orders)"""

LINEITEM_KEYS = ["l_orderkey", "l_linenumber"]
SHOWN = ["table_name", "rule_id", "column_name", "passed", "severity", "penalty", "message",
         "violation_count", "violation_percentage"]


def _pct(count):
    return rounded(f"CAST({count} AS DOUBLE) / total * 100", 2)


def checks_sql(name, source, columns, keys=(), numeric=(), positive=(), dates=()):
    """Check rows of the five built-in rules; ``columns`` are tested for nulls."""
    out = []
    row = lambda rule, column, passed, severity, penalty, message, count: (
        f"SELECT '{name}' AS table_name, '{rule}' AS rule_id, '{column}' AS column_name, {passed} AS passed, "
        f"{severity} AS severity, CAST({penalty} AS DOUBLE) AS penalty, {message} AS message, "
        f"CAST({count} AS BIGINT) AS violation_count, {_pct(count)} AS violation_percentage")
    one = lambda e: f"printf('%.1f', {rounded(e, 1)})"
    for c in columns:
        facts = f"FROM (SELECT count(*) AS total, count(*) - count({c}) AS n FROM {source}) f WHERE total > 0"
        share = "n / total * 100"
        if c in keys:
            out.append(row("QR_NULL_CHECK", c, "n = 0", "CASE WHEN n = 0 THEN 'LOW' ELSE 'CRITICAL' END",
                           "CASE WHEN n = 0 THEN 0 ELSE 15 END",
                           "CASE WHEN n = 0 THEN 'Key has no NULL values' ELSE 'Key has ' || n || ' NULL values' END", "n")
                       + f" {facts}")
        else:
            out.append(row("QR_NULL_CHECK", c, "false", f"CASE WHEN {share} > 20 THEN 'HIGH' ELSE 'MEDIUM' END",
                           f"CASE WHEN {share} > 20 THEN 8 ELSE 3 END",
                           f"{one(share)} || '% NULL values (' || n || ' rows)'", "n") + f" {facts} AND {share} > 2")
    for c in keys:
        facts = (f"FROM (SELECT count(*) AS total, count(*) - count(DISTINCT {c}) - "
                 f"CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n FROM {source}) f WHERE total > 0")
        out.append(row("QR_UNIQUENESS", c, "n = 0", "CASE WHEN n = 0 THEN 'LOW' ELSE 'CRITICAL' END",
                       "CASE WHEN n = 0 THEN 0 ELSE 20 END",
                       f"CASE WHEN n = 0 THEN 'Key has no duplicates' ELSE 'Key has ' || n || ' duplicate values (' || "
                       f"{one('n / total * 100')} || '%)' END", "n") + f" {facts}")
    for c in positive:
        share = "n / total * 100"
        out.append(row("QR_NON_NEGATIVE", c, "false", f"CASE WHEN {share} > 1 THEN 'HIGH' ELSE 'MEDIUM' END",
                       f"CASE WHEN {share} > 1 THEN 10 ELSE 5 END",
                       f"{one(share)} || '% negative values (' || n || ' rows)'", "n")
                   + f" FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {c} < 0) AS n FROM {source}) f WHERE n > 0")
    for c in numeric:
        share = "n / total * 100"
        out.append(row("QR_EXTREME_OUTLIERS", c, "false", f"CASE WHEN {share} < 2 THEN 'MEDIUM' ELSE 'HIGH' END",
                       f"CASE WHEN {share} < 2 THEN 4 ELSE 8 END", "n || ' values beyond 3 times the IQR'", "n")
                   + f""" FROM (SELECT total, iqr, valid, (SELECT count(*) FROM {source}
                       WHERE {c} < q1 - 3 * iqr OR {c} > q3 + 3 * iqr) AS n
                     FROM (SELECT *, q3 - q1 AS iqr FROM (SELECT count(*) AS total, count({c}) AS valid,
                       quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}))) f
                     WHERE total >= 10 AND valid >= 10 AND iqr > 0 AND n > 0""")
    for c in dates:
        out.append(row("QR_DATE_VALIDITY", c, "false", "'HIGH'", "10",
                       f"n || ' unreadable dates (' || {one('n / total * 100')} || '%)'", "n")
                   + f""" FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {c} IS NOT NULL
                     AND TRY_CAST({c} AS TIMESTAMP) IS NULL) AS n FROM {source}) f WHERE n > 0""")
    return "\nUNION ALL\n".join(f"SELECT * FROM ({q})" for q in out)


DAMAGED_CHECKS = checks_sql(
    "orders", DAMAGED, ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate"],
    ["o_orderkey", "o_custkey"], ["o_orderkey", "o_custkey", "o_totalprice"], ["o_totalprice"], ["o_orderdate"])
NUMBERS = {t: [c for c in columns if TYPES.get(c) in ("int", "bigint", "double")] for t, columns in COLUMNS.items()}
OTHERS = {t: [c for c in columns if c not in NUMBERS[t]] for t, columns in COLUMNS.items()}
POSITIVE = {"lineitem": ["l_quantity", "l_extendedprice"], "orders": ["o_totalprice"], "part": ["p_retailprice"]}


def table_checks_sql(name):
    return checks_sql(name, name, NUMBERS[name] + OTHERS[name], KEYS[name], NUMBERS[name], POSITIVE.get(name, ()))


def scores_sql(checks, names):
    listed = ", ".join(f"('{n}')" for n in names)
    counted = ", ".join(f"coalesce(count(*) FILTER (WHERE NOT passed AND severity = '{s}'), 0) AS {s.lower()}_count"
                        for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL"))
    return f"""SELECT table_name, {rounded('score', 1)} AS quality_score,
        CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 60 THEN 'FAIR' ELSE 'POOR' END
          AS quality_grade, {rounded('points', 1)} AS penalty_points, total_checks, violations_count, passed_count,
        low_count, medium_count, high_count, critical_count
      FROM (SELECT *, greatest(0, least(100, 100 - points)) AS score FROM
        (SELECT table_name, coalesce(sum(penalty) FILTER (WHERE NOT passed), 0) AS points, count(rule_id) AS total_checks,
           count(*) FILTER (WHERE NOT passed) AS violations_count, count(*) FILTER (WHERE passed) AS passed_count, {counted}
         FROM (VALUES {listed}) t(table_name) LEFT JOIN ({checks}) c USING (table_name) GROUP BY table_name))"""


ALL_CHECKS = "\nUNION ALL\n".join(table_checks_sql(n) for n in KEYS)


def database(spark, folder):
    return Q.evaluate_database({n: table(spark, folder, n) for n in KEYS}, KEYS)


class LongTextRule:
    """A user-defined rule: texts of more than 10,000 characters."""

    rule_id, rule_name = "LONG_TEXT", "Long texts"

    def aggregates(self, df, table_name):
        return {"long": F.count_if(F.length("text") > 10000)}

    def verdict(self, facts, values):
        n = F.lit(values["long"])
        return Q.checks(self, facts.filter("column_name = 'text'"), n, F.lit("MEDIUM"), F.lit(2.5), F.format_string("%d long texts", n), n == 0)


QUERIES = {
    "quality_checks_damaged_orders": lambda s, d: Q.evaluate_table(
        damaged_orders(s, d), "orders", ["o_orderkey", "o_custkey"], with_samples=False).select(*SHOWN),
    "quality_samples_damaged_orders": lambda s, d: Q.violation_samples(
        damaged_orders(s, d), Q.gather_facts(damaged_orders(s, d)), ["o_orderkey", "o_totalprice"])
        .select("rule_id", "column_name", F.array_join(F.transform("sample_violations", lambda v: F.format_string("%.2f", v)), ", ").alias("samples")),
    "quality_score_damaged_orders": lambda s, d: Q.score_tables(Q.evaluate_table(
        damaged_orders(s, d), "orders", ["o_orderkey", "o_custkey"], with_samples=False), ["orders"]),
    "quality_checks_lineitem": lambda s, d: Q.evaluate_table(
        table(s, d, "lineitem"), "lineitem", LINEITEM_KEYS, with_samples=False).select(*SHOWN),
    "quality_table_scores": lambda s, d: database(s, d)[1].drop("error"),
    "quality_database_score": lambda s, d: database(s, d)[2],
    "quality_user_rule": lambda s, d: Q.evaluate_table(
        table(s, d, "documents"), "documents", ["doc_id"], [*Q.BUILT_IN_RULES, LongTextRule()], with_samples=False).select(*SHOWN),
}

ORACLE = {
    "quality_checks_damaged_orders": DAMAGED_CHECKS,
    "quality_samples_damaged_orders": f"""WITH f AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1,
        quantile_cont(o_totalprice, 0.75) AS q3 FROM {DAMAGED}),
      hits AS (SELECT 'QR_NON_NEGATIVE' AS rule_id, o_orderkey, o_totalprice AS v FROM {DAMAGED} WHERE o_totalprice < 0
        UNION ALL SELECT 'QR_EXTREME_OUTLIERS', o_orderkey, o_totalprice FROM {DAMAGED}, f
          WHERE o_totalprice < q1 - 3 * (q3 - q1) OR o_totalprice > q3 + 3 * (q3 - q1)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY o_orderkey, v) AS r FROM hits)
      SELECT rule_id, 'o_totalprice' AS column_name, string_agg(printf('%.2f', {rounded('v', 2)}), ', ' ORDER BY r) AS samples
      FROM ranked WHERE r <= 5 GROUP BY rule_id""",
    "quality_score_damaged_orders": scores_sql(DAMAGED_CHECKS, ["orders"]),
    "quality_checks_lineitem": table_checks_sql("lineitem"),
    "quality_table_scores": scores_sql(ALL_CHECKS, KEYS),
    "quality_database_score": f"""SELECT *, CASE WHEN overall_quality_score >= 90 THEN 'EXCELLENT'
        WHEN overall_quality_score >= 75 THEN 'GOOD' WHEN overall_quality_score >= 60 THEN 'FAIR' ELSE 'POOR' END AS overall_grade
      FROM (SELECT {rounded('avg(quality_score)', 1)} AS overall_quality_score, count(*) AS tables_analyzed,
        CAST(sum(violations_count) AS BIGINT) AS total_violations, CAST(sum(critical_count) AS BIGINT) AS critical_violations,
        CAST(sum(high_count) AS BIGINT) AS high_violations FROM ({scores_sql(ALL_CHECKS, KEYS)}))""",
    "quality_user_rule": f"""SELECT * FROM ({table_checks_sql('documents')}) UNION ALL SELECT 'documents' AS table_name, 'LONG_TEXT' AS rule_id, 'text' AS column_name, n = 0 AS passed,
        CASE WHEN n = 0 THEN 'LOW' ELSE 'MEDIUM' END AS severity, CASE WHEN n = 0 THEN 0.0 ELSE 2.5 END AS penalty,
        n || ' long texts' AS message, n AS violation_count, {_pct('n')} AS violation_percentage
      FROM (SELECT count(*) AS total, count(*) FILTER (WHERE length(text) > 10000) AS n FROM documents)""",
}
