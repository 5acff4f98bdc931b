"""Business rules over whole tables."""

from checks.common import table
from lakesight.operators import rules as R

RULES = [
    R.Rule("Large discount", "lineitem", "l_discount >= 0.09", "HIGH", "Discount near the limit"),
    R.Rule("Cheap bulk", "lineitem", "l_quantity > 45 AND l_extendedprice / l_quantity < 950", "CRITICAL", "Bulk below cost"),
    R.Rule("Impossible tax", "lineitem", "l_tax > 1", "HIGH", "Tax above 100 percent"),
    R.Rule("Unknown column", "lineitem", "l_colour = 'red'", "LOW", "Never resolves"),
    R.Rule("Sleeping", "lineitem", "l_tax > 0", "LOW", "Switched off", active=False),
    R.Rule("Urgent and open", "orders", "o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'", "MEDIUM", "Urgent order open"),
    R.Rule("Overdrawn", "customer", "c_acctbal < 0", "MEDIUM", "Balance below zero"),
    R.Rule("Two statements", "customer", "1 = 1; DROP TABLE x", "LOW", "Refused"),
]


def rule_sql(r, error=False):
    q = lambda x: "'" + x.replace("'", "''") + "'"
    fixed = f"{q(r.name)} AS rule_name, {q(r.table)} AS table_name, {q(r.condition)} AS condition, {q(r.severity)} AS severity, {q(r.alert_message)} AS alert_message"
    if error:
        return f"SELECT {fixed}, 'ERROR' AS status, CAST(0 AS BIGINT) AS violation_count"
    return f"""SELECT {fixed}, CASE WHEN n > 0 THEN 'VIOLATION' ELSE 'PASSED' END AS status, n AS violation_count
        FROM (SELECT count(*) AS n FROM {r.table} WHERE {r.condition})"""


BULK = RULES[1]

QUERIES = {
    "rules_all_tables": lambda s, d: R.execute_all_rules(
        {n: table(s, d, n) for n in ("lineitem", "orders", "customer")}, RULES).drop("error"),
    "rules_violating_rows": lambda s, d: R.violations(table(s, d, "lineitem"), BULK),
    "rules_sample_rows": lambda s, d: R.sample_violations(
        table(s, d, "customer"), RULES[6], ["c_custkey"]),
}

ORACLE = {
    "rules_all_tables": "\nUNION ALL\n".join(
        rule_sql(r, r.name in ("Unknown column", "Two statements")) for r in RULES if r.active),
    "rules_violating_rows": f"SELECT * FROM lineitem WHERE {BULK.condition}",
    "rules_sample_rows": "SELECT * FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 20",
}
