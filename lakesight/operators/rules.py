"""Business rules: row conditions that should hold for no row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesight.functions.columns import named
from lakesight.plans.guard import UnsafeSql, check_condition
from lakesight.session import small_frame

SAMPLE_ROWS = 20
_RESULT = (
    "rule_name string, table_name string, condition string, severity string, alert_message string, "
    "status string, violation_count bigint, error string"
)


@dataclass(frozen=True)
class Rule:
    name: str
    table: str
    condition: str
    severity: str = "HIGH"
    alert_message: str = "Business condition violated."
    active: bool = True


def violations(df: DataFrame, rule: Rule) -> DataFrame:
    """All rows the rule's condition picks."""
    return df.filter(F.expr(check_condition(rule.condition)))


def sample_violations(df: DataFrame, rule: Rule, order: Sequence[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    return violations(df, rule).orderBy(*[named(o) for o in order]).limit(rows)


def _counts(df: DataFrame, rules: Sequence[Rule]) -> list[int]:
    """Violations of each rule, all from one scan of the columns the conditions name."""
    found = [F.count_if(F.expr(check_condition(r.condition))) for r in rules]
    return df.agg(F.array(*found).alias("n")).first().n


def execute_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Status and full violation count of every active rule of one table.

    Refused or unresolvable conditions become ERROR rows before anything runs.
    If a condition fails on the data, the rules are run one by one to tell which.
    """
    active = [r for r in rules if r.active]
    errors: dict[int, str] = {}
    for i, rule in enumerate(active):
        try:
            violations(df, rule).schema
        except (UnsafeSql, PySparkException) as error:
            errors[i] = str(error).splitlines()[0]
    sound = [i for i in range(len(active)) if i not in errors]
    counts: dict[int, int] = {}
    try:
        counts = dict(zip(sound, _counts(df, [active[i] for i in sound]))) if sound else {}
    except PySparkException:
        for i in sound:
            try:
                counts[i] = _counts(df, [active[i]])[0]
            except PySparkException as error:
                errors[i] = str(error).splitlines()[0]
    rows = []
    for i, r in enumerate(active):
        n = counts.get(i, 0)
        status = "ERROR" if i in errors else "VIOLATION" if n else "PASSED"
        rows.append((r.name, r.table, r.condition, r.severity, r.alert_message, status, n, errors.get(i)))
    return small_frame(df.sparkSession, rows, _RESULT)


def execute_all_rules(tables: dict[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Every active rule of every table; one scan per table."""
    result = None
    for name, df in tables.items():
        own = [r for r in rules if r.table == name]
        if own:
            part = execute_rules(df, own)
            result = part if result is None else result.unionByName(part)
    return result
