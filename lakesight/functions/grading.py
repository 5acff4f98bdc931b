"""Severity and grade scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, MEDIUM, HIGH, CRITICAL = "LOW", "MEDIUM", "HIGH", "CRITICAL"
SEVERITIES = (LOW, MEDIUM, HIGH, CRITICAL)

# Lower bounds of each step, highest first.
SEVERITY_STEPS = ((4.0, CRITICAL), (3.2, HIGH), (2.5, MEDIUM))
GRADE_STEPS = ((90.0, "EXCELLENT"), (75.0, "GOOD"), (60.0, "FAIR"))


def _stepped(value: Column, steps: tuple, lowest: str) -> Column:
    scale = None
    for bound, label in steps:
        scale = F.when(value >= bound, label) if scale is None else scale.when(value >= bound, label)
    return scale.otherwise(lowest)


def severity(deviation: Column) -> Column:
    return _stepped(F.abs(deviation), SEVERITY_STEPS, LOW)


def grade(score: Column) -> Column:
    return _stepped(score, GRADE_STEPS, "POOR")


def severity_counts(column: str = "severity") -> list[Column]:
    """One count per severity, for use in ``agg``."""
    return [F.count_if(F.col(column) == s).alias(f"{s.lower()}_count") for s in SEVERITIES]
