"""Statistics Spark has no built-in for, as plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_percent(new: Column, old: Column, when_zero: Column | None = None) -> Column:
    """(new - old) / |old| * 100; ``when_zero`` (default NULL) where old is 0."""
    change = F.try_divide(new - old, F.abs(old)) * 100
    if when_zero is None:
        return F.when(old != 0, change)
    return F.when(old != 0, change).otherwise(when_zero)


def unbiased_skewness(population: Column, n: Column) -> Column:
    """Adjusted Fisher-Pearson skewness from the population form; 0 below 3 values or without spread."""
    n = n.cast("double")
    return F.when(n > 2, F.coalesce(population * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))).otherwise(0.0)


def slope_p_value(r_squared: Column, n: Column) -> Column:
    """Two-sided p of a regression slope over ``n`` points.

    Student's t with integer degrees of freedom has a finite series
    (Abramowitz and Stegun 26.7.3-4), summed here with ``aggregate``.
    """
    df = (n - 2).cast("int")
    t = F.sqrt(r_squared * df / F.nullif(1 - r_squared, F.lit(0.0)))
    theta = F.atan(t / F.sqrt(df.cast("double")))
    cos2, sin = F.pow(F.cos(theta), F.lit(2)), F.sin(theta)
    odd = df % 2 == 1

    def series(steps: Column, ratio) -> Column:
        state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

        def add(acc: Column, i: Column) -> Column:
            term = acc["term"] * ratio(i) * cos2
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        numbers = F.filter(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), lambda i: i <= steps)
        return F.aggregate(numbers, state, add, lambda acc: acc["total"])

    half = (df / 2).cast("int")
    even_area = sin * series(half - 1, lambda i: (2.0 * i - 1) / (2.0 * i))
    odd_area = (2 / math.pi) * (
        theta + F.when(df > 1, sin * F.cos(theta) * series(half - 1, lambda i: 2.0 * i / (2.0 * i + 1))).otherwise(0.0)
    )
    inside = F.when(odd, odd_area).otherwise(even_area)
    return F.when(df < 1, 0.0).when(r_squared >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - inside))


#: With at most so many pairs of values the Kolmogorov-Smirnov p is counted exactly, beyond by the series.
EXACT_PAIRS = 10_000


def ks_exact_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Exact two-sample Kolmogorov-Smirnov p: the share of lattice paths that leave the band of the observed gap.

    A path goes from (0, 0) to (n, m), one step per value in the order of both
    samples together; all are equally likely without a difference. The state is
    the probability to reach (i, j) without touching the band's edge, a row of
    them per step of ``i``. Probabilities, unlike counts, stay within a double.
    """
    small, large = F.least(n, m).cast("int"), F.greatest(n, m).cast("int")
    nm = small.cast("long") * large
    edge = F.round(statistic * nm).cast("long")
    inside = lambda i, j: F.abs(i.cast("long") * small - j.cast("long") * large) < edge
    left = lambda i, j: (large + small - i - j + 1).cast("double")  # steps left before the one to (i, j)

    def row(above: Column, i: Column) -> Column:
        def place(done: Column, j: Column) -> Column:
            down = F.when(i == 0, F.when(j == 0, 1.0).otherwise(0.0)).otherwise(F.get(above, j) * (large - i + 1) / left(i, j))
            across = F.when(j == 0, 0.0).otherwise(F.coalesce(F.get(done, j - 1), F.lit(0.0)) * (small - j + 1) / left(i, j))
            return F.concat(done, F.array(F.when(inside(i, j), down + across).otherwise(0.0)))

        return F.aggregate(F.sequence(F.lit(0), small), F.array().cast("array<double>"), place)

    rows = F.aggregate(F.sequence(F.lit(0), large), F.array_repeat(F.lit(0.0), small + 1), row)
    return F.when(edge <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.get(rows, small))))


def ks_p_value(statistic: Column, n: Column, m: Column, terms: int = 100, exact_pairs: int = EXACT_PAIRS) -> Column:
    """Two-sample Kolmogorov-Smirnov p: exact for up to ``exact_pairs`` pairs of values, else asymptotic."""
    few = n.cast("double") * m.cast("double") <= exact_pairs
    return F.when(few, ks_exact_p_value(statistic, F.when(few, n), F.when(few, m))).otherwise(ks_asymptotic_p_value(statistic, n, m, terms))


def ks_asymptotic_p_value(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p from the alternating exponential series."""
    n, m = n.cast("double"), m.cast("double")
    lam = statistic * F.sqrt(n * m / (n + m))
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + sign(k) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))
