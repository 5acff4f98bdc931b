"""The exact Kolmogorov-Smirnov statistic of whole columns by bounding and refining.

Both sides are counted in a shared grid of cells between the smallest and the
largest value. The ends of cells give gaps that the statistic has at least; the
rows inside a cell bound what it could have at most there. Only cells whose
bound beats the best gap are cut again, all columns that have some in one scan,
so a shuffle carries cells, never values. Where few rows are left, or refining
does not pay, as for two sides that are the same, the rows of the open cells are
ordered once over all tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesight.functions import columns as C
from lakesight.operators.ordering import running_totals
from lakesight.session import side_by_side, small_frame

CELLS = 131_072  # cells that all columns together get in one scan
FIRST_BITS = 14  # the first grid has at most 2 ** FIRST_BITS cells per column
DEEPEST = 50  # bits of the finest grid; a place is a column's number above and its cell in so many bits below
FEW_ROWS = 5_000_000  # so few rows of open cells are ordered at once
_LARGEST = sys.float_info.max


@dataclass
class _Column:
    """One column's state: range of its finite values, sizes, best gap (times both sizes) and open cells."""

    name: str
    low: float
    high: float
    size_b: int
    size_c: int
    best: int = 0
    open: dict[int, tuple[int, int]] = field(default_factory=dict)  # cell: rows of both sides before it

    def gap(self, b: int, c: int) -> int:
        return abs(b * self.size_c - c * self.size_b)


@dataclass(frozen=True)
class Values:
    """Numeric columns of a table as a side of the comparison, with their (size, smallest, largest value) where these are known."""

    df: DataFrame
    names: Sequence[str]
    known: dict[str, tuple[int, float | None, float | None]] = field(default_factory=dict)

    def facts(self) -> dict[str, tuple[int, float | None, float | None]]:
        """Size, smallest and largest finite value of each column with values."""
        finite = lambda x: x is not None and abs(x) <= _LARGEST
        found = {n: f for n, f in self.known.items() if n in self.names and (f[0] == 0 or (finite(f[1]) and finite(f[2])))}
        missing = [n for n in self.names if n not in found]
        if missing:
            v = {n: C.present(self.df, n).cast("double") for n in missing}
            row = self.df.agg(*[a for x in v.values() for a in (F.count(x), F.min(_finite(x)), F.max(_finite(x)))]).first()
            found |= {n: tuple(row[3 * i : 3 * i + 3]) for i, n in enumerate(missing)}
        return {n: f for n, f in found.items() if f[0]}

    def placed(self, columns: dict[int, _Column], bits: int) -> DataFrame:
        """(place, value, n) of the columns under these numbers."""
        own = self.df.select(*[C.present(self.df, c.name).cast("double").alias(f"v{i}") for i, c in columns.items()])
        rows = C.stacked(own, [[_place(F.col(f"v{i}"), i, c, bits), F.col(f"v{i}")] for i, c in columns.items()], ["place", "value"])
        return rows.filter("value IS NOT NULL").withColumn("n", F.lit(1).cast("long"))


@dataclass(frozen=True)
class _Counts:
    """A table (column_name, value, n) as a side of the comparison."""

    df: DataFrame

    def facts(self) -> dict[str, tuple[int, float | None, float | None]]:
        ends = [F.min(_finite(F.col("value"))), F.max(_finite(F.col("value")))]
        return {r[0]: tuple(r[1:]) for r in self.df.groupBy("column_name").agg(F.sum("n"), *ends).collect()}

    def placed(self, columns: dict[int, _Column], bits: int) -> DataFrame:
        place = F.lit(None).cast("long")
        for i, c in columns.items():
            place = F.when(F.col("column_name") == c.name, _place(F.col("value"), i, c, bits)).otherwise(place)
        chosen = self.df.filter(F.col("column_name").isin([c.name for c in columns.values()]))
        return chosen.select(place.alias("place"), "value", F.col("n").cast("long").alias("n"))


def _finite(v: Column) -> Column:
    return F.when(F.abs(v) <= F.lit(_LARGEST), v)


def _place(v: Column, number: int, column: _Column, bits: int) -> Column:
    """The column's number and the cell of the value; halving a cell doubles its number, whatever the rounding. Infinite values are in the outer cells."""
    last, low, high = (1 << bits) - 1, column.low, column.high
    width = (high / 2 - low / 2) / float(1 << bits)
    # the value occurs once, which keeps the generated code of many columns small enough to be compiled
    share = (F.least(F.greatest(v, F.lit(low)), F.lit(high)) / 2 - F.lit(low / 2)) / F.lit(width) if width else F.when(v > low, last).otherwise(0)
    return F.lit(number << DEEPEST).cast("long") + F.least(F.lit(last).cast("long"), F.floor(share).cast("long"))


def _both(baseline: Values | _Counts, current: Values | _Counts, columns: list[_Column], bits: int, parent_bits: int | None = None) -> DataFrame:
    """(place, value, nb, nc) of both sides; after the first grid only of the open cells, whose places are ``parent``."""
    chosen = {i: c for i, c in enumerate(columns) if parent_bits is None or c.open}
    zero, n = F.lit(0).cast("long"), F.col("n")
    part = lambda side, b, c: side.placed(chosen, bits).select("place", "value", b.alias("nb"), c.alias("nc"))
    rows = part(baseline, n, zero).unionByName(part(current, zero, n))
    if parent_bits is None:
        return rows
    cell = F.col("place").bitwiseAND(F.lit((1 << DEEPEST) - 1))
    parent = F.col("place") - cell + F.shiftright(cell, bits - parent_bits)
    opened = [((i << DEEPEST) + cell,) for i, c in chosen.items() for cell in c.open]  # at most as many as cells in one scan
    return rows.withColumn("parent", parent).join(F.broadcast(small_frame(rows.sparkSession, opened, "parent long")), "parent")


def _refined(rows: DataFrame, columns: list[_Column], bits: int, parent_bits: int) -> tuple[int, int]:
    """Count rows in the cells of a finer grid, update gaps and open cells; returns the numbers of open cells and of their rows."""
    cells = rows.groupBy("place").agg(F.sum("nb").alias("b"), F.sum("nc").alias("c"), (F.min("value") < F.max("value")).alias("several")).collect()
    found: list[list[tuple[int, int, int, bool]]] = [[] for _ in columns]
    for place, b, c, several in sorted(cells):
        found[place >> DEEPEST].append((place & ((1 << DEEPEST) - 1), b, c, several))
    inside = 0
    for column, own in zip(columns, found):
        before, place, bounds = (0, 0), None, []
        for cell, b, c, several in own:
            parent = cell >> (bits - parent_bits)
            if parent != place:
                place, before = parent, column.open[parent] if column.open else (0, 0)
            upto = (before[0] + b, before[1] + c)
            column.best = max(column.best, column.gap(*upto))
            if several:  # one side may come first as a whole
                bounds.append((cell, before, b + c, max(column.gap(upto[0], before[1]), column.gap(before[0], upto[1]))))
            before = upto
        column.open = {cell: start for cell, start, _, most in bounds if most > column.best}
        inside += sum(n for _, _, n, most in bounds if most > column.best)
    return sum(len(c.open) for c in columns), inside


def _ordered(rows: DataFrame, columns: list[_Column]) -> None:
    """Finish the open cells by the order of their rows, spread over all tasks."""
    starts = [((i << DEEPEST) + cell, i, *start) for i, c in enumerate(columns) for cell, start in c.open.items()]
    merged = rows.groupBy("parent", "value").agg(F.sum("nb").alias("nb"), F.sum("nc").alias("nc"))
    totals = running_totals(merged, "parent", "value", ["nb", "nc"]).join(
        F.broadcast(small_frame(rows.sparkSession, starts, "parent long, slot int, b long, c long")), "parent")
    size = lambda values: F.element_at(F.array(*[F.lit(v).cast("decimal(20,0)") for v in values]), F.col("slot") + 1)
    gap = F.abs((F.col("b") + F.col("upto_nb")) * size([c.size_c for c in columns]) - (F.col("c") + F.col("upto_nc")) * size([c.size_b for c in columns]))
    for r in totals.groupBy("slot").agg(F.max(gap).alias("best")).collect():
        column = columns[r.slot]
        column.best = max(column.best, int(r.best))


def ks_statistics(baseline: DataFrame | Values, current: DataFrame | Values, cells: int = CELLS, few_rows: int = FEW_ROWS) -> DataFrame:
    """(column_name, ks, size_b, size_c) of tables, or of tables (column_name, value, n), whose rows need not be grouped."""
    sides = [side if isinstance(side, Values) else _Counts(side) for side in (baseline, current)]
    spark = sides[0].df.sparkSession
    old, new = side_by_side(spark, [side.facts for side in sides])
    columns = []
    for name in sorted(set(old) & set(new)):
        ends = [x for side in (old, new) for x in side[name][1:] if x is not None] or [0.0]
        columns.append(_Column(name, min(ends), max(ends), old[name][0], new[name][0]))
    if columns:
        bits = max(1, min(FIRST_BITS, (cells // len(columns)).bit_length() - 1))
        count, inside = _refined(_both(*sides, columns, bits), columns, bits, 0)
        while count:
            more = min((cells // count).bit_length() - 1, DEEPEST - bits)
            if inside <= few_rows or more < 2:  # few rows are left, nearly all cells are still open, or the grid is at its finest
                _ordered(_both(*sides, columns, bits, bits), columns)
                break
            rows, parent_bits, bits = _both(*sides, columns, bits + more, bits), bits, bits + more
            count, inside = _refined(rows, columns, bits, parent_bits)
    found = [(c.name, c.best / (c.size_b * c.size_c), c.size_b, c.size_c) for c in columns]
    return small_frame(spark, found, "column_name string, ks double, size_b long, size_c long")
