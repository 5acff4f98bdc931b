"""One-pass column summaries with exact quantiles at any size.

Spark's ``percentile`` keeps every distinct value of a group in one task, which
is fine up to a checked number of values. Beyond it, a quantile sketch from the
same scan as the other statistics gives a narrow range for each quantile; a scan
counts the rows before and inside these ranges, and one more ranks the few rows
inside. The counts prove each range; where a range is wrong or holds too many
rows, quantiles are found by narrowing: one scan counts rows in bins between the
smallest and largest value,
the bin that holds a wanted rank is split again by the next scan, and so on
until a bin holds one value or few enough rows to rank them outright. Bins have
equal widths, or equal ratios while a range spans several magnitudes, so that
two scans settle the magnitude and six more all digits of a double, whatever the
data. Every scan shuffles a bounded number of bins per column, never the values.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesight.functions.columns import named, stacked
from lakesight.functions.sketches import K, rank_error

SINGLE_PASS_VALUES = 1_000_000
BINS = 1_024
RANKED_ROWS = 100_000
SPREAD_BELOW = 5_000_000

REACH = 3 * rank_error(K)  # half width of a sketch's range, as a share of the rows
WIDE = 20  # a range over more than so many powers of two is cut by ratios
_LARGEST = sys.float_info.max
_SMALLEST = 1075  # more than the powers of two below 1, so that magnitudes keep the values' order through zero


@dataclass
class Summary:
    """Scalars of one column; values are doubles, None when there are none."""

    count: int = 0
    minimum: float | None = None
    maximum: float | None = None
    mean: float | None = None
    std: float | None = None
    skewness: float | None = None
    quantiles: dict[float, float] = field(default_factory=dict)

    def quantile(self, p: float) -> float | None:
        return self.quantiles.get(p)

    @property
    def iqr(self) -> float | None:
        q1, q3 = self.quantile(0.25), self.quantile(0.75)
        return None if q1 is None or q3 is None else q3 - q1


def summarise(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: tuple[float, ...] = (),
    extra: dict[str, Column] | None = None,
    single_pass_values: int = SINGLE_PASS_VALUES,
) -> tuple[dict[str, Summary], dict]:
    """Summaries of several double columns, plus ``extra`` aggregates, in one scan.

    NULLs are left out. Returns (summary per name, values of ``extra`` with "rows").
    """
    extra = extra or {}
    names = list(values)
    values = {n: v.cast("double") for n, v in values.items()}
    in_one_pass = bool(probabilities) and df.count() * len(names) <= single_pass_values
    aggregates = [F.count(F.lit(1)).alias("rows")]
    aggregates += [e.alias(f"x{i}") for i, e in enumerate(extra.values())]
    for i, v in enumerate(values.values()):
        stats = [F.count(v), F.min(v), F.max(v), F.avg(v), F.stddev_samp(v), F.skewness(v)]
        if in_one_pass:
            stats.append(F.percentile(v, F.array(*map(F.lit, probabilities))))
        elif probabilities:
            stats.append(F.kll_sketch_agg_double(v, K))
        aggregates.append(F.struct(*[s.alias(f"f{j}") for j, s in enumerate(stats)]).alias(f"s{i}"))
    found = df.agg(*aggregates)
    if probabilities and not in_one_pass:
        ends = F.array(*[F.lit(min(1.0, max(0.0, p + side))) for p in probabilities for side in (-REACH, REACH)])
        for i in range(len(names)):
            own = F.col(f"s{i}")
            kept = F.when(own["f0"] > 0, F.kll_sketch_get_quantile_double(own["f6"], ends))
            found = found.withColumn(f"s{i}", F.struct(*[own[f"f{j}"] for j in range(6)], kept))
    row = found.first()

    summaries = {n: Summary(*row[f"s{i}"][:6]) for i, n in enumerate(names)}
    for i, (name, summary) in enumerate(summaries.items()):
        if in_one_pass and summary.count:
            summary.quantiles = dict(zip(probabilities, row[f"s{i}"][6]))
    if probabilities and not in_one_pass:
        ranges = {(n, p): tuple(row[f"s{i}"][6][2 * j : 2 * j + 2]) for i, n in enumerate(names) if summaries[n].count for j, p in enumerate(probabilities)}
        _add_exact_quantiles(df, values, summaries, probabilities, row["rows"], ranges)
    return summaries, {"rows": row["rows"], **{key: row[f"x{i}"] for i, key in enumerate(extra)}}


def exact_quantiles(df: DataFrame, value: Column, probabilities: tuple[float, ...], **kw) -> dict[float, float]:
    """Linear-interpolated quantiles of one expression."""
    return summarise(df, {"v": value}, probabilities, **kw)[0]["v"].quantiles


@dataclass(frozen=True)
class _Bracket:
    """The ``rank``-th row (from 0) of the ``inside`` rows of a column between ``lo`` and ``hi``, both present."""

    name: str
    wanted: int
    rank: int
    inside: int
    lo: float
    hi: float


def _ranks(p: float, n: int) -> tuple[int, int]:
    position = (n - 1) * p
    return math.floor(position), math.ceil(position)


def _add_exact_quantiles(df, values, summaries: dict[str, Summary], probabilities, rows: int, ranges: dict) -> None:
    wanted = {
        _Bracket(name, rank, rank, s.count, s.minimum, s.maximum)
        for name, s in summaries.items() if s.count
        for p in probabilities for rank in _ranks(p, s.count)
    }
    likely = {(name, rank): ranges[name, p] for name, s in summaries.items() if s.count for p in probabilities for rank in _ranks(p, s.count)}
    found = _order_statistics(df, values, wanted, rows, likely) if wanted else {}
    for name, s in summaries.items():
        for p in probabilities if s.count else ():
            below, above = _ranks(p, s.count)
            low, high = found[name, below], found[name, above]
            share = (s.count - 1) * p - below
            s.quantiles[p] = between(low, high, share)


def between(low: float, high: float, share: float) -> float:
    """Linear interpolation by the formula of Spark's ``percentile``, so that both ways give the same digits."""
    return low if low == high or not share else low * (1 - share) + high * share


def _proved(df, values: dict[str, Column], brackets: set[_Bracket], likely: dict[tuple[str, int], tuple[float, float]]) -> set[_Bracket]:
    """Each bracket cut to its likely range, if one count of the rows before and inside shows that its rank is there."""
    ranges = sorted({(name, *ends) for (name, _), ends in likely.items()})
    counts = df.agg(F.array(*[F.array(F.count_if(values[n] < lo), F.count_if(values[n].between(lo, hi))) for n, lo, hi in ranges]).alias("c")).first().c
    known = dict(zip(ranges, counts))
    out = set()
    for b in brackets:
        lo, hi = likely[b.name, b.wanted]
        before, inside = known[b.name, lo, hi]
        good = before <= b.rank < before + inside
        out.add(replace(b, rank=b.rank - before, inside=inside, lo=lo, hi=hi) if good else b)
    return out


def _order_statistics(df: DataFrame, values: dict[str, Column], brackets: set[_Bracket], rows: int, likely: dict) -> dict:
    """The value at each bracket's rank. A small table is spread over all cores and kept for the passes."""
    brackets = _proved(df, values, brackets, likely)
    if rows > SPREAD_BELOW:
        return _search(df, values, brackets)
    kept = df.select(*[v.alias(n) for n, v in values.items()]).repartition(df.sparkSession.sparkContext.defaultParallelism)
    kept.persist()
    try:
        return _search(kept, {n: named(n) for n in values}, brackets)
    finally:
        kept.unpersist()


def _search(df, values: dict[str, Column], brackets: set[_Bracket]) -> dict[tuple[str, int], float]:
    found: dict[tuple[str, int], float] = {}
    while brackets:
        found |= {(b.name, b.wanted): b.lo for b in brackets if b.lo == b.hi}
        brackets = {b for b in brackets if b.lo != b.hi}
        few = {b for b in brackets if b.inside <= RANKED_ROWS}
        if few:
            found |= _rank_inside(df, values, few)
        brackets = _narrow(df, values, brackets - few) if brackets - few else set()
    return found


def _ranges(brackets: set[_Bracket]) -> list[tuple[str, float, float]]:
    return sorted({(b.name, b.lo, b.hi) for b in brackets})


def _per_slot(numbers: list) -> Column:
    """The entry of a literal list that belongs to the row's slot."""
    return F.element_at(F.array(*map(F.lit, numbers)), F.col("slot") + 1)


def _rows_inside(df, values: dict[str, Column], ranges) -> DataFrame:
    """(slot, v) for every value inside a range; ``slot`` numbers the ranges.

    Bounds are looked up by slot after stacking, which keeps the generated code small.
    """
    lows, highs = [r[1] for r in ranges], [r[2] for r in ranges]
    touched = F.lit(False)
    for name in {r[0] for r in ranges}:
        own = [(lo, hi) for n, lo, hi in ranges if n == name]
        touched = touched | values[name].between(min(lo for lo, _ in own), max(hi for _, hi in own))
    rows = stacked(df.filter(touched), [[F.lit(i), values[name]] for i, (name, _, _) in enumerate(ranges)], ["slot", "v"])
    return rows.filter((F.col("v") >= _per_slot(lows)) & (F.col("v") <= _per_slot(highs)))


def _magnitude(x: float) -> float:
    return math.copysign(math.log2(abs(x)) + _SMALLEST, x) if x else 0.0


def _narrow(df, values, brackets: set[_Bracket]) -> set[_Bracket]:
    """Replace each bracket by the bin of its range that holds its rank."""
    ranges = _ranges(brackets)
    # infinite ends get bins of their own; scaling before subtracting keeps the widest range finite
    lows = [max(lo, -_LARGEST) for _, lo, _ in ranges]
    highs = [min(hi, _LARGEST) for _, _, hi in ranges]
    wide = [low <= 0 <= high or abs(math.log2(high / low)) > WIDE for low, high in zip(lows, highs)]
    widths = [(_magnitude(high) - _magnitude(low)) / BINS if w else (high / BINS - low / BINS) / BINS for low, high, w in zip(lows, highs, wide)]
    v, low = F.col("v"), _per_slot(lows)
    size = F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + _SMALLEST))
    by_ratio = (size - _per_slot([_magnitude(x) for x in lows])) / _per_slot(widths)
    share = F.floor(F.when(_per_slot(wide), by_ratio).otherwise((v / BINS - low / BINS) / _per_slot(widths)))
    inside = F.greatest(F.lit(0), F.least(share, F.lit(BINS - 1)))
    index = F.when(v < low, -1).when(v > _per_slot(highs), BINS).otherwise(inside)
    bins = (
        _rows_inside(df, values, ranges)
        .groupBy("slot", index.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .orderBy("slot", "bin")
        .collect()
    )
    by_slot: dict[int, list] = {}
    for row in bins:
        by_slot.setdefault(row.slot, []).append(row)
    narrower = set()
    for b in brackets:
        before = 0
        for row in by_slot[ranges.index((b.name, b.lo, b.hi))]:
            if b.rank < before + row.n:
                narrower.add(replace(b, rank=b.rank - before, inside=row.n, lo=row.lo, hi=row.hi))
                break
            before += row.n
    return narrower


def _rank_inside(df, values, brackets: set[_Bracket]) -> dict[tuple[str, int], float]:
    """Rank the rows of each bracket, at most RANKED_ROWS per range."""
    ranges = _ranges(brackets)
    wanted: list[dict[int, _Bracket]] = [{} for _ in ranges]
    for b in brackets:
        wanted[ranges.index((b.name, b.lo, b.hi))][b.rank] = b
    targets = F.element_at(F.array(*[F.array(*map(F.lit, sorted(w))) for w in wanted]), F.col("slot") + 1)
    running = F.sum("n").over(Window.partitionBy("slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hits = (
        _rows_inside(df, values, ranges)
        .groupBy("slot", "v").agg(F.count("*").alias("n"))
        .withColumn("upto", running)
        .select("slot", "v", F.filter(targets, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))).alias("ranks"))
        .filter(F.size("ranks") > 0)
        .collect()
    )
    found = {}
    for h in hits:
        for rank in h.ranks:
            b = wanted[h.slot][rank]
            found[b.name, b.wanted] = h.v
    return found
