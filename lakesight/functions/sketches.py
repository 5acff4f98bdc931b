"""KLL quantile sketches: bounded summaries of a column that merge, with a known rank error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesight.functions import columns as C
from lakesight.session import small_frame

K = 4096
POINTS = 1000  # quantiles at which two sketches are compared
SKETCHES = "column_name string, n bigint, k int, sketch binary"


def rank_error(k: int) -> float:
    """Error of a rank, as a share of the rows, that a sketch keeps at 99 % confidence (formula of Apache DataSketches)."""
    return 2.296 / k**0.9723


def k_for(error: float) -> int:
    """The smallest sketch with at most this rank error."""
    k = max(8, min(65_535, int((2.296 / error) ** (1 / 0.9723)) + 1))
    if rank_error(k) > error:
        raise ValueError(f"no sketch has a rank error of {error}")
    return k


def sketched(df: DataFrame, names: list[str] | None = None, k: int = K) -> DataFrame:
    """(column_name, n, k, sketch) of numeric columns, in one scan; one row per column whatever the number of rows."""
    names = names or C.numeric_columns(df)
    if not names:
        return small_frame(df.sparkSession, [], SKETCHES)
    values = {n: C.present(df, n).cast("double") for n in names}
    rows = df.agg(*[F.struct(F.lit(n).alias("column_name"), F.count(v).alias("n"), F.lit(k).alias("k"),
                             F.kll_sketch_agg_double(v, k).alias("sketch")).alias(f"c{i}") for i, (n, v) in enumerate(values.items())])
    return rows.select(F.inline(F.array(*[f"c{i}" for i in range(len(names))]))).filter("n > 0")


def merged(*parts: DataFrame) -> DataFrame:
    """Sketches of slices of a table as the sketches of the whole."""
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined.groupBy("column_name").agg(F.sum("n").alias("n"), F.min("k").alias("k"), F.kll_merge_agg_double("sketch").alias("sketch"))


def approximate_quantiles(df: DataFrame, values: dict[str, Column], probabilities: tuple[float, ...], error: float = 0.01) -> dict[str, dict[float, float]]:
    """Quantiles whose ranks are off by at most ``error`` of the rows (at 99 % confidence), in one scan of any table."""
    k = k_for(error)
    names = list(values)
    kept = {n: F.when(~F.isnan(v.cast("double")), v.cast("double")) for n, v in values.items()}
    row = df.agg(*[F.count(kept[n]).alias(f"n{i}") for i, n in enumerate(names)],
                 *[F.kll_sketch_agg_double(kept[n], k).alias(f"s{i}") for i, n in enumerate(names)])
    wanted = F.array(*map(F.lit, probabilities))
    row = row.select(*[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", wanted)).alias(f"q{i}") for i in range(len(names))]).first()
    return {n: dict(zip(probabilities, row[f"q{i}"])) if row[f"q{i}"] else {} for i, n in enumerate(names)}


def ks_of_sketches(baseline: DataFrame, current: DataFrame, points: int = POINTS) -> DataFrame:
    """(column_name, ks, ks_error, size_b, size_c): the largest gap of two sketched distributions.

    Both distributions are read off ``points`` quantiles. The gap differs from
    the exact one by the two rank errors and two steps between quantiles at most.
    """
    shares = F.array(*[F.lit(i / points) for i in range(points + 1)])
    sides = baseline.select("column_name", F.col("sketch").alias("b"), F.col("n").alias("size_b"), F.col("k").alias("k_b")).join(
        current.select("column_name", F.col("sketch").alias("c"), F.col("n").alias("size_c"), F.col("k").alias("k_c")), "column_name")
    q = sides.withColumns({"q_b": F.kll_sketch_get_quantile_double("b", shares), "q_c": F.kll_sketch_get_quantile_double("c", shares)})
    rank = lambda quantiles, x: F.size(F.filter(quantiles, lambda v: v <= x)) / (points + 1)
    gap = F.array_max(F.transform(F.array_distinct(F.concat("q_b", "q_c")), lambda x: F.abs(rank("q_b", x) - rank("q_c", x))))
    error = lambda k: F.lit(2.296) / F.pow(F.col(k).cast("double"), F.lit(0.9723))
    return q.select("column_name", gap.alias("ks"), (error("k_b") + error("k_c") + 2.0 / points).alias("ks_error"), "size_b", "size_c")
