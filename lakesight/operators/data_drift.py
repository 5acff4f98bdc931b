"""Distribution drift of numeric columns against a stored baseline.

A baseline is two tables: one row of statistics per column, and either a
quantile sketch per column, of bounded size, or the counts of every distinct
value. The Kolmogorov-Smirnov statistic of two tables, or of a table and stored
counts, is exact; that of sketches has a stated error.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesight.functions import columns as C
from lakesight.functions.sketches import ks_of_sketches, sketched
from lakesight.functions.stats import ks_p_value
from lakesight.functions.summary import Summary, summarise
from lakesight.operators.distribution import Values, ks_statistics
from lakesight.session import side_by_side, small_frame

# Minimum rows and the thresholds of drift and its severity.
MIN_VALUES = 5
MAX_P = 0.05
KS_DRIFT, KS_HIGH, KS_CRITICAL = 0.15, 0.25, 0.40
SHIFT_DRIFT, SHIFT_HIGH, SHIFT_CRITICAL = 20.0, 30.0, 50.0
NEAR_ZERO = 1e-6

STATISTICS = (
    "database_name string, table_name string, column_name string, sample_size bigint, mean_val double, std_val double, "
    "min_val double, max_val double, median_val double, p25_val double, p75_val double"
)
KEY = ["database_name", "table_name", "column_name"]


def baseline_statistics(df: DataFrame, database: str, table: str) -> DataFrame:
    """Size, mean, deviation, range and quartiles of each numeric column with at least 5 values."""
    return _statistics(df, _summaries(df), database, table)


def _summaries(df: DataFrame) -> dict[str, Summary]:
    return summarise(df, {n: C.present(df, n) for n in C.numeric_columns(df)}, (0.25, 0.5, 0.75))[0]


def _statistics(df: DataFrame, summaries: dict[str, Summary], database: str, table: str) -> DataFrame:
    rows = [
        (database, table, n, s.count, s.mean, s.std or 0.0, s.minimum, s.maximum,
         s.quantile(0.5), s.quantile(0.25), s.quantile(0.75))
        for n, s in summaries.items()
        if s.count >= MIN_VALUES
    ]
    return small_frame(df.sparkSession, rows, STATISTICS)


def _values(df: DataFrame, summaries: dict[str, Summary]) -> Values:
    """The numeric columns as a side of a comparison; their sizes and ends need no further scan."""
    return Values(df, list(summaries), {n: (s.count, s.minimum, s.maximum) for n, s in summaries.items()})


def column_values(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column_name, value, n = 1) for every numeric value."""
    names = names or C.numeric_columns(df)
    pairs = [[F.lit(n), C.present(df, n).cast("double")] for n in names]
    return C.stacked(df, pairs, ["column_name", "value"]).filter(F.col("value").isNotNull()).withColumn("n", F.lit(1).cast("long"))


def value_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column_name, value, n) for every distinct numeric value."""
    names = names or C.numeric_columns(df)
    pairs = [[F.lit(i), C.present(df, n).cast("double")] for i, n in enumerate(names)]  # numbers are grouped faster than names
    counts = C.stacked(df, pairs, ["slot", "value"]).filter("value IS NOT NULL").groupBy("slot", "value").agg(F.count("*").alias("n"))
    return counts.select(F.get(F.array(*map(F.lit, names)), F.col("slot")).alias("column_name"), "value", "n")


def upsert_baseline(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Stored statistics with the rows of ``fresh`` replaced or added."""
    if stored is None:
        return fresh
    return stored.join(fresh, KEY, "left_anti").unionByName(fresh)


def compare(
    baseline: DataFrame, baseline_counts: DataFrame | Values, current: DataFrame, current_counts: DataFrame | Values
) -> DataFrame:
    """Drift verdict per column found in both statistics tables, from values or their counts on both sides."""
    return judge(baseline, current, ks_statistics(baseline_counts, current_counts))


def compare_with_stored(baseline: DataFrame, stored: DataFrame, df: DataFrame, database: str = "", table: str = "") -> DataFrame:
    """Drift verdict of a table against a stored baseline, whose values are sketches or counts."""
    summaries = _summaries(df)
    current = _statistics(df, summaries, database, table)
    if "sketch" not in stored.columns:
        return compare(baseline, stored, current, _values(df, summaries))
    k = stored.agg(F.max("k")).first()[0]
    names = [r.column_name for r in baseline.select("column_name").distinct().collect() if r.column_name in C.numeric_columns(df)]
    ks = ks_of_sketches(stored, sketched(df, names, k)) if names else small_frame(df.sparkSession, [], "column_name string, ks double, ks_error double, size_b long, size_c long")
    return judge(baseline, current, ks)


def judge(baseline: DataFrame, current: DataFrame, ks: DataFrame) -> DataFrame:
    """Drift verdict per column from two statistics tables and the distances of the distributions.

    With a ``ks_error``, the verdict says so where the distance is so near to a
    threshold that the error could decide.
    """
    b = baseline.select("column_name", F.col("mean_val").alias("mean_b"), F.col("std_val").alias("std_b"),
                        F.col("median_val").alias("median_b"))
    c = current.select("column_name", F.col("mean_val").alias("mean_c"), F.col("std_val").alias("std_c"),
                       F.col("median_val").alias("median_c"))
    shift = lambda new, old: F.round(
        (F.col(new) - F.col(old)) / F.when(F.abs(old) > NEAR_ZERO, F.abs(old)).otherwise(1.0) * 100, 2)
    judged = (
        # one row per column on every side
        c.join(b, "column_name").join(ks, "column_name", "left")
        .withColumn("ks", F.coalesce("ks", F.lit(0.0)))
        .withColumn("p", F.coalesce(ks_p_value(F.col("ks"), F.col("size_b"), F.col("size_c")), F.lit(1.0)))
        .withColumn("mean_shift_pct", shift("mean_c", "mean_b"))
        .withColumn("std_shift_pct", shift("std_c", "std_b"))
    )
    with_error = "ks_error" in ks.columns
    near = F.lit(False)
    for threshold in (KS_DRIFT, KS_HIGH, KS_CRITICAL) if with_error else ():
        near = near | (F.abs(F.col("ks") - threshold) <= F.coalesce("ks_error", F.lit(0.0)))
    doubt = F.when(near, "; a threshold lies within the sketches' error").otherwise("")
    moved = F.abs("mean_shift_pct")
    drifted = ((F.col("p") < MAX_P) & (F.col("ks") > KS_DRIFT)) | (moved >= SHIFT_DRIFT)
    level = (
        F.when(~drifted, "NONE")
        .when((F.col("ks") > KS_CRITICAL) | (moved > SHIFT_CRITICAL), "CRITICAL")
        .when((F.col("ks") > KS_HIGH) | (moved > SHIFT_HIGH), "HIGH")
        .otherwise("MEDIUM")
    )
    return judged.select(
        "column_name",
        drifted.alias("drift_detected"),
        level.alias("severity"),
        F.round("ks", 4).alias("ks_statistic"),
        F.round("p", 6).alias("p_value"),
        "mean_shift_pct",
        "std_shift_pct",
        F.round("mean_b", 2).alias("baseline_mean"),
        F.round("mean_c", 2).alias("current_mean"),
        F.round("median_b", 2).alias("baseline_median"),
        F.round("median_c", 2).alias("current_median"),
        F.when(
            drifted,
            F.concat(F.format_string("Distribution moved: KS %.3f, p %.4f, mean %+.1f%%", F.round("ks", 3), F.round("p", 4),
                                     F.round("mean_shift_pct", 1)), doubt),
        ).otherwise(F.concat(F.lit("Distribution is consistent with the baseline"), doubt)).alias("summary"),
        *([F.round("ks_error", 4).alias("ks_error")] if with_error else []),
    )


def detect_data_drift(
    current: DataFrame, baseline: DataFrame | None = None, database: str = "", table: str = "",
) -> DataFrame:
    """Compare a table with its baseline table; without one it is compared with itself."""
    if baseline is None:  # no value differs from itself
        stats = baseline_statistics(current, database, table)
        sizes = stats.select("column_name", F.lit(0.0).alias("ks"), F.col("sample_size").alias("size_b"), F.col("sample_size").alias("size_c"))
        return judge(stats, stats, sizes)
    old, new = side_by_side(current.sparkSession, [partial(_summaries, baseline), partial(_summaries, current)])
    return compare(_statistics(baseline, old, database, table), _values(baseline, old),
                   _statistics(current, new, database, table), _values(current, new))


def table_summary(columns: DataFrame, table: str) -> DataFrame:
    """One row per table: columns compared, columns drifted, status."""
    drifted = F.count_if("drift_detected")
    return columns.agg(
        F.lit(table).alias("table_name"),
        F.count("*").alias("total_numerical_columns"),
        drifted.alias("drifted_columns_count"),
        F.when(drifted > 0, "DRIFT_DETECTED").otherwise("STABLE").alias("table_drift_status"),
    )


def overall_summary(tables: DataFrame) -> DataFrame:
    """Totals over per-table summaries."""
    drifted = F.coalesce(F.sum("drifted_columns_count"), F.lit(0))
    return tables.agg(
        F.count("*").alias("tables_analyzed"),
        F.count_if(F.col("drifted_columns_count") > 0).alias("tables_with_drift"),
        drifted.alias("drifted_columns_count"),
        F.when(drifted > 0, "DRIFT_DETECTED").otherwise("STABLE").alias("overall_status"),
    )
