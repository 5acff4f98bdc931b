"""Column and table profiles.

Frequencies and distinct counts of all columns come from one grouped job,
numeric and text statistics from one aggregate per kind, histograms and
outlier counts from a second scan with the first scan's scalars as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesight.functions import columns as C
from lakesight.functions.stats import unbiased_skewness
from lakesight.functions.summary import Summary, summarise
from lakesight.session import materialise, small_frame

# Shown text length, list sizes, quantiles, fence width and number of bins.
SHOWN_CHARACTERS = 100
TOP_VALUES = 10
QUANTILES = (0.25, 0.5, 0.75, 0.95)
FENCE = 1.5
BINS = 10
MONTHS_SHOWN = 12

#: value hashes kept per column and task while the most frequent values are sought
TRACKED = 4096
# A Misra-Gries summary of t counters (kept in a table of t / 0.75 slots) misses at most 3.5 * 0.75 / t of its rows per value.
_SUMMARY_ERROR = 3.5 * 0.75
# Longer texts are grouped by digest, so that a shuffle never carries whole documents.
_DIGEST_ABOVE = 64
_HISTOGRAM = "column_name string, bin int, bin_start double, bin_end double, count bigint"


def _of_category(categories: dict[str, str], wanted: str) -> list[str]:
    return [name for name, category in categories.items() if category == wanted]


def _long_form(df: DataFrame, values: dict[str, Column], value_name: str) -> DataFrame:
    """One row per (column, value); missing values are left out."""
    pairs = [[F.lit(n), v] for n, v in values.items()]
    return C.stacked(df, pairs, ["column_name", value_name]).filter(F.col(value_name).isNotNull())


def value_frequencies(df: DataFrame, names: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Count of every distinct value of every column: (column_name, value, count).

    Numbers and times are grouped as such and only their distinct values are
    turned into text. ``value`` is that text cut for display; grouping is on the
    whole value. With ``only``, a small table (column_name, hash), just the
    values with these hashes are counted; others leave before the shuffle.
    """
    names = names or df.columns
    kinds: dict[str, list[str]] = {"whole": [], "real": [], "moment": [], "text": []}
    for name in names:
        kinds[_kind(df, name)].append(name)
    parts = []
    # each kind reads only its own columns
    for kind, members in kinds.items():
        if not members:
            continue
        pairs = [[F.lit(names.index(n)), _grouped_form(df, n, kind)] for n in members]
        long = C.stacked(df, pairs, ["slot", "v"]).filter(F.col("v").isNotNull())
        if only is not None:
            # at most TRACKED hashes a column
            wanted = F.broadcast(only.withColumn("s", F.array_position(F.array(*map(F.lit, names)), F.col("column_name")) - 1))
            long = long.join(wanted, (F.col("slot") == F.col("s")) & (F.xxhash64("v") == F.col("hash")), "left_semi")
        if kind == "text":
            short = F.length("v") <= _DIGEST_ABOVE
            long = long.select("slot", F.when(short, F.col("v")).otherwise(F.sha2("v", 256)).alias("v"),
                               F.when(~short, F.left("v", F.lit(SHOWN_CHARACTERS))).alias("long_text"))
            # a 64-character text never meets the digest of another one: those are kept apart by long_text
            counts = long.groupBy("slot", "v", F.col("long_text").isNull().alias("short")).agg(
                F.coalesce(F.first("long_text"), F.col("v")).alias("value"), F.count("*").alias("count"))
        else:
            counts = long.groupBy("slot", "v").agg(F.count("*").alias("count"))
            text = C.number_text(F.col("v")) if kind == "real" else F.col("v").cast("string")
            counts = counts.withColumn("value", text)
        parts.append(counts.select("slot", "value", "count"))
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("slot") + 1)
    return joined.select(name.alias("column_name"), "value", "count")


def _kind(df: DataFrame, name: str) -> str:
    dtype = df.schema[name].dataType
    return ("whole" if isinstance(dtype, T.IntegralType) else "real" if isinstance(dtype, T.DoubleType)
            else "moment" if isinstance(dtype, T.TimestampNTZType) else "text")


def _grouped_form(df: DataFrame, name: str, kind: str) -> Column:
    if kind == "whole":
        return C.named(name).cast("long")
    return C.as_text(df, name) if kind == "text" else C.present(df, name)


def frequent_values(df: DataFrame, names: list[str], k: int, tracked: int = TRACKED) -> tuple[DataFrame, list[str], dict[str, int]]:
    """Exact counts of the values that may be among a column's k most frequent, without a shuffle of all values.

    Every task keeps a Misra-Gries summary of at most ``tracked`` value hashes per
    column; the summaries are merged, and the values they name are counted
    exactly in a second scan. A value they do not name has no more rows than
    twice the summary's error, and no more than the named values leave over. A
    column is settled if its k-th count is above the smaller of the two: then no
    other value can reach the list, not even as a tie.

    Gives (column_name, value, count) of the settled columns, their names, and
    the number of valid values of every column.
    """
    values = {n: _grouped_form(df, n, _kind(df, n)) for n in names}
    hashes = {n: F.when(v.isNotNull(), F.xxhash64(v)) for n, v in values.items()}
    found = df.agg(*[c for n in names for c in (
        F.count(C.present(df, n)), F.call_function("approx_top_k", hashes[n], F.lit(tracked), F.lit(tracked)))]).first()
    valid = {n: found[2 * i] for i, n in enumerate(names)}
    lists = {n: [(e["item"], e["count"]) for e in found[2 * i + 1] or [] if e["item"] is not None] for i, n in enumerate(names)}
    unnamed = {n: 2 * _SUMMARY_ERROR / tracked * valid[n] for n in names}

    def hopeful(n: str) -> bool:
        counts = sorted((c for _, c in lists[n]), reverse=True)
        return sum(counts) == valid[n] or (len(counts) >= k and counts[k - 1] > unnamed[n])

    maybe = [n for n in names if hopeful(n)]
    rows = [(n, h) for n in maybe for h, _ in lists[n]]
    only = small_frame(df.sparkSession, rows, "column_name string, hash bigint")
    counted = materialise(value_frequencies(df, maybe, only)) if maybe else small_frame(
        df.sparkSession, [], "column_name string, value string, count bigint")
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"))))
    # a row per column
    totals = {r["column_name"]: r for r in ranked.groupBy("column_name").agg(
        F.sum("count").alias("total"), F.max(F.when(F.col("rank") == k, F.col("count"))).alias("last")).collect()}
    settled = []
    for n in maybe:
        total, last = (totals[n]["total"], totals[n]["last"]) if n in totals else (0, None)
        left = valid[n] - total
        if left == 0 or (last or 0) > min(left, unnamed[n]):
            settled.append(n)
    return counted.filter(F.col("column_name").isin(settled)), settled, valid


def top_values(df: DataFrame, names: list[str] | None = None, k: int = TOP_VALUES, tracked: int = TRACKED) -> DataFrame:
    """The k most frequent values per column with their share of the valid values.

    Columns that ``frequent_values`` does not settle have all their values counted.
    """
    names = names or df.columns
    counts, settled, valid = frequent_values(df, names, k, tracked)
    others = [n for n in names if n not in settled]
    if others:
        rest = value_frequencies(df, others)
        counts = counts.unionByName(rest) if settled else rest
    best = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    # row_number <= k is cut down per partition before the shuffle, so no column meets in one task
    ranked = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    of = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, valid[n])]), F.col("column_name"))
    return ranked.select(
        "column_name",
        "rank",
        "value",
        "count",
        F.round(C.percent(F.col("count"), of), 2).alias("percentage"),
    )


def base_profile(df: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """Totals, nulls, distinct and duplicate counts per column, for columns of any type."""
    categories = categories or C.type_categories(df)
    distinct = value_frequencies(df).groupBy("column_name").agg(
        F.count("*").alias("unique_count"), F.sum("count").alias("valid_count")
    )
    fields = df.schema.fields
    described = df.agg(F.count("*").alias("total_count")).select(
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(i).alias("ordinal"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("inferred_type"),
                    F.lit(categories[f.name]).alias("type_category"),
                    F.col("total_count"),
                )
                for i, f in enumerate(fields)
            ])
        )
    )
    valid = F.coalesce("valid_count", F.lit(0))
    unique = F.coalesce("unique_count", F.lit(0))
    nulls = F.col("total_count") - valid
    # both sides hold one row per column
    return described.join(distinct, "column_name", "left").select(
        "ordinal",
        "column_name",
        "inferred_type",
        "type_category",
        "total_count",
        valid.alias("valid_count"),
        nulls.alias("null_count"),
        F.round(C.percent(nulls, F.col("total_count")), 2).alias("null_percentage"),
        unique.alias("unique_count"),
        (valid - unique).alias("duplicate_count"),
    )


def numeric_summaries(df: DataFrame, names: list[str]) -> dict[str, Summary]:
    return summarise(df, {n: C.finite(df, n) for n in names}, QUANTILES)[0]


def _fences(summary: Summary, width: float) -> tuple[float, float]:
    return (
        summary.quantile(0.25) - width * summary.iqr,
        summary.quantile(0.75) + width * summary.iqr,
    )


def numeric_profile(
    df: DataFrame, names: list[str] | None = None, summaries: dict[str, Summary] | None = None
) -> DataFrame:
    """Min, max, mean, median, std, skewness, quantiles, IQR and outliers per numeric column."""
    names = C.numeric_columns(df) if names is None else names
    summaries = summaries or numeric_summaries(df, names)
    outside = []
    for n in names:
        if summaries[n].count:
            low, high = _fences(summaries[n], FENCE)
            v = C.finite(df, n)
            outside.append(F.count_if((v < low) | (v > high)))
        else:
            outside.append(F.lit(0).cast("long"))
    # the scalars of the first scan become literals of the second one's projection
    rows = []
    for i, n in enumerate(names):
        s = summaries[n]
        lit = lambda x: F.round(F.lit(x).cast("double"), 4)
        count = F.lit(s.count).cast("long")
        skew = unbiased_skewness(F.lit(s.skewness).cast("double"), count)
        rows.append(
            F.struct(
                F.lit(n).alias("column_name"),
                count.alias("finite_count"),
                lit(s.minimum).alias("min"),
                lit(s.maximum).alias("max"),
                lit(s.mean).alias("mean"),
                lit(s.quantile(0.5)).alias("median"),
                lit((s.std or 0.0) if s.count else None).alias("std_dev"),
                F.when(count > 0, F.round(skew, 4)).alias("skewness"),
                lit(s.quantile(0.25)).alias("p25"),
                lit(s.quantile(0.5)).alias("p50"),
                lit(s.quantile(0.75)).alias("p75"),
                lit(s.quantile(0.95)).alias("p95"),
                lit(s.iqr).alias("iqr"),
                F.col("o")[i].alias("outliers_count"),
                F.when(count > 0, F.round(C.percent(F.col("o")[i], count), 2)).alias("outliers_percentage"),
            )
        )
    return df.agg(F.array(*outside).alias("o")).select(F.inline(F.array(*rows)))


def histogram(
    df: DataFrame, names: list[str] | None = None, summaries: dict[str, Summary] | None = None, bins: int = BINS
) -> DataFrame:
    """Equal-width bins between the column's minimum and maximum; the last bin is closed.

    A constant column is spread over half a unit on either side. Empty bins are kept.
    """
    names = C.numeric_columns(df) if names is None else names
    if summaries is None:
        summaries = summarise(df, {n: C.finite(df, n) for n in names})[0]
    kept, lows, steps, edges = [], [], [], []
    for n in names:
        s = summaries[n]
        if not s.count:
            continue
        low, high = s.minimum, s.maximum
        if low == high:
            low, high = low - 0.5, high + 0.5
        step = (high - low) / bins
        kept.append(n)
        lows.append(low)
        steps.append(step)
        edges += [
            F.struct(
                F.lit(n).alias("column_name"),
                F.lit(i).alias("bin"),
                F.round(F.lit(low + i * step), 2).alias("bin_start"),
                F.round(F.lit(high if i == bins - 1 else low + (i + 1) * step), 2).alias("bin_end"),
            )
            for i in range(bins)
        ]
    if not kept:
        return small_frame(df.sparkSession, [], _HISTOGRAM)
    # edges are looked up after stacking the columns, which keeps the generated code small
    of_column = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("slot") + 1)
    edge = lambda i: of_column(lows) + i * of_column(steps)
    values = C.stacked(df, [[F.lit(i), C.finite(df, n)] for i, n in enumerate(kept)], ["slot", "v"]).filter("v is not null")
    guess = F.least(F.floor((F.col("v") - of_column(lows)) / of_column(steps)), F.lit(bins - 1))
    last = bins - 1
    # rounding may put a value one bin off its edges
    corrected = (
        F.when(F.col("v") < edge(F.col("guess")), F.col("guess") - 1)
        .when((F.col("guess") < last) & (F.col("v") >= edge(F.col("guess") + 1)), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counts = (
        values.withColumn("guess", guess)
        .groupBy(F.element_at(F.array(*map(F.lit, kept)), F.col("slot") + 1).alias("column_name"), corrected.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.range(1).select(F.inline(F.array(*edges)))
    return grid.join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).alias("count")
    )


def _times(df: DataFrame, names: list[str] | None) -> dict[str, Column]:
    if names is None:
        names = _of_category(C.type_categories(df), C.DATETIME)
    return {n: C.wall_time(df, n) for n in names}


def datetime_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Earliest and latest time and whole days between them."""
    days = F.floor((C.epoch_micros(F.max("ts")) - C.epoch_micros(F.min("ts"))) / 86_400_000_000)
    return (
        _long_form(df, _times(df, names), "ts")
        .groupBy("column_name")
        .agg(
            C.iso_text(F.min("ts")).alias("min_date"),
            C.iso_text(F.max("ts")).alias("max_date"),
            days.alias("timespan_days"),
        )
    )


def monthly_distribution(df: DataFrame, names: list[str] | None = None, months: int = MONTHS_SHOWN) -> DataFrame:
    """Row counts of the last months present."""
    counts = (
        _long_form(df, _times(df, names), "ts")
        .groupBy("column_name", F.date_format("ts", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("count"))
    )
    latest = Window.partitionBy("column_name").orderBy(F.desc("month"))
    return counts.withColumn("r", F.row_number().over(latest)).filter(F.col("r") <= months).drop("r")


def weekday_distribution(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return (
        _long_form(df, _times(df, names), "ts")
        .groupBy("column_name", F.date_format("ts", "EEEE").alias("weekday"))
        .agg(F.count("*").alias("count"))
    )


def string_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Shortest, longest and mean length, and how many are blank once trimmed."""
    if names is None:
        names = _of_category(C.type_categories(df), C.STRING)
    rows = []
    for n in names:
        text = C.as_text(df, n)
        blank = F.regexp_replace(text, r"^\s+", "") == ""
        rows.append(
            F.struct(
                F.lit(n).alias("column_name"),
                F.coalesce(F.min(F.length(text)), F.lit(0)).alias("min_length"),
                F.coalesce(F.max(F.length(text)), F.lit(0)).alias("max_length"),
                F.round(F.coalesce(F.avg(F.length(text)), F.lit(0.0)), 2).alias("average_length"),
                F.count_if(blank).alias("empty_string_count"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def _as_stats(profile: DataFrame, detail: list[str] | None = None) -> DataFrame:
    """Melt a per-column profile to (column_name, stat, detail, value)."""
    keys = ["column_name", *(detail or [])]
    values = [c for c in profile.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("string").alias("value")) for c in values])
    label = F.concat_ws(" ", *detail) if detail else F.lit("")
    return profile.select("column_name", label.alias("detail"), F.inline(pairs)).select(
        "column_name", "stat", "detail", "value"
    )


def profile_table(df: DataFrame, table_name: str, sampled_rows: int | None = None) -> DataFrame:
    """Every profile of every column as rows (table_name, column_name, stat, detail, value).

    ``sampled_rows`` only labels the result when the caller passes a sample.
    """
    categories = C.type_categories(df)
    numeric = _of_category(categories, C.NUMERIC)
    times = _of_category(categories, C.DATETIME)
    texts = _of_category(categories, C.STRING)
    parts = [
        _as_stats(base_profile(df, categories).drop("ordinal")),
        _as_stats(top_values(df), ["rank"]),
    ]
    if numeric:
        summaries = numeric_summaries(df, numeric)
        parts.append(_as_stats(numeric_profile(df, numeric, summaries)))
        parts.append(_as_stats(histogram(df, numeric, summaries), ["bin"]))
    if times:
        parts.append(_as_stats(datetime_profile(df, times)))
        parts.append(_as_stats(monthly_distribution(df, times), ["month"]))
        parts.append(_as_stats(weekday_distribution(df, times), ["weekday"]))
    if texts:
        parts.append(_as_stats(string_profile(df, texts)))
    table = df.agg(F.count("*").alias("total_rows")).select(
        F.lit(None).cast("string").alias("column_name"),
        "total_rows",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(sampled_rows is not None).alias("is_sampled"),
    )
    result = _as_stats(table)
    for part in parts:
        result = result.unionByName(part)
    return result.select(F.lit(table_name).alias("table_name"), "*")
