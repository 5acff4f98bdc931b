"""Data-quality rules, scores and grades.

One scan gathers facts about every column (nulls, negatives, unreadable dates,
quartiles) and the aggregates that own rules declare, one more counts extreme
values, and a third counts the values of all keys. A fact table, one row per
column, is what the rules work on; a rule that declares no aggregates gets the
table as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesight.functions import columns as C
from lakesight.functions.grading import CRITICAL, HIGH, LOW, MEDIUM, SEVERITIES, grade
from lakesight.functions.summary import summarise
from lakesight.session import side_by_side, small_frame

# Name fragments, thresholds and penalty points of the built-in rules.
POSITIVE_NAMES = ("price", "amount", "cost", "quantity", "inventory", "stock", "revenue", "salary")
DATE_NAMES = ("date", "created_at", "updated_at", "timestamp", "birth_date")
MANY_NULLS, SOME_NULLS = 20.0, 2.0
KEY_NULL_POINTS, MANY_NULLS_POINTS, SOME_NULLS_POINTS = 15.0, 8.0, 3.0
DUPLICATE_POINTS = 20.0
MANY_NEGATIVES = 1.0
MANY_NEGATIVES_POINTS, FEW_NEGATIVES_POINTS = 10.0, 5.0
EXTREME_FENCE, EXTREME_MIN_ROWS = 3.0, 10
MANY_EXTREMES = 2.0
FEW_EXTREMES_POINTS, MANY_EXTREMES_POINTS = 4.0, 8.0
BAD_DATES_POINTS = 10.0
FULL_SCORE = 100.0
SAMPLES = 5

FACTS = (
    "ordinal int, column_name string, is_key boolean, total_rows bigint, null_count bigint, negative_count bigint, "
    "extreme_count bigint, bad_date_count bigint, duplicate_count bigint, low_fence double, high_fence double"
)
CHECKS = (
    "rule_id", "rule_name", "column_name", "passed", "severity", "penalty",
    "message", "violation_count", "violation_percentage",
)


def _has_any(name: str, fragments: Sequence[str]) -> bool:
    return any(part in name.lower() for part in fragments)


def _duplicate_counts(df: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Rows beyond the first of each value, for all keys of a kind in one scan; NULLs count as one value."""
    if not keys:
        return {}
    whole = [k for k in keys if C.is_integral(df.schema[k].dataType)]
    # whole numbers are grouped as they are; of others, equal values have equal texts, and a mark before them keeps NULL apart
    parts = {k: C.named(k).cast("bigint") if k in whole else F.coalesce(F.concat(F.lit("="), C.present(df, k).cast("string")), F.lit("")) for k in keys}
    found = {}
    for own in (whole, [k for k in keys if k not in whole]):
        if own:
            counted = C.stacked(df, [[F.lit(i), parts[k]] for i, k in enumerate(own)], ["slot", "value"]).groupBy("slot", "value").count()
            found |= {own[r.slot]: r.dupes for r in counted.groupBy("slot").agg(F.sum(F.col("count") - 1).alias("dupes")).collect()}
    return {k: found.get(k, 0) for k in keys}


def gather_facts(df: DataFrame, primary_keys: Sequence[str] = ()) -> DataFrame:
    """One row per column with everything the built-in rules need."""
    return facts_and_aggregates(df, primary_keys, {})[0]


def facts_and_aggregates(df: DataFrame, primary_keys: Sequence[str], own: dict[str, Column]) -> tuple[DataFrame, dict]:
    """The facts, and the values of further aggregates taken in the same scan."""
    keys = [k for k in primary_keys if k in df.columns]
    numeric = C.numeric_columns(df)
    extra: dict[str, Column] = {}
    for name in df.columns:
        value = C.present(df, name)
        extra[f"nulls {name}"] = F.count_if(value.isNull())
        if name in numeric and _has_any(name, POSITIVE_NAMES):
            extra[f"negatives {name}"] = F.count_if(value < 0)
        if _has_any(name, DATE_NAMES) and isinstance(df.schema[name].dataType, T.StringType):
            extra[f"bad dates {name}"] = F.count_if(value.isNotNull() & C.wall_time(df, name).isNull())
    values = {n: C.present(df, n) for n in numeric}
    summaries, facts = summarise(df, values, (0.25, 0.75), extra | {f"own {n}": c for n, c in own.items()})

    fences = {}
    for name, s in summaries.items():
        if facts["rows"] >= EXTREME_MIN_ROWS and s.count >= EXTREME_MIN_ROWS and s.iqr > 0:
            fences[name] = (
                s.quantile(0.25) - EXTREME_FENCE * s.iqr,
                s.quantile(0.75) + EXTREME_FENCE * s.iqr,
            )
    extremes = {}
    if fences:
        outside = [
            F.count_if((values[n].cast("double") < low) | (values[n].cast("double") > high))
            for n, (low, high) in fences.items()
        ]
        extremes = dict(zip(fences, df.agg(F.array(*outside).alias("o")).first().o))
    duplicates = _duplicate_counts(df, keys)
    rows = [
        (
            i, name, name in keys, facts["rows"], facts[f"nulls {name}"], facts.get(f"negatives {name}", 0),
            extremes.get(name, 0), facts.get(f"bad dates {name}", 0), duplicates.get(name),
            *fences.get(name, (None, None)),
        )
        for i, name in enumerate(df.columns)
    ]
    return small_frame(df.sparkSession, rows, FACTS), {n: facts[f"own {n}"] for n in own}


class QualityRule(Protocol):
    """A rule yields check rows (see CHECKS) from the table and its facts."""

    rule_id: str
    rule_name: str

    def evaluate(self, df: DataFrame, table_name: str, facts: DataFrame) -> DataFrame: ...


class AggregateRule(Protocol):
    """A rule on named aggregates of the table, which are taken in the scan of the facts, so that it adds no scan."""

    rule_id: str
    rule_name: str

    def aggregates(self, df: DataFrame, table_name: str) -> dict[str, Column]: ...

    def verdict(self, facts: DataFrame, values: dict) -> DataFrame: ...


def checks(
    rule: QualityRule, found: DataFrame, count: Column, severity: Column, penalty: Column, message: Column,
    passed: Column | None = None,
) -> DataFrame:
    """Shape rows of ``found`` (facts) into check rows."""
    passed = F.lit(False) if passed is None else passed
    shown = F.when(passed, F.lit(0)).otherwise(count).cast("bigint")
    return found.select(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.rule_name).alias("rule_name"),
        F.col("column_name"),
        passed.alias("passed"),
        F.when(passed, LOW).otherwise(severity).alias("severity"),
        F.when(passed, 0.0).otherwise(F.round(penalty, 2)).alias("penalty"),
        message.alias("message"),
        shown.alias("violation_count"),
        F.round(C.percent(shown, F.col("total_rows")), 2).alias("violation_percentage"),
    )


def _share(count: str) -> Column:
    return C.percent(F.col(count), F.col("total_rows"))


class NullRule:
    rule_id, rule_name = "QR_NULL_CHECK", "Null Value Check"

    def evaluate(self, df, table_name, facts):
        key, count, share = F.col("is_key"), F.col("null_count"), _share("null_count")
        clean_key = key & (count == 0)
        found = facts.filter((F.col("total_rows") > 0) & (clean_key | (key & (count > 0)) | (share > SOME_NULLS)))
        many = share > MANY_NULLS
        return checks(
            self, found, count,
            F.when(key, CRITICAL).when(many, HIGH).otherwise(MEDIUM),
            F.when(key, KEY_NULL_POINTS).when(many, MANY_NULLS_POINTS).otherwise(SOME_NULLS_POINTS),
            F.when(clean_key, "Key has no NULL values")
            .when(key, F.format_string("Key has %d NULL values", count))
            .otherwise(F.format_string("%.1f%% NULL values (%d rows)", F.round(share, 1), count)),
            clean_key,
        )


class UniquenessRule:
    rule_id, rule_name = "QR_UNIQUENESS", "Uniqueness & Duplicate Check"

    def evaluate(self, df, table_name, facts):
        count = F.col("duplicate_count")
        unique = count == 0
        return checks(
            self, facts.filter("is_key and total_rows > 0"), count, F.lit(CRITICAL), F.lit(DUPLICATE_POINTS),
            F.when(unique, "Key has no duplicates").otherwise(
                F.format_string("Key has %d duplicate values (%.1f%%)", count, F.round(_share("duplicate_count"), 1))),
            unique,
        )


class NonNegativeRule:
    rule_id, rule_name = "QR_NON_NEGATIVE", "Positive Metric Range Check"

    def evaluate(self, df, table_name, facts):
        count, share = F.col("negative_count"), _share("negative_count")
        many = share > MANY_NEGATIVES
        return checks(
            self, facts.filter(count > 0), count, F.when(many, HIGH).otherwise(MEDIUM),
            F.when(many, MANY_NEGATIVES_POINTS).otherwise(FEW_NEGATIVES_POINTS),
            F.format_string("%.1f%% negative values (%d rows)", F.round(share, 1), count),
        )


class ExtremeOutlierRule:
    rule_id, rule_name = "QR_EXTREME_OUTLIERS", "Extreme Outlier Check"

    def evaluate(self, df, table_name, facts):
        count = F.col("extreme_count")
        few = _share("extreme_count") < MANY_EXTREMES
        return checks(
            self, facts.filter(count > 0), count, F.when(few, MEDIUM).otherwise(HIGH),
            F.when(few, FEW_EXTREMES_POINTS).otherwise(MANY_EXTREMES_POINTS),
            F.format_string("%d values beyond 3 times the IQR", count),
        )


class DateValidityRule:
    rule_id, rule_name = "QR_DATE_VALIDITY", "Date Format and Range Validity"

    def evaluate(self, df, table_name, facts):
        count = F.col("bad_date_count")
        return checks(
            self, facts.filter(count > 0), count, F.lit(HIGH), F.lit(BAD_DATES_POINTS),
            F.format_string("%d unreadable dates (%.1f%%)", count, F.round(_share("bad_date_count"), 1)),
        )


BUILT_IN_RULES: tuple[QualityRule, ...] = (
    NullRule(), UniquenessRule(), NonNegativeRule(), ExtremeOutlierRule(), DateValidityRule(),
)


def violation_samples(df: DataFrame, facts: DataFrame, order: Sequence[str] = (), k: int = SAMPLES) -> DataFrame:
    """Up to k offending values per (rule_id, column_name) for negatives and extremes.

    First by the given row order, else by value. The per-column ranking is cut
    to k rows in every partition before it is shuffled.
    """
    pairs = []
    for f in facts.filter("negative_count > 0 or extreme_count > 0").collect():
        v = C.present(df, f.column_name).cast("double")
        hit = lambda rule, condition: F.when(
            condition, F.struct(F.lit(rule).alias("rule_id"), F.lit(f.column_name).alias("column_name"), v.alias("v")))
        if f.negative_count:
            pairs.append(hit(NonNegativeRule.rule_id, v < 0))
        if f.extreme_count:
            pairs.append(hit(ExtremeOutlierRule.rule_id, (v < f.low_fence) | (v > f.high_fence)))
    if not pairs:
        return small_frame(df.sparkSession, [], "rule_id string, column_name string, sample_violations array<double>")
    place = F.struct(*[C.named(o) for o in order]) if order else F.lit(0)
    hits = df.select(place.alias("place"), F.inline(F.array(*pairs))).filter("rule_id is not null")
    first = Window.partitionBy("rule_id", "column_name").orderBy("place", "v")
    ranked = hits.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    sampled = F.array_sort(F.collect_list(F.struct("r", F.round("v", 2).alias("v"))))
    return ranked.groupBy("rule_id", "column_name").agg(F.transform(sampled, lambda s: s["v"]).alias("sample_violations"))


def evaluate_table(
    df: DataFrame,
    table_name: str,
    primary_keys: Sequence[str] = (),
    rules: Sequence[QualityRule | AggregateRule] = BUILT_IN_RULES,
    sample_order: Sequence[str] = (),
    with_samples: bool = True,
) -> DataFrame:
    """Check rows of all rules, with sample violations unless they are not wanted. An empty table gives none."""
    declared = {i: rule.aggregates(df, table_name) for i, rule in enumerate(rules) if hasattr(rule, "aggregates")}
    facts, values = facts_and_aggregates(df, primary_keys, {f"{i} {n}": c for i, own in declared.items() for n, c in own.items()})
    result = None
    for i, rule in enumerate(rules):
        if i in declared:
            found = rule.verdict(facts, {n: values[f"{i} {n}"] for n in declared[i]}).select(*CHECKS)
        else:
            found = rule.evaluate(df, table_name, facts).select(*CHECKS)
        result = found if result is None else result.unionByName(found)
    if not with_samples:
        return result.select(F.lit(table_name).alias("table_name"), *CHECKS)
    # at most SAMPLES values per rule and column: few enough for a literal lookup
    found = {(r.rule_id, r.column_name): r.sample_violations for r in violation_samples(df, facts, sample_order).collect()}
    samples = F.lit(None).cast("array<double>")
    for (rule_id, column), values in found.items():
        here = (F.col("rule_id") == rule_id) & (F.col("column_name") == column)
        samples = F.when(here, F.array(*map(F.lit, values))).otherwise(samples)
    return result.select(F.lit(table_name).alias("table_name"), *CHECKS, samples.alias("sample_violations"))


def score_tables(all_checks: DataFrame, table_names: Sequence[str]) -> DataFrame:
    """Score, grade and counts per table; a table without checks scores 100."""
    columns = "table_name string, passed boolean, severity string, penalty double"
    # one row without a check per table keeps tables that no rule had anything to say on
    tables = small_frame(all_checks.sparkSession, [(t, None, None, 0.0) for t in table_names], columns)
    failed = ~F.col("passed")
    scored = (
        all_checks.select("table_name", "passed", "severity", "penalty").unionByName(tables)
        .groupBy("table_name")
        .agg(
            F.coalesce(F.sum(F.when(failed, F.col("penalty"))), F.lit(0.0)).alias("points"),
            F.count("passed").alias("total_checks"),
            F.count_if(failed).alias("violations_count"),
            F.count_if("passed").alias("passed_count"),
            *[F.count_if(failed & (F.col("severity") == s)).alias(f"{s.lower()}_count") for s in SEVERITIES],
        )
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(FULL_SCORE), FULL_SCORE - F.col("points")))
    return scored.select(
        "table_name",
        F.round(score, 1).alias("quality_score"),
        grade(score).alias("quality_grade"),
        F.round("points", 1).alias("penalty_points"),
        *[c for c in scored.columns if c.endswith("_count") or c == "total_checks"],
    )


def score_database(scores: DataFrame) -> DataFrame:
    """Plain mean of the table scores; tables that could not be read (``error`` set) do not count."""
    readable = F.col("error").isNull() if "error" in scores.columns else F.lit(True)
    mean = F.round(F.coalesce(F.avg(F.when(readable, F.col("quality_score"))), F.lit(FULL_SCORE)), 1)
    return scores.agg(
        mean.alias("overall_quality_score"),
        F.count("*").alias("tables_analyzed"),
        F.coalesce(F.sum("violations_count"), F.lit(0)).alias("total_violations"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical_violations"),
        F.coalesce(F.sum("high_count"), F.lit(0)).alias("high_violations"),
    ).withColumn("overall_grade", grade(F.col("overall_quality_score")))


def evaluate_database(
    tables: dict[str, DataFrame],
    primary_keys: dict[str, Sequence[str]] | None = None,
    rules: Sequence[QualityRule] = BUILT_IN_RULES,
    with_samples: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checks of all tables, score per table, database score).

    A table that cannot be read is listed with score 100 and its error.
    """
    keys = primary_keys or {}

    def one(name: str, df: DataFrame) -> DataFrame | str:
        try:
            return evaluate_table(df, name, keys.get(name, ()), rules, with_samples=with_samples)
        except Exception as error:  # noqa: BLE001 - one bad table must not hide the others
            return str(error)

    spark = next(iter(tables.values())).sparkSession
    results = dict(zip(tables, side_by_side(spark, [partial(one, name, df) for name, df in tables.items()])))
    errors = [(name, r) for name, r in results.items() if isinstance(r, str)]
    found = None
    for r in results.values():
        if not isinstance(r, str):
            found = r if found is None else found.unionByName(r)
    if found is None:
        raise ValueError(f"no table could be read: {errors}")
    failed = {name for name, _ in errors}
    scores = score_tables(found, [t for t in tables if t not in failed]).withColumn("error", F.lit(None).cast("string"))
    if errors:
        bad = small_frame(found.sparkSession, errors, "table_name string, error string")
        bad = bad.withColumn("quality_score", F.lit(FULL_SCORE))
        scores = scores.unionByName(bad, allowMissingColumns=True)
    return found, scores, score_database(scores)
