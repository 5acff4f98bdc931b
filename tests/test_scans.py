"""Scans that operators make of their table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesight.functions import summary
from lakesight.operators import quality


@pytest.fixture
def counted(spark):
    """A table whose value column counts how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def value(i):
        seen.add(1)
        return float(i % 97)

    df = spark.range(2000).select("id", F.udf(value, "double").asNondeterministic()("id").alias("price"), (F.col("id") % 7).alias("k"))
    return df, seen


class Large:
    rule_id, rule_name = "LARGE", "Large prices"

    def aggregates(self, df, table_name):
        return {"n": F.count_if(F.col("price") > 90), "top": F.max("price")}

    def verdict(self, facts, values):
        assert values["top"] == 96.0
        return quality.checks(self, facts.filter("column_name = 'price'"), F.lit(values["n"]), F.lit("LOW"), F.lit(1.0), F.lit("large"))


def test_own_rules_add_no_scan(counted):
    df, seen = counted
    # every scan of this frame computes the values: one for facts, one for extremes, one for all keys
    found = quality.evaluate_table(df, "t", ["id", "k", "price"], [*quality.BUILT_IN_RULES, Large(), Large()], with_samples=False)
    assert [r.violation_count for r in found.filter("rule_id = 'LARGE'").collect()] == [sum(i % 97 > 90 for i in range(2000))] * 2
    assert {r.column_name: r.violation_count for r in found.filter("rule_id = 'QR_UNIQUENESS'").collect()} == {"id": 0, "k": 1993, "price": 1903}
    assert seen.value <= 3 * 2000


@pytest.mark.parametrize("kind", ["normal", "few", "tail", "infinite", "with nulls"])
def test_quantiles_of_large_tables_are_exact_in_few_scans(spark, kind, monkeypatch):
    r = np.random.default_rng(4)
    values = {"normal": r.normal(size=30_000), "few": r.integers(0, 4, 30_000).astype(float), "tail": np.exp(r.normal(size=30_000) * 50),
              "infinite": np.where(r.random(30_000) < 0.3, np.inf, r.random(30_000)), "with nulls": r.random(30_000)}[kind]
    rows = [(float(v),) for v in values] + ([(None,)] * 500 if kind == "with nulls" else [])
    df = spark.createDataFrame(rows, "v double")
    narrowed = []
    monkeypatch.setattr(summary, "_narrow", lambda *a, f=summary._narrow: narrowed.append(1) or f(*a))
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = summary.exact_quantiles(df, F.col("v"), probabilities, single_pass_values=10)
    want = summary.exact_quantiles(df, F.col("v"), probabilities)
    assert got == want and not narrowed


def test_a_wrong_range_of_the_sketch_is_found_out(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"))
    monkeypatch.setattr(summary, "REACH", -0.01)  # ranges that do not hold their quantiles
    got = summary.exact_quantiles(df, F.col("v"), (0.25, 0.5), single_pass_values=10)
    assert got == {0.25: 1249.75, 0.5: 2499.5}
