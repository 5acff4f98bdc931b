"""Most frequent values by summaries and exact recounts, against counts of all values."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakesight.operators import profile

TRACKED = 256


@pytest.fixture(scope="module")
def skewed(spark):
    """Twelve values with 8,000 rows and fewer, among 30,000 values of one row, over many partitions; few, none and unique ones."""
    hot = spark.range(12).select(F.explode(F.sequence(F.lit(1), F.lit(8000) - F.col("id").cast("int") * 400)), "id").select((F.col("id") + 1_000_000).alias("v"))
    df = hot.unionByName(spark.range(30_000).withColumnRenamed("id", "v")).repartition(16)
    text = F.concat(F.lit("x" * 90), F.col("v").cast("string"))
    return df.select("v", text.alias("long_text"), (F.col("v") % 3).cast("string").alias("few"), F.lit(None).cast("string").alias("none"),
                     F.when(F.col("v") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("v").cast("double")).alias("real"),
                     F.monotonically_increasing_id().alias("unique")).checkpoint()


def expected(df, name, k):
    counts = Counter(r[0] for r in df.select(name).collect() if r[0] is not None and r[0] == r[0])
    shown = [(n, str(v)[:100]) for v, n in counts.items()]
    return [(v, n) for n, v in sorted(shown, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.mark.parametrize("k", [1, 6, 10, 12])
def test_same_as_counting_all(skewed, k):
    found = profile.top_values(skewed, k=k, tracked=TRACKED).collect()
    for name in ("v", "long_text", "few", "none", "unique"):
        rows = sorted((r for r in found if r["column_name"] == name), key=lambda r: r["rank"])
        assert [(r["value"], r["count"]) for r in rows] == expected(skewed, name, k), name
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_skewed_columns_are_settled_by_few_counts(skewed):
    counts, settled, valid = profile.frequent_values(skewed, skewed.columns, 10, TRACKED)
    assert {"v", "long_text", "few", "none"} <= set(settled) and "unique" not in settled
    assert valid["none"] == 0 and valid["v"] == skewed.count()
    assert max(r["count"] for r in counts.groupBy("column_name").count().collect()) <= TRACKED


def test_ties_at_the_last_place_are_never_settled_by_halves(spark):
    # 400 values of equal count: no summary of 256 hashes can tell which ten texts come first
    df = spark.range(40_000).select((F.col("id") % 400).alias("v"))
    assert profile.frequent_values(df, ["v"], 10, TRACKED)[1] == []
    found = sorted(profile.top_values(df, tracked=TRACKED).collect(), key=lambda r: r["rank"])
    assert [(r["value"], r["count"]) for r in found] == expected(df, "v", 10)


def test_empty_table(spark):
    assert profile.top_values(spark.range(0).select(F.col("id"), F.lit("a").alias("t"))).collect() == []
