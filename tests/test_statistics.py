import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakesight.functions import summary as S
from lakesight.functions.stats import ks_asymptotic_p_value, slope_p_value, unbiased_skewness
from lakesight.operators.ordering import ordered_copy, running_totals, with_position

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 1.0)


@pytest.mark.parametrize(
    "t, df, p",
    [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (1.991, 78, 0.05)],
)
def test_slope_p_matches_t_tables(spark, t, df, p):
    r2 = t * t / (t * t + df)
    got = spark.range(1).select(slope_p_value(F.lit(r2), F.lit(df + 2))).first()[0]
    assert got == pytest.approx(p, abs=2e-4)


def test_ks_p_value(spark):
    # lambda = 1.2 gives 0.11225
    got = spark.range(1).select(ks_asymptotic_p_value(F.lit(1.2 / np.sqrt(50.0)), F.lit(100), F.lit(100))).first()[0]
    assert got == pytest.approx(0.11225, abs=1e-5)


def test_skewness_is_bias_corrected(spark):
    xs = [1.0, 2.0, 2.5, 9.0, 30.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.agg(unbiased_skewness(F.skewness("x"), F.count("x"))).first()[0]
    assert got == pytest.approx(pd.Series(xs).skew())
    same = df.agg(unbiased_skewness(F.skewness(F.lit(3.0)), F.count("x"))).first()[0]
    assert same == 0.0


@pytest.mark.parametrize("shape", ["normal", "hot", "few", "heavy", "infinite", "huge", "constant"])
def test_narrowed_quantiles_equal_numpy(spark, monkeypatch, shape):
    monkeypatch.setattr(S, "RANKED_ROWS", 20)
    monkeypatch.setattr(S, "BINS", 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=5000)
    if shape == "hot":  # a third of all rows share one value
        x[: len(x) // 3] = np.sort(x)[1200]
    if shape == "few":
        x = rng.integers(0, 4, size=5000).astype(float)
    if shape == "heavy":
        x = np.exp(rng.normal(size=5000) * 8)
    if shape == "infinite":
        x[:100], x[100:150] = np.inf, -np.inf
    if shape == "huge":
        x[:2] = [-1.7e308, 1.7e308]
    if shape == "constant":
        x[:] = 3.5
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = S.exact_quantiles(df, F.col("x"), PROBS, single_pass_values=100)
    ordered = np.sort(x)
    for p in PROBS:
        at = (len(x) - 1) * p
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        want = S.between(low, high, at - np.floor(at))
        assert got[p] == pytest.approx(want, rel=1e-12, nan_ok=True), p


def test_any_range_takes_few_scans(spark, monkeypatch):
    monkeypatch.setattr(S, "RANKED_ROWS", 5)
    scans, narrow = [], S._narrow
    monkeypatch.setattr(S, "_narrow", lambda *a: scans.append(1) or narrow(*a))
    rng = np.random.default_rng(11)
    x = 10.0 ** rng.uniform(-300, 300, 20_000) * rng.choice([-1, 1], 20_000)
    x[:50], x[50:100], x[100:150] = np.inf, -np.inf, 5e-324
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = S.exact_quantiles(df, F.col("x"), PROBS, single_pass_values=100)
    ordered = np.sort(x)
    for p in PROBS:
        at = (len(x) - 1) * p
        assert got[p] == pytest.approx(S.between(ordered[int(np.floor(at))], ordered[int(np.ceil(at))], at - np.floor(at)), rel=1e-12), p
    assert len(scans) <= 8
    assert S.exact_quantiles(df, F.col("x"), (0.0, 1.0)) == {0.0: -np.inf, 1.0: np.inf}


def test_positions_and_running_totals(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "v": rng.permutation(3000), "n": rng.integers(1, 9, 3000)})
    df = spark.createDataFrame(pdf)
    no_merging = ("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set(*no_merging)
    copy = ordered_copy(df, [F.col("v")])
    assert copy.select("_part").distinct().count() > 1
    placed = with_position(copy).toPandas().sort_values("v")
    assert list(placed["_position"]) == list(range(3000))
    got = running_totals(df, "g", "v", ["n"]).toPandas().sort_values(["g", "v"])
    spark.conf.unset(no_merging[0])
    want = pdf.sort_values(["g", "v"])
    assert list(got["upto_n"]) == list(want.groupby("g")["n"].cumsum())
    assert (got.groupby("g")["total_n"].first() == want.groupby("g")["n"].sum()).all()
