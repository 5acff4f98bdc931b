"""Literal inputs with known results."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakesight.functions.columns import sanitise
from lakesight.functions.grading import grade, severity
from lakesight.functions.masking import mask_secret, mask_sensitive_fields, mask_urls
from lakesight.operators import anomaly as A
from lakesight.operators import data_drift as D
from lakesight.operators import profile as P
from lakesight.operators import quality as Q
from lakesight.operators import rules as R
from lakesight.operators import trend as T
from lakesight.operators.isolation_forest import detect_isolation_forest
from lakesight.operators.kpi import Kpi, evaluate_kpi


def series(spark, *values):
    return spark.createDataFrame([("m", f"2026-{i + 1:02d}", float(v)) for i, v in enumerate(values)], "metric string, period string, value double")


def test_rising_series(spark):
    got = T.analyse_series(series(spark, 100, 108, 121, 117, 139)).first()
    assert got.trend_direction == "UPWARD"
    assert (got.total_growth_percentage, got.linear_slope, got.intercept, got.r_squared) == (39.0, 8.7, 99.6, 0.87)
    assert got.p_value == pytest.approx(0.0207, abs=1e-4)
    assert "increased 39.0%" in got.explanation
    assert T.moving_average(series(spark, 100, 108, 121, 117, 139)).count() == 5


def test_sudden_fall(spark):
    got = T.sudden_changes(series(spark, 500, 502, 498, 501, 180)).collect()
    assert [(r.to_period, r.z_score) for r in got] == [("2026-05", 1.73)]


def test_noise_is_stable(spark):
    got = T.analyse_series(series(spark, 100, 102, 99, 101.5, 100.5)).first()
    assert got.trend_direction == "STABLE"
    assert (got.r_squared, got.p_value) == (0.0044, 0.9157)


@pytest.mark.parametrize("values, direction", [((5,), "INSUFFICIENT_DATA"), ((5, 5, 5), "STABLE"), ((5, 9), "UPWARD")])
def test_short_and_flat_series(spark, values, direction):
    assert T.analyse_series(series(spark, *values)).first().trend_direction == direction


def spiky(spark):
    values = [10, 12, 11, 9, 10.5, 11.2, 10.8, 10.1, 9.8, 10.3, 100, np.inf, -np.inf, np.nan]
    return spark.createDataFrame(list(enumerate(map(float, values))), "id int, v double")


def test_zscore_and_iqr_ignore_infinities(spark):
    z = A.detect_zscore(spiky(spark), "v", ["id"]).collect()
    assert [(r.observed_value, r.score, r.severity) for r in z] == [(100.0, 3.01, "MEDIUM")]
    q = A.top_anomalies(A.detect_iqr(spiky(spark), "v", ["id"])).collect()
    assert (q[0].observed_value, q[0].score, q[0].severity) == (100.0, 85.17, "CRITICAL")
    assert (q[0].normal_range_min, q[0].normal_range_max) in [(8.48, 12.68), (8.47, 12.67), (8.48, 12.67), (8.47, 12.68)]


def test_too_few_or_equal_values_give_nothing(spark):
    few = spark.createDataFrame([(i, float(i)) for i in range(9)], "id int, v double")
    same = spark.createDataFrame([(i, 4.0) for i in range(30)], "id int, v double")
    for df in (few, same):
        assert A.detect_zscore(df, "v", ["id"]).count() == 0
        assert A.detect_iqr(df, "v", ["id"]).count() == 0


def test_rolling_spike_and_block_borders(spark, monkeypatch):
    values = [10, 10.2, 10.1, 10.3, 10.2, 10.4, 10.1, 10.5, 80, 10.2]
    rows = [(i, f"2026-01-{i + 1:02d}", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, d string, v double")
    for block in (100_000, 5, 6, 7):  # small blocks put the spike next to a border
        monkeypatch.setattr(A, "BLOCK_ROWS", block)
        got = A.detect_rolling(df, "v", "d", ["id"], window=4).collect()
        assert [(r.observed_value, r.score) for r in got] == [(80.0, 381.76)]


def test_rolling_equals_pandas_across_blocks_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"id": range(n), "g": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n)),
                        "t": pd.Timestamp("2026-01-01") + pd.to_timedelta(rng.permutation(n), "h"), "v": rng.normal(size=n) ** 3})
    df = spark.createDataFrame(pdf)
    got = {int(r.row_id) for r in A.detect_rolling(df, "v", "t", ["id"], per="g").collect()}
    want = set()
    for _, rows in pdf.sort_values("t").groupby("g"):
        before = rows["v"].shift(1).rolling(5)
        z = (rows["v"] - before.mean()) / before.std()
        want |= set(rows["id"][z.abs() >= 2.5])
    assert got == want and want


def test_isolation_forest_finds_the_planted_row(spark):
    rows = [(i, 10.0 + i % 3, 20.0 + i % 4) for i in range(11)] + [(11, 95.0, 195.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = A.top_anomalies(detect_isolation_forest(df, ["a", "b"], ["id"])).collect()
    assert got and got[0].observed_value == 95.0


def test_isolation_forest_share_and_repeatability(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    x[:20] += 12
    df = spark.createDataFrame(pd.DataFrame({"id": range(4000), "a": x[:, 0], "b": x[:, 1]}))
    first = {r.row_id for r in detect_isolation_forest(df, ["a", "b"], ["id"]).collect()}
    again = {r.row_id for r in detect_isolation_forest(df.repartition(5), ["a", "b"], ["id"]).collect()}
    assert {str(i) for i in range(20)} <= first
    assert abs(len(first) - 120) <= 2
    assert first == again


def test_scales(spark):
    got = spark.createDataFrame([(4.5,), (-3.5,), (2.8,), (2.1,)], "x double").select(severity(F.col("x"))).collect()
    assert [r[0] for r in got] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    got = spark.createDataFrame([(90.0,), (75.0,), (60.0,), (59.9,)], "x double").select(grade(F.col("x"))).collect()
    assert [r[0] for r in got] == ["EXCELLENT", "GOOD", "FAIR", "POOR"]


def test_sanitise_nested(spark):
    df = spark.createDataFrame(
        [(float("nan"), [1.0, float("inf")], ({"k": float("-inf"), "m": 2.0}, 3), datetime.datetime(2026, 9, 17, 12))],
        "a double, b array<double>, c struct<d:map<string,double>,e:int>, t timestamp_ntz")
    got = sanitise(df).first()
    assert got.a is None and got.b == [1.0, None] and got.t == "2026-09-17T12:00:00"
    assert got.c.d == {"k": None, "m": 2.0} and got.c.e == 3


def test_masks(spark):
    url = "postgresql://analyst:s3cret@localhost:5432/production_db"
    df = spark.createDataFrame([(url, "abcdef", "ab", None, ("tok", 42))], "conn_url string, plain string, short string, empty string, n struct<token:string,metric:int>")
    got = df.select(mask_urls(F.col("conn_url")), mask_secret(F.col("plain")), mask_secret(F.col("short")), mask_secret(F.col("empty"))).first()
    assert list(got) == ["postgresql://analyst:****@localhost:5432/production_db", "ab****f", "********", "********"]
    got = mask_sensitive_fields(df).first()
    assert got.conn_url.endswith(":****@localhost:5432/production_db") and got.n.token == "********" and got.n.metric == 42
    assert got.plain == "abcdef"


def test_histogram_of_a_constant_column(spark):
    df = spark.createDataFrame([(3.0,)] * 3, "x double")
    got = {r.bin: r["count"] for r in P.histogram(df).collect()}
    assert got == {i: (3 if i == 5 else 0) for i in range(10)}
    row = P.numeric_profile(df).first()
    assert (row.skewness, row.std_dev, row.outliers_count) == (0.0, 0.0, 0)


def test_histogram_equals_numpy(spark):
    x = np.round(np.random.default_rng(2).uniform(-3, 7, 3000), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = [r["count"] for r in P.histogram(df).orderBy("bin").collect()]
    assert got == list(np.histogram(x, bins=10)[0])


def test_profile_of_text_dates_and_missing_values(spark):
    df = spark.createDataFrame(
        [("2026-01-05", " ", 1.0), ("2026-02-09", "x" * 150, float("nan")), (None, "x" * 149 + "y", None)],
        "sold_date string, note string, v double")
    base = {r.column_name: r for r in P.base_profile(df).collect()}
    assert base["sold_date"].type_category == "DATETIME"
    assert (base["v"].null_count, base["v"].unique_count) == (2, 1)
    assert base["note"].unique_count == 3  # long texts differ beyond the shown part
    assert P.string_profile(df).first().empty_string_count == 1
    assert P.datetime_profile(df).first().timespan_days == 35
    assert P.profile_table(df, "t").filter("column_name is null and stat = 'total_rows'").first().value == "3"


def test_quality_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, price double")
    checks = Q.evaluate_table(df, "t", ["id"])
    assert checks.count() == 0
    assert Q.score_tables(checks, ["t"]).first().quality_score == 100.0


def test_quality_database_lists_a_failing_table(spark):
    good = spark.createDataFrame([(1, 2.0), (1, -3.0)], "id int, price double")
    bad = good.withColumn("boom", F.raise_error(F.lit("unreadable")).cast("double"))
    checks, scores, total = Q.evaluate_database({"good": good, "bad": bad}, {"good": ["id"]})
    by_name = {r.table_name: r for r in scores.collect()}
    assert by_name["bad"].quality_score == 100.0 and "unreadable" in by_name["bad"].error
    # duplicate key 20, half of the prices negative 10
    assert by_name["good"].quality_score == 70.0
    assert total.first().overall_quality_score == 70.0


def test_rule_that_fails_on_the_data_is_named(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    got = {r.rule_name: r for r in R.execute_rules(df, [
        R.Rule("bad cast", "t", "CAST(t AS INT) > 1"), R.Rule("fine", "t", "id > 1"), R.Rule("none", "t", "id > 9")]).collect()}
    assert [got[n].status for n in ("bad cast", "fine", "none")] == ["ERROR", "VIOLATION", "PASSED"]


def test_kpi_without_date_or_rows(spark):
    df = spark.createDataFrame([], "x double, d timestamp_ntz")
    got = evaluate_kpi(df, Kpi("k", "t", "SUM(x)", "d", 10.0)).first()
    assert (got.current_value, got.target_diff, got.growth_rate_mom_pct) == (0.0, -10.0, None)


def test_drift_of_shifted_and_equal_columns(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=500), rng.normal(size=400) + 1
    base = spark.createDataFrame(pd.DataFrame({"x": a, "y": a}))
    now = spark.createDataFrame(pd.DataFrame({"x": b, "y": a[:400]}))
    got = {r.column_name: r for r in D.detect_data_drift(now, base).collect()}
    grid = np.sort(np.concatenate([a, b]))
    ks = np.abs(np.searchsorted(np.sort(a), grid, "right") / 500 - np.searchsorted(np.sort(b), grid, "right") / 400).max()
    assert got["x"].ks_statistic == pytest.approx(ks, abs=1e-4) and got["x"].drift_detected
    assert got["y"].ks_statistic < 0.15


def test_children_add_up_to_their_parent(spark, table):
    from lakesight.operators.root_cause import drill_down

    tree = drill_down(table("lineitem"), "l_extendedprice", "l_shipdate", ["l_linenumber", "l_returnflag", "l_suppkey"], rest=True).collect()
    for parent in [r for r in tree if r.level < 3 and not str(r.key).startswith("other")]:
        children = [r for r in tree if r.parent_path == parent.path]
        assert children and abs(sum(r.value for r in children) - parent.value) < 0.1
        assert abs(sum(r.delta for r in children) - parent.delta) < 0.1
