"""Registered queries against their SQL on the smallest tables, and the shape of their plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
# jobs and reports repeat other queries; tools/compare.py runs them too
SHORT = [n for n in entry.queries() if n in ORACLE and not n.startswith(("job_", "report_"))]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", SHORT)
def test_same_as_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = db.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_values_are_cut_before_the_shuffle(spark):
    plan = entry.queries()["profile_top_values_orders"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["anomaly_zscore_events", "anomaly_iqr_events"])
def test_outlier_ranges_reach_the_scan(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "Or(Less" in pushed.split("PushedFilters")[1]
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in pushed


def test_monthly_sum_reads_two_columns(spark):
    plan = entry.queries()["kpi_monthly_sum"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 12
