import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import reports
from checks.catalogs import KEYS
from lakesight import session
from lakesight.operators import anomaly, quality
from lakesight.operators import rules as R
from lakesight.operators.catalog import TableInfo
from lakesight.operators.kpi import Kpi
from lakesight.operators.schema_drift import detect_schema_drift, snapshot
from lakesight.plans import report
from lakesight.sources import database, files, sinks
from lakesight.streaming import jobs


def catalog(table):
    return {n: TableInfo(table(n), [k]) for n, k in (("customer", "c_custkey"), ("orders", "o_orderkey"))}


def test_monthly_report_files(spark, table, tmp_path):
    kpi = Kpi("Revenue", "orders", "SUM(o_totalprice)", "o_orderdate")
    rule = R.Rule("Overdrawn", "customer", "c_acctbal < 0")
    jobs.monthly_report({"sales": catalog(table)}, {"sales": [kpi]}, {"sales": [rule]}, str(tmp_path))
    found = spark.read.option("header", "true").csv(f"{tmp_path}/sales/findings")
    assert found.columns == list(report.FINDINGS)
    assert {"KPI", "Business Rule Violation"} <= {r.Category for r in found.collect()}
    assert spark.read.json(f"{tmp_path}/sales/observations").count() >= 2


def test_nightly_scan_lists_a_failing_database(spark, table):
    broken = {"t": TableInfo(table("orders").withColumn("boom", F.raise_error(F.lit("gone")).cast("double")), ["o_orderkey"])}
    got = {r.database_name: r for r in jobs.nightly_scan({"good": catalog(table), "bad": broken}).collect()}
    assert got["good"].overall_quality_score is not None and got["good"].error is None
    assert got["bad"].overall_quality_score is None and got["bad"].error


def test_drift_snapshots_and_history(spark, table, tmp_path):
    store = str(tmp_path)
    before = catalog(table)
    assert jobs.drift_snapshot({"sales": before}, store) == {"snapshots": 2, "baselines": 2}
    assert jobs.drift_snapshot({"sales": before}, store, only_table="orders") == {"snapshots": 2, "baselines": 1}
    assert sinks.read_baselines(spark, f"{store}/baselines").groupBy("database_name", "table_name", "column_name").count().filter("count > 1").count() == 0
    after = {"orders": TableInfo(table("orders").drop("o_custkey"), ["o_orderkey"])}
    got = {r.table_name: (r.status, r.severity) for r in detect_schema_drift(
        snapshot(after, "sales", 3), sinks.read_history(spark, f"{store}/schemas")).collect()}
    assert got == {"orders": ("DRIFT_DETECTED", "CRITICAL"), "customer": ("TABLE_DROPPED", "CRITICAL")}


def test_job_runs_on_each_arrival(spark, tmp_path):
    incoming, seen = tmp_path / "in", []
    schema = "id int, amount double"
    rule = R.Rule("Negative", "t", "amount < 0")

    def check(batch, number):
        seen.append(R.execute_rules(batch, [rule]).first().violation_count)

    for amounts in ([1.0, -2.0], [-3.0, -4.0, 5.0]):
        rows = pd.DataFrame({"id": range(len(amounts)), "amount": amounts})
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(incoming))
        stream = spark.readStream.schema(schema).parquet(str(incoming))
        jobs.on_arrival(stream, check, str(tmp_path / "state")).awaitTermination(60)
    assert seen == [1, 2]


def test_report_without_findings_says_so(spark, table):
    built = report.build_report(catalog(table), sections=("Appendix",))
    assert "normal limits" in report.observations(built).first().observation
    assert report.findings(built).count() == 0


def test_file_views(spark, table, tmp_path):
    table("region").write.parquet(f"{tmp_path}/My-Region data.parquet")
    views = files.register_files(spark, str(tmp_path))
    assert list(views) == ["my_region_data"]
    assert spark.sql("SELECT count(*) FROM my_region_data").first()[0] == 5
    assert [r.name for r in files.describe(views["my_region_data"]).collect()] == ["r_regionkey", "r_name"]


def test_bounded_sample_is_the_same_with_and_without_the_digest_filter(spark):
    import hashlib

    from lakesight.sources.sampling import bounded_sample

    ids = sorted(range(3000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    for rows in (5, 500):  # the first is filtered by digest, the second is not
        got = {r.id for r in bounded_sample(spark.range(3000), ["id"], rows).collect()}
        assert got == set(ids[:rows])


def test_jdbc_options_split_the_read():
    got = database.jdbc_options("jdbc:postgresql://h/db", "t", database.Split("id", "0", "1000", 8))
    assert got["driver"] == "org.postgresql.Driver"
    assert (got["partitionColumn"], got["numPartitions"], got["upperBound"]) == ("id", "8", "1000")


def test_scratch_copies_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_scratch_base", lambda spark: str(tmp_path / "app"))
    copy = session.materialise(spark.range(5))
    assert copy.count() == 5 and (tmp_path / "app").exists()
    session.clear_scratch(spark)
    assert not (tmp_path / "app").exists()


@pytest.mark.parametrize("name", ["report_findings_all_sections", "report_observations", "job_monthly_report_findings"])
def test_registered_reports_take_all_tables_and_methods(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def scan(tables, keys, method="ALL"):
        raise Seen(tables, keys, method)

    monkeypatch.setattr(anomaly, "sweep", scan)
    with pytest.raises(Seen) as seen:
        reports.QUERIES[name](spark, "/root/testdata/sf0.001")
    tables, keys, method = seen.value.args
    assert set(tables) == set(KEYS) and keys == KEYS and method == "ALL"


def test_registered_nightly_scan_counts_all_tables_and_methods(spark, table):
    tables = {n: table(n) for n in KEYS}
    found = anomaly.sweep(tables, KEYS).groupBy("method").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical")).collect()
    assert {r.method for r in found} == {"Z-SCORE", "IQR", "ISOLATION_FOREST"}
    got = reports.QUERIES["job_nightly_scan"](spark, "/root/testdata/sf0.001").first()
    assert got.error is None and got.overall_quality_score == quality.evaluate_database(tables, KEYS)[2].first().overall_quality_score
    assert (got.total_anomalies, got.critical_count) == (sum(r.n for r in found), sum(r.critical for r in found))


def test_report_sections_are_computed_once(spark, table, tmp_path, monkeypatch):
    """Observations and findings read the written sections, not the tables again."""
    read = {}
    note = lambda df, path: read.setdefault(path.rsplit("/", 1)[1], {f for f in df.inputFiles() if "/lakesight/" not in f})
    monkeypatch.setattr(sinks, "write_json", note)
    monkeypatch.setattr(sinks, "write_csv", note)
    table("orders").write.parquet(f"{tmp_path}/orders")
    orders = TableInfo(spark.read.parquet(f"{tmp_path}/orders"), ["o_orderkey"])
    rule, kpi = R.Rule("Big", "orders", "o_totalprice > 1000"), Kpi("Revenue", "orders", "SUM(o_totalprice)", "o_orderdate")
    jobs.monthly_report({"sales": {"orders": orders}}, {"sales": [kpi]}, {"sales": [rule]}, str(tmp_path), "IQR")
    assert {"kpis", "anomalies", "observations", "findings"} <= set(read)
    assert not any(read[n] for n in ("kpis", "anomalies", "observations", "findings"))


def test_duplicates_of_whole_numbers_and_other_keys(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", None), (None, None, float("nan")), (None, "", 1.0), (2, "b", 2.0)], "i int, s string, d double")
    assert quality._duplicate_counts(df, ["s", "i", "d"]) == {"s": 1, "i": 2, "d": 2}
    # whole numbers travel as such, not as texts
    plans = []
    counted = quality.C.stacked
    try:
        quality.C.stacked = lambda *a: plans.append(counted(*a)) or plans[-1]
        quality._duplicate_counts(df, ["i"])
    finally:
        quality.C.stacked = counted
    assert dict(plans[0].dtypes)["value"] == "bigint"
