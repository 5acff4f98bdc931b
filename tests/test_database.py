"""Ranges of a database read, through DataFrame filters and DuckDB; a live database is not read here."""

import duckdb
import pytest

from lakesight.sources import database


@pytest.mark.parametrize("values", [
    [1] * 5000 + list(range(2, 1000)) + [None] * 300, [None] * 5, [7] * 9, [], list(range(400)), [-1.5, 2.25] * 50 + [1e9],
])
def test_every_row_fits_one_range_and_ranges_follow_the_data(spark, values):
    db = duckdb.connect()
    db.execute("CREATE TABLE t (k DOUBLE)")
    if values:
        db.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    buckets = db.execute(database.histogram_query("t", "k", 8)).fetchall()
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "k double")
    counts = [df.filter(p).count() for p in database.predicates("k", buckets)]
    assert sum(counts) == len(values) and counts[-1] == sum(v is None for v in values)
    if len(values) == 400:
        assert max(counts) <= 2 * 400 / 8
    if values[:1] == [1]:
        assert max(counts[1:-1]) < 1000 <= max(counts)  # the frequent value is one range; others do not join it


def test_texts_are_quoted():
    assert database.predicates("c", [("a", "b", 1), ("o'x", "z", 2)]) == ["c < 'o''x'", "c >= 'o''x'", "c IS NULL"]
