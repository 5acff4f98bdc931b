"""Registered queries against their SQL, on clean and on damaged tables."""

import duckdb
import pytest

from lakesight.llm.queries import ORACLE, QUERIES
from tools.compare import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"


def same(spark, name, folder, db):
    df = QUERIES[name](spark, folder)
    cursor = db.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    same(spark, name, SMALL, db)


@pytest.fixture(scope="module")
def damaged(spark, tmp_path_factory, odd_rows):
    """The small tables with odd rows added to documents, benchmark and pages."""
    from tests.llm.conftest import DOCUMENTS

    folder = str(tmp_path_factory.mktemp("damaged"))
    line = "a line that many of the documents of one host carry"
    # SQL lists of words make very long texts slow there; test_operators.py has those
    odd_rows = [(r[0], r[1][:20_000] if r[1] else r[1], *r[2:]) for r in odd_rows]
    extra = [(r[0] + 10_000 if r[0] else None, r[1], "en", r[2] if len(r) > 2 else "odd", None) for r in odd_rows]
    extra += [(20_000 + i, f"{line}\nnumber {i} of them\n{line}", None, None if i % 2 else "odd", 1) for i in range(60)]
    docs = spark.createDataFrame(extra, DOCUMENTS)
    spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(docs).write.parquet(f"{folder}/documents.parquet")
    items = spark.createDataFrame([(900, None), (901, ""), (902, "one two three"), (902, "one two three"), (903, "word")], "item_id long, text string")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").unionByName(items).write.parquet(f"{folder}/benchmark.parquet")
    urls = [None, "", "no scheme/x", "://", "http://", "http://A.example.ORG", "http://x.com/de/1", "http://x.com/de/1", "ftp://h/a/b/c/d/e/f/g/h/i/j?x",
            "http://ü.net/é#f", "http://example.org/en/12", "http://org/", "a://b://c/d"]
    pages = spark.createDataFrame([(5000 + i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    spark.read.parquet(f"{SMALL}/pages.parquet").unionByName(pages).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql_with_odd_rows(spark, damaged, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{damaged}/{t}.parquet/*.parquet'")
    same(spark, name, damaged, db)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "pages", "labels"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
