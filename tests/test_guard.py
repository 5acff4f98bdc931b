import pytest

from lakesight.plans.guard import UnsafeSql, check_condition, check_formula, check_read_only, is_cut, run_read_only, zero_safe

pytestmark = pytest.mark.usefixtures("spark")  # texts are parsed by a session


@pytest.mark.parametrize("sql", [
    "SELECT * FROM t", "  select a from t ;", "WITH x AS (SELECT 1) SELECT * FROM x", "EXPLAIN SELECT 1",
    "SELECT region, sum(a) FROM t GROUP BY region ORDER BY 2", "SELECT 1 -- a comment", "/* first */ SELECT 2",
    "SELECT '/* x */' AS c, 'a--b' AS d", "SELECT 1 WHERE 'call' = 'x'", "SELECT `drop` FROM t", "SELECT 'it''s; ok'", 'SELECT "delete"', "SELECT a.`b c` FROM t a",
    "SELECT replace(a, 'x', 'y') FROM t", "SELECT lock, rename FROM t", "SELECT 1 AS call", "SELECT update FROM merge WHERE kill > 1",
    "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT (SELECT max(x) FROM b) AS m, x IN (SELECT x FROM a) AS i FROM b",
    "SELECT a, rank() OVER (PARTITION BY b ORDER BY c) AS r FROM t", "SELECT * FROM x JOIN y USING (k) LEFT JOIN z ON x.a = z.a",
    "SELECT a FROM t UNION ALL SELECT a FROM u INTERSECT SELECT b FROM v EXCEPT SELECT c FROM w", "SELECT * FROM VALUES (1, 2), (3, 4) AS t(a, b)",
    "SELECT * FROM t LATERAL VIEW explode(a) e AS x", "SELECT * FROM range(5)", "SELECT * FROM t TABLESAMPLE (10 PERCENT)",
    "SELECT a, count(*) FROM t GROUP BY ROLLUP (a) HAVING count(*) > 1 ORDER BY a LIMIT 5 OFFSET 2", "SELECT sum(a) OVER w FROM t WINDOW w AS (ORDER BY b)",
    "SELECT * FROM t PIVOT (sum(a) FOR b IN ('x', 'y'))", "SELECT DISTINCT a FROM db.t", "(SELECT 1) UNION (SELECT 2)",
])
def test_reads_are_accepted(sql):
    check_read_only(sql)


@pytest.mark.parametrize("sql", [
    "", "   ", "-- nothing", "DROP TABLE t", "DELETE FROM t", "UPDATE t SET a = 1", "INSERT INTO t VALUES (1)",
    "TRUNCATE TABLE t", "ALTER TABLE t ADD c int", "CREATE TABLE t (a int)", "GRANT ALL ON t TO u", "EXEC p", "COPY t TO 'f'",
    "ATTACH 'f'", "SELECT 1; SELECT 2", "SELECT 1; DROP TABLE t", "SELECT 1 /* x */; DELETE FROM t",
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SELECT pg_sleep(9)", "SELECT 1 INTO OUTFILE 'f'",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('a', 'b')", "SELECT try_reflect('a', 'b')",
    "SELECT * FROM parquet.`/etc/x`", "SELECT * FROM text . `file:/x`", "SELECT 'open", "SELECT 1 /* open",
    "WITH x AS (SELECT reflect('a', 'b') AS y) SELECT * FROM x", "SELECT * FROM (SELECT * FROM parquet.`/etc/x`) s", "SELECT (SELECT max(v) FROM text.`/x`)",
    "SELECT 1 WHERE EXISTS (SELECT 1 FROM csv.`/x`)", "SELECT a IN (SELECT java_method('a', 'b')) FROM t", "WITH x AS (SELECT * FROM json.`x`) SELECT 1",
    "EXPLAIN DROP TABLE t", "EXPLAIN SELECT try_reflect('a', 'b')", "SHOW TABLES", "SET a = b", "CACHE TABLE t", "ADD JAR 'x'", "DESCRIBE t",
    "SELECT * FROM IDENTIFIER('parquet.`/x`')", "SELECT IDENTIFIER('reflect')('a', 'b')", "SELECT * FROM read_files('/x')", "SELECT system.builtin.reflect('a', 'b')",
    "WITH x AS (WITH y AS (SELECT * FROM orc.`/x`) SELECT * FROM y) SELECT * FROM x", "SELECT * FROM information_schema.user_privileges",
    "SELECT * FROM t ORDER BY reflect('a', 'b')", "SELECT a FROM t GROUP BY a HAVING max(reflect('a', 'b')) > 'c'", "EXPLAIN EXPLAIN SELECT 1",
    "SELECT * FROM t LATERAL VIEW explode(array(reflect('a', 'b'))) e AS x", "SELECT transform(a, x -> reflect('a', x)) FROM t",
    "SELECT * FROM a JOIN b ON a.x = reflect('a', 'b')", "SELECT sum(a) OVER (ORDER BY reflect('a', 'b')) FROM t", "VALUES (1)", "TABLE t", "FROM t SELECT a",
])
def test_writes_are_refused(sql):
    with pytest.raises(UnsafeSql):
        check_read_only(sql)


@pytest.mark.parametrize("formula, columns", [
    ("SUM(x)", ["x"]), ("COUNT(*)", []), ("SUM(a) / COUNT(b)", ["a", "b"]), ("AVG(x)", ["x"]),
    ("MAX(x) - MIN(x)", ["x"]), ("SUM(x) * 1.18", ["x"]), ("SUM(lock) / COUNT(t.call)", ["lock", "t.call"]), ("-SUM(a) + 2", ["a"]),
])
def test_formulas(formula, columns):
    assert check_formula(formula) == columns


@pytest.mark.parametrize("formula", [
    "", "SUM(x); DROP TABLE t", "SUM(x) UNION SELECT 1", "EXEC(x)", "SUM(x) -- c", "SUM(x) /* c */", "SUM('x')", "SUM(x", "SUM(x) % 2", "LOCK(x)", "SUM(SELECT)(1)",
])
def test_bad_formulas(formula):
    with pytest.raises(UnsafeSql):
        check_formula(formula)


@pytest.mark.parametrize("condition", ["a > 1", "a = 'x' AND b < 2", "a IS NULL OR b BETWEEN 1 AND 2"])
def test_conditions(condition):
    assert check_condition(condition) == condition


@pytest.mark.parametrize("condition", ["", "a > 1; DROP TABLE t", "a > 1 -- c", "a /* c */ > 1", "a IN (DELETE FROM t)", "reflect('a', 'b') = 'c'"])
def test_bad_conditions(condition):
    with pytest.raises(UnsafeSql):
        check_condition(condition)


def test_division_by_zero_gives_null(spark):
    spark.sql("SELECT 1 AS a, 0 AS b").createOrReplaceTempView("zero")
    for formula in ("SUM(a) / SUM(b)", "SUM(a) / (SUM(b) * 2) + 1", "SUM(a)/COUNT(a)/MAX(b)"):
        assert spark.sql("SELECT * FROM zero").selectExpr(f"{zero_safe(formula)} AS v").first().v is None


def test_limits(spark):
    spark.range(5000).createOrReplaceTempView("numbers")
    assert run_read_only(spark, "SELECT id FROM numbers").count() == 5000
    assert run_read_only(spark, "SELECT id FROM numbers", default_limit=1000).count() == 1000
    assert run_read_only(spark, "SELECT id FROM numbers LIMIT 3000;", default_limit=1000).count() == 3000
    assert is_cut(spark, "SELECT id FROM numbers", default_limit=1000) and not is_cut(spark, "SELECT id FROM numbers", max_rows=5000)
    assert run_read_only(spark, "SELECT id FROM numbers LIMIT 3000", max_rows=2000).count() == 2000
    assert run_read_only(spark, "SELECT id FROM numbers LIMIT 7 OFFSET 4998").count() == 2
    assert "Plan" in run_read_only(spark, "EXPLAIN SELECT id FROM numbers").first()[0]


def test_texts_run_as_they_are(spark):
    assert run_read_only(spark, "SELECT '/* x */' AS c, 'a--b' AS d /* gone */ ; ").first() == ("/* x */", "a--b")
