"""Data and schema drift between halves of the given tables."""

from pyspark.sql import functions as F

from checks.catalogs import COLUMNS, KEYS, TYPES, whole
from checks.common import rounded, table
from lakesight.operators import catalog as K
from lakesight.operators import data_drift as D
from lakesight.operators import schema_drift as S
from lakesight.session import materialise, scratch_folder
from lakesight.sources.sinks import append_schema_snapshot, read_baselines, read_history
from lakesight.streaming import jobs

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def halves(spark, folder):
    """Line items shipped before 1999 as baseline; later ones, with prices raised, as current rows."""
    lines = table(spark, folder, "lineitem")
    old = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    current = (
        lines.filter(~old)
        .withColumn("l_extendedprice", F.col("l_extendedprice") * 1.25)
        .withColumn("l_tax", F.col("l_tax") * 2)
        .withColumn("l_quantity", F.col("l_quantity") + 9)
    )
    return current, lines.filter(old)


OLD = "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')"
NEW = """(SELECT * REPLACE (l_extendedprice * 1.25::DOUBLE AS l_extendedprice, l_tax * 2 AS l_tax, l_quantity + 9 AS l_quantity)
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01')"""


def stats_sql(source, columns, prefix="", rounding=None):
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, coalesce(stddev_samp({c}), 0) AS sd,
          min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, quantile_cont({c}::DOUBLE, 0.5) AS med,
          quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}""" for c in columns)


def ks_sql(old, new, columns):
    one = lambda c: f"""SELECT '{c}' AS column_name, max(abs(ub / nb - uc / nc)) AS ks, max(nb) AS nb, max(nc) AS nc FROM
      (SELECT v, sum(b) OVER (ORDER BY v) * 1.0::DOUBLE AS ub, sum(c) OVER (ORDER BY v) * 1.0::DOUBLE AS uc,
         sum(b) OVER () * 1.0::DOUBLE AS nb, sum(c) OVER () * 1.0::DOUBLE AS nc FROM
        (SELECT v, sum(b) AS b, sum(c) AS c FROM (SELECT {c}::DOUBLE AS v, 1 AS b, 0 AS c FROM {old}
          UNION ALL SELECT {c}::DOUBLE, 0, 1 FROM {new}) GROUP BY v))"""
    return "\nUNION ALL\n".join(one(c) for c in columns)


def drift_sql(old, new, columns, exact_p=None):
    shift = lambda a, b: rounded(f"({a} - {b}) / CASE WHEN abs({b}) > 1e-6 THEN abs({b}) ELSE 1 END * 100", 2)
    asymptotic = """CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * (SELECT
             sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) r(k)))) END"""
    return f"""SELECT column_name, drift AS drift_detected,
        CASE WHEN NOT drift THEN 'NONE' WHEN ks > 0.4 OR abs(ms) > 50 THEN 'CRITICAL'
          WHEN ks > 0.25 OR abs(ms) > 30 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
        {rounded('ks', 4)} AS ks_statistic, {rounded('p', 6)} AS p_value, ms AS mean_shift_pct, ss AS std_shift_pct,
        {rounded('bm', 2)} AS baseline_mean, {rounded('cm', 2)} AS current_mean,
        {rounded('bmed', 2)} AS baseline_median, {rounded('cmed', 2)} AS current_median,
        CASE WHEN drift THEN 'Distribution moved: KS ' || printf('%.3f', {rounded('ks', 3)}) || ', p ' ||
          printf('%.4f', {rounded('p', 4)}) || ', mean ' || printf('%+.1f', {rounded('ms', 1)}) || '%'
          ELSE 'Distribution is consistent with the baseline' END AS summary
      FROM (SELECT *, (p < 0.05 AND ks > 0.15) OR abs(ms) >= 20 AS drift FROM
        (SELECT *, {exact_p or asymptotic} AS p FROM
          (SELECT c.column_name, b.mean AS bm, c.mean AS cm, b.med AS bmed, c.med AS cmed, ks,
             {shift('c.mean', 'b.mean')} AS ms, {shift('c.sd', 'b.sd')} AS ss,
             ks * sqrt(nb * nc / (nb + nc)) AS lam
           FROM ({stats_sql(new, columns)}) c JOIN ({stats_sql(old, columns)}) b USING (column_name)
             JOIN ({ks_sql(old, new, columns)}) k USING (column_name))))"""


def baseline_rows(spark, folder):
    """A stored baseline of the old half, upserted with the new half's statistics of fewer columns."""
    current, old = halves(spark, folder)
    stored = D.baseline_statistics(old, "sales", "lineitem")
    fresh = D.baseline_statistics(current.select("l_tax", "l_quantity"), "sales", "lineitem")
    wide = D.upsert_baseline(stored, fresh)
    return wide.select(*D.KEY, "sample_size", *[F.round(c, 4).alias(c) for c in wide.columns if c.endswith("_val")])


def _baseline_sql(source, columns):
    r = lambda e: rounded(e, 4)
    return f"""SELECT 'sales' AS database_name, 'lineitem' AS table_name, column_name, n AS sample_size, {r('mean')} AS mean_val,
        {r('sd')} AS std_val, {r('lo')} AS min_val, {r('hi')} AS max_val, {r('med')} AS median_val, {r('q1')} AS p25_val,
        {r('q3')} AS p75_val FROM ({stats_sql(source, columns)}) WHERE n >= 5"""


def changed(spark, folder):
    """The catalog after a release: orders lost a column and gained one, part has new types, labels is gone, audit is new."""
    now = whole(spark, folder)
    orders = now["orders"].df
    now["orders"] = K.TableInfo(orders.drop("o_orderpriority").withColumn(
        "o_note", F.when(F.col("o_custkey") % 2 == 0, "even")), ["o_orderkey"])
    now["part"] = K.TableInfo(now["part"].df.withColumn("p_size", F.col("p_size").cast("bigint")), ["p_partkey"])
    now["nation"] = K.TableInfo(now["nation"].df.withColumn("n_comment", F.lit("x")), ["n_nationkey"])
    now["event_audit"] = K.TableInfo(now["events"].df.select("event_id", "ts"), ["event_id"])
    del now["labels"]
    return now


def schema_report(spark, folder):
    """Two stored snapshots of the tables, compared with the changed catalog."""
    store = scratch_folder(spark)
    before = whole(spark, folder)
    append_schema_snapshot(before, "sales", store, observed=True)
    number = append_schema_snapshot(before, "sales", store, observed=True)
    current = materialise(S.snapshot(changed(spark, folder), "sales", number + 1, observed=True))
    return S.detect_schema_drift(current, read_history(spark, store))


_CHANGES = {"orders": ("o_note", "o_orderpriority", "", 6), "part": ("", "", "p_size", 6), "nation": ("n_comment", "", "", 4)}


def _schema_sql():
    rows = []
    for t, columns in COLUMNS.items():
        added, removed, modified, now = _CHANGES.get(t, ("", "", "", len(columns)))
        dropped = t == "labels"
        status = "TABLE_DROPPED" if dropped else "DRIFT_DETECTED" if added or removed or modified else "STABLE"
        severity = "CRITICAL" if dropped or removed else "HIGH" if modified else "MEDIUM" if added else "NONE"
        rows.append(("sales", t, status, severity, status in ("TABLE_DROPPED", "DRIFT_DETECTED"), removed, modified, added,
                     0 if dropped else now, len(columns)))
    rows.append(("sales", "event_audit", "INITIAL_BASELINE", "NONE", False, "", "", "", 2, 0))
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)
    return f"""SELECT t.*, schema_hash FROM (VALUES {values}) t(database_name, table_name, status, severity, drift_detected,
        removed_columns, modified_columns, added_columns, current_columns_count, baseline_columns_count)
      LEFT JOIN ({_changed_hash_sql()}) h USING (database_name, table_name)"""


def _one_hash(t, columns, types, source, declared=False):
    # columns of Parquet files are all declared nullable
    nullable = lambda c: "CASE WHEN count(*) >= 0 THEN 'True' END" if declared else f"CASE WHEN count(*) > count({c}) THEN 'True' ELSE 'False' END"
    texts = " || '|' || ".join(
        f"'{c}:{types.get(c, 'string')}:' || {nullable(c)} || ':{c in KEYS.get(t, KEYS['events'])}'"
        for c in sorted(columns))
    return f"""SELECT 'sales' AS database_name, 1 AS taken, '{t}' AS table_name, {len(columns)} AS column_count,
        sha256({texts}) AS schema_hash FROM {source}"""


def _hash_sql(declared=False):
    return "\nUNION ALL\n".join(_one_hash(t, c, TYPES, t, declared) for t, c in COLUMNS.items())


def _changed_hash_sql():
    columns = {t: list(c) for t, c in COLUMNS.items() if t != "labels"}
    sources = {t: t for t in columns}
    columns["orders"] = [c for c in columns["orders"] if c != "o_orderpriority"] + ["o_note"]
    sources["orders"] = "(SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'even' END AS o_note FROM orders)"
    columns["nation"] += ["n_comment"]
    sources["nation"] = "(SELECT *, 'x' AS n_comment FROM nation)"
    columns["event_audit"], sources["event_audit"] = ["event_id", "ts"], "events"
    types = {**TYPES, "p_size": "bigint"}
    return "\nUNION ALL\n".join(_one_hash(t, c, types, sources[t]) for t, c in columns.items())


def drift_totals(spark, folder):
    current, old = halves(spark, folder)
    orders = table(spark, folder, "orders")
    lines = D.table_summary(D.detect_data_drift(current, old), "lineitem")
    return D.overall_summary(lines.unionByName(D.table_summary(D.detect_data_drift(orders), "orders")))


def stored_snapshots(spark, folder):
    """The drift job run twice on two tables; what it has stored, per table."""
    store = scratch_folder(spark)
    tables = {n: t for n, t in whole(spark, folder).items() if n in ("orders", "supplier")}
    for _ in range(2):
        jobs.drift_snapshot({"sales": tables}, store)
    columns = read_history(spark, f"{store}/schemas").groupBy("table_name").agg(
        F.countDistinct("taken").alias("snapshots"), F.countDistinct("column_name").alias("n_columns"))
    baselines = read_baselines(spark, f"{store}/baselines").groupBy("table_name").agg(
        F.count("*").alias("baselines"), F.round(F.sum("mean_val"), 4).alias("sum_of_means"))
    return columns.join(baselines, "table_name")


def small_samples(spark, folder):
    """Lengths of the nations' names as baseline, words of the benchmark's items as current values: p is exact."""
    old = table(spark, folder, "nation").select(F.length("n_name").cast("double").alias("size"))
    new = table(spark, folder, "benchmark").select(F.size(F.split("text", " ")).cast("double").alias("size"))
    return D.detect_data_drift(new, old)


def small_sql():
    """As ``drift_sql``, with p from the share of lattice paths that leave the band, one anti-diagonal per step."""
    old = "(SELECT length(n_name)::DOUBLE AS size FROM nation)"
    new = "(SELECT len(string_split(text, ' '))::DOUBLE AS size FROM benchmark)"
    exact = f"""(WITH RECURSIVE k AS (SELECT nb::BIGINT AS n, nc::BIGINT AS m, round(ks * nb * nc)::BIGINT AS edge FROM ({ks_sql(old, new, ['size'])})),
        walk AS (SELECT 0::BIGINT AS s, 0::BIGINT AS i, 1.0::DOUBLE AS p, n, m, edge FROM k
          UNION ALL SELECT s + 1, i, sum(p), n, m, edge FROM (
            SELECT s, i + 1 AS i, p * (n - i)::DOUBLE / (n + m - s) AS p, n, m, edge FROM walk WHERE i < n
            UNION ALL SELECT s, i, p * (m - (s - i))::DOUBLE / (n + m - s), n, m, edge FROM walk WHERE s - i < m)
          WHERE s < n + m AND abs(i * m - (s + 1 - i) * n) < edge GROUP BY s, i, n, m, edge)
      SELECT CASE WHEN (SELECT edge FROM k) <= 0 THEN 1.0 ELSE greatest(0.0, 1 - coalesce((SELECT max(p) FROM walk WHERE s = n + m), 0)) END AS p)"""
    return drift_sql(old, new, ["size"], exact)


DRIFT = drift_sql(OLD, NEW, LINE_NUMBERS)

QUERIES = {
    "drift_lineitem": lambda s, d: D.detect_data_drift(*halves(s, d)),
    "drift_orders_against_itself": lambda s, d: D.detect_data_drift(table(s, d, "orders")),
    "drift_small_samples": small_samples,
    "drift_table_summary": lambda s, d: D.table_summary(D.detect_data_drift(*halves(s, d)), "lineitem"),
    "drift_all_tables": drift_totals,
    "drift_baseline_upsert": baseline_rows,
    "schema_snapshot_hashes": lambda s, d: S.schema_hashes(S.snapshot(whole(s, d), "sales", 1, observed=True)),
    "schema_snapshot_declared": lambda s, d: S.schema_hashes(S.snapshot(whole(s, d), "sales", 1)),
    "job_drift_snapshot": stored_snapshots,
    "schema_drift_tables": schema_report,
    "schema_drift_overall": lambda s, d: S.overall_status(schema_report(s, d)),
}

ORACLE = {
    "drift_lineitem": DRIFT,
    "drift_small_samples": small_sql(),
    "drift_orders_against_itself": drift_sql("orders", "orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
    "drift_table_summary": f"""SELECT 'lineitem' AS table_name, count(*) AS total_numerical_columns,
        count(*) FILTER (WHERE drift_detected) AS drifted_columns_count,
        CASE WHEN bool_or(drift_detected) THEN 'DRIFT_DETECTED' ELSE 'STABLE' END AS table_drift_status FROM ({DRIFT})""",
    "drift_all_tables": f"""SELECT 2 AS tables_analyzed, 1 AS tables_with_drift,
        count(*) FILTER (WHERE drift_detected) AS drifted_columns_count, 'DRIFT_DETECTED' AS overall_status FROM ({DRIFT})""",
    "drift_baseline_upsert": f"""({_baseline_sql(OLD, [c for c in LINE_NUMBERS if c not in ('l_tax', 'l_quantity')])})
        UNION ALL ({_baseline_sql(NEW, ['l_tax', 'l_quantity'])})""",
    "schema_snapshot_hashes": _hash_sql(),
    "schema_snapshot_declared": _hash_sql(declared=True),
    "job_drift_snapshot": f"""SELECT 'orders' AS table_name, 2 AS snapshots, (SELECT count(*) FROM (DESCRIBE orders)) AS n_columns, 3 AS baselines,
        {rounded('avg(o_orderkey) + avg(o_custkey) + avg(o_totalprice)', 4)} AS sum_of_means FROM orders
      UNION ALL SELECT 'supplier', 2, (SELECT count(*) FROM (DESCRIBE supplier)), 3,
        {rounded('avg(s_suppkey) + avg(s_nationkey) + avg(s_acctbal)', 4)} FROM supplier""",
    "schema_drift_tables": _schema_sql(),
    "schema_drift_overall": f"""SELECT count(*) AS total_tables, count(*) FILTER (WHERE drift_detected) AS drift_detected_count,
        'CRITICAL_DRIFT' AS overall_status FROM ({_schema_sql()})""",
}
