"""Anomaly detection on whole tables."""

from checks.catalogs import KEYS
from checks.common import rounded, table
from lakesight.operators import isolation_forest as forest
from lakesight.operators import anomaly as A
from lakesight.operators.isolation_forest import detect_isolation_forest

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_ID = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

LEVEL = lambda x: (f"CASE WHEN abs({x}) >= 4.0 THEN 'CRITICAL' WHEN abs({x}) >= 3.2 THEN 'HIGH' "
                   f"WHEN abs({x}) >= 2.5 THEN 'MEDIUM' ELSE 'LOW' END")


def shaped(source, metric, method, center, low, high, score, level, text):
    return f"""SELECT row_id, entity, '{metric}' AS metric, {rounded('v', 2)} AS observed_value,
        {rounded(low, 2)} AS normal_range_min, {rounded(high, 2)} AS normal_range_max,
        {rounded(f'CASE WHEN {center} <> 0 THEN (v - {center}) / abs({center}) * 100 ELSE 100 END', 2)} AS deviation_pct,
        {level} AS severity, '{method}' AS method, {rounded(score, 2)} AS score, {text} AS explanation FROM {source}"""


def one(e, n=1):
    return f"printf('%.{n}f', {rounded(e, n)})"


def zscore_sql(source, metric, row, entity):
    return shaped(
        f"""(SELECT *, (v - mean) / sd AS z FROM (SELECT {row} AS row_id, {entity} AS entity, {metric}::DOUBLE AS v FROM {source}) t,
          (SELECT count({metric}) AS n, avg({metric}) AS mean, stddev_samp({metric}) AS sd FROM {source}) s
          WHERE n >= 10 AND sd > 0 AND abs((v - mean) / sd) >= 2.5)""",
        metric, "Z-SCORE", "mean", "mean - 2 * sd", "mean + 2 * sd", "abs(z)", LEVEL("z"),
        f"{one('v')} || ' is ' || {one('z', 2)} || ' standard deviations from the mean ' || {one('mean')}")


def iqr_sql(source, metric, row, entity):
    return shaped(
        f"""(SELECT *, CASE WHEN v > hi THEN v - hi ELSE lo - v END / iqr AS beyond FROM
          (SELECT {row} AS row_id, {entity} AS entity, {metric}::DOUBLE AS v FROM {source}) t,
          (SELECT *, q1 - 1.5 * iqr AS lo, q3 + 1.5 * iqr AS hi FROM (SELECT *, q3 - q1 AS iqr FROM
            (SELECT count({metric}) AS n, quantile_cont({metric}::DOUBLE, 0.25) AS q1,
               quantile_cont({metric}::DOUBLE, 0.5) AS q2, quantile_cont({metric}::DOUBLE, 0.75) AS q3 FROM {source}))) s
          WHERE n >= 10 AND iqr > 0 AND (v < lo OR v > hi))""",
        metric, "IQR", "q2", "lo", "hi", "beyond + 2", LEVEL("(beyond + 2)"),
        f"{one('v')} || ' lies ' || {one('beyond')} || ' times the IQR outside ' || {one('lo')} || ' to ' || {one('hi')}")


def rolling_sql(source, metric, row, entity, order, per=None):
    part = f"PARTITION BY {per}" if per else ""
    return shaped(
        f"""(SELECT *, (v - mean) / sd AS z FROM
          (SELECT {row} AS row_id, {entity} AS entity, {metric}::DOUBLE AS v, avg({metric}) OVER w AS mean,
             stddev_samp({metric}) OVER w AS sd, count({metric}) OVER w AS seen FROM {source}
           WINDOW w AS ({part} ORDER BY {order} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
          WHERE seen = 5 AND sd > 0 AND sd > 1e-12 * abs(mean) AND abs((v - mean) / sd) >= 2.5)""",
        metric, "ROLLING_WINDOW", "mean", "mean - 2 * sd", "mean + 2 * sd", "abs(z)", LEVEL("z"),
        f"{one('v')} || ' is ' || {one('z', 2)} || ' standard deviations from the mean ' || {one('mean', 2)} || ' of the 5 rows before'")


def forest_sql(source, metrics, row, entity):
    """The forest of ``isolation_forest``: the same draw, the same hashes, the same cuts, one level per step."""
    d, size, per = len(metrics), forest.TREES * forest.ROWS_PER_TREE, forest.ROWS_PER_TREE
    xs = [f"x{i}" for i in range(d)]
    uniform = lambda kind: f"('0x' || substr(md5('{forest.SEED}|{kind}|' || tree || '|' || node), 1, 13))::BIGINT / pow(2, 52)"
    steps = ""
    deepest = forest.levels(per)
    for i in range(deepest + 1):
        lows, highs = (", ".join(f"{f}(x[{k + 1}])" for k in range(d)) for f in ("min", "max"))
        steps += f"""
  a{i} AS (SELECT tree, node, count(*) AS n, [{lows}] AS lo, [{highs}] AS hi FROM g{i} GROUP BY tree, node),
  c{i} AS (SELECT *, list_filter(range(1, {d + 1}), lambda f: hi[f] > lo[f]) AS can FROM a{i}),
  f{i} AS (SELECT *, CASE WHEN n <= 1 OR len(can) = 0 OR {i} >= deepest THEN 0
      ELSE can[1 + floor({uniform('feature')} * len(can))::INT] END AS f FROM c{i}, lim),
  n{i} AS MATERIALIZED (SELECT tree, node, n, {i} AS depth, f, CASE WHEN f = 0 THEN 0 WHEN cut < hi[f] THEN cut ELSE lo[f] END AS cut
      FROM (SELECT *, CASE WHEN f > 0 THEN lo[f] + {uniform('cut')} * (hi[f] - lo[f]) END AS cut FROM f{i})),
  g{i + 1} AS MATERIALIZED (SELECT g.tree, x, 2 * node + (x[f] > cut)::INT AS node FROM g{i} g JOIN n{i} USING (tree, node) WHERE f > 0),"""
    mean_path = lambda n: f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} END"
    nodes = " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(deepest + 1))
    return shaped(
        f"""(WITH RECURSIVE r AS MATERIALIZED (SELECT {row} AS row_id, {entity} AS entity, {', '.join(f'{m}::DOUBLE AS {x}' for m, x in zip(metrics, xs))}
      FROM {source} WHERE {' AND '.join(f'{m} IS NOT NULL' for m in metrics)}),
  s AS (SELECT count(*) AS n, avg(x0) AS mean, coalesce(stddev_samp(x0), 0) AS sd FROM r),
  lim AS (SELECT min(l) AS deepest FROM range(1, {deepest + 1}) t(l), s WHERE (1 << l) >= least(n, {per})),
  pool AS MATERIALIZED (SELECT row_id, {', '.join(xs)}, row_number() OVER (PARTITION BY row_id, {', '.join(xs)}) AS copy FROM r
      ORDER BY md5('{forest.SEED}|' || row_id), row_id, {', '.join(xs)}, copy LIMIT {size}),
  g0 AS MATERIALIZED (SELECT tree, [{', '.join(xs)}] AS x, 1 AS node FROM pool, range({forest.TREES}) t(tree), s WHERE n >= 10
      QUALIFY row_number() OVER (PARTITION BY tree ORDER BY md5(tree || '|' || row_id || '|' || copy), row_id, {', '.join(xs)}, copy) <= {per}),{steps}
  nodes AS MATERIALIZED (SELECT tree, node, f, cut, round((depth + {mean_path('n')}) * {forest.PATH_UNIT})::BIGINT AS path FROM ({nodes})),
  p AS (SELECT [{', '.join(xs)}] AS x, tree, 1::INT AS node FROM (SELECT DISTINCT {', '.join(xs)} FROM r), range({forest.TREES}) t(tree)
    UNION ALL SELECT x, p.tree, (2 * p.node + (x[f] > cut)::INT)::INT FROM p JOIN nodes USING (tree, node) WHERE f > 0),
  totals AS (SELECT x, sum(path)::DOUBLE AS total FROM p JOIN nodes USING (tree, node) WHERE f = 0 GROUP BY x),
  scored AS MATERIALIZED (SELECT row_id, entity, x0 AS v, n, mean, sd,
      pow(2.0, -total / (({mean_path(f'least(n, {per})')}) * {forest.PATH_UNIT} * {forest.TREES})) AS raw
      FROM r, s JOIN totals ON totals.x = [{', '.join('r.' + x for x in xs)}]),
  place AS (SELECT *, (len(l) - 1) * (1 - CASE WHEN len(l) * {forest.CONTAMINATION} < 1
      THEN least(greatest(1.0::DOUBLE / len(l), {forest.MIN_CONTAMINATION}), {forest.MAX_CONTAMINATION}) ELSE {forest.CONTAMINATION} END)::DOUBLE AS pos
      FROM (SELECT list_sort(list(raw)) AS l FROM scored)),
  ends AS (SELECT l[floor(pos)::BIGINT + 1] AS lo, l[ceil(pos)::BIGINT + 1] AS hi, pos - floor(pos) AS part FROM place),
  bound AS (SELECT CASE WHEN lo = hi THEN lo ELSE lo * (1 - part) + hi * part END AS bound FROM ends)
  SELECT *, raw - bound AS margin FROM scored, bound WHERE raw > bound)""",
        ", ".join(metrics), "ISOLATION_FOREST", "mean", "mean - 2 * sd", "mean + 2 * sd", f"margin * {forest.SCORE_SCALE}",
        f"CASE WHEN margin > {forest.HIGH_SCORE} THEN 'HIGH' ELSE 'MEDIUM' END",
        f"'isolated easily over {', '.join(metrics)} (score ' || {one('margin', 3)} || '); first value ' || {one('v')}")


def all_methods_sql(source, metric, row, entity):
    return "\nUNION ALL\n".join((zscore_sql(source, metric, row, entity), iqr_sql(source, metric, row, entity), forest_sql(source, [metric], row, entity)))


EVENT = ("events", "value", "CAST(event_id AS VARCHAR)", "event_type")
EVENTS_ZSCORE, EVENTS_IQR = zscore_sql(*EVENT), iqr_sql(*EVENT)


def events(spark, folder):
    return table(spark, folder, "events")


def both(spark, folder):
    df = events(spark, folder)
    summary = A.metric_summary(df, "value")
    return A.strongest_per_row(
        A.detect_zscore(df, "value", ["event_id"], "event_type", summary=summary)
        .unionByName(A.detect_iqr(df, "value", ["event_id"], "event_type", summary=summary)))


def sweep_sql(keys, metrics, detector=iqr_sql):
    """Anomalies of one metric per table, rows named by their keys."""
    row = {t: f"concat_ws('|', {', '.join(keys[t])})" for t in metrics}
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, * FROM ({detector(t, m, row[t], f"'Row ' || {row[t]}")})" for t, m in metrics.items())


# the first numeric column that is no key, or else the first
METRICS = {
    "region": "r_regionkey", "nation": "n_regionkey", "customer": "c_nationkey", "supplier": "s_nationkey", "part": "p_size",
    "orders": "o_custkey", "lineitem": "l_partkey", "events": "user_id", "documents": "n_chars", "embeddings": "label",
    "pages": "page_id", "benchmark": "item_id", "labels": "quality", "conversations": "conv_id",
}

QUERIES = {
    "anomaly_zscore_events": lambda s, d: A.detect_zscore(events(s, d), "value", ["event_id"], "event_type"),
    "anomaly_iqr_events": lambda s, d: A.detect_iqr(events(s, d), "value", ["event_id"], "event_type"),
    "anomaly_iqr_documents": lambda s, d: A.detect_iqr(table(s, d, "documents"), "n_chars", ["doc_id"]),
    "anomaly_rolling_events": lambda s, d: A.detect_rolling(events(s, d), "value", "ts", ["event_id"], "event_type"),
    "anomaly_rolling_lineitem": lambda s, d: A.detect_rolling(
        table(s, d, "lineitem"), "l_extendedprice", "l_shipdate", LINE_KEY),
    "anomaly_rolling_per_supplier": lambda s, d: A.detect_rolling(
        table(s, d, "lineitem"), "l_extendedprice", "l_shipdate", LINE_KEY, "l_suppkey", per="l_suppkey"),
    "anomaly_scan_severities": lambda s, d: A.severity_summary(both(s, d)),
    "anomaly_scan_top": lambda s, d: A.top_anomalies(both(s, d)),
    "anomaly_scan_all_methods": lambda s, d: A.scan_table(events(s, d), "value", ["event_id"], "event_type"),
    "anomaly_isolation_forest_lineitem": lambda s, d: detect_isolation_forest(
        table(s, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount", "l_tax"], LINE_KEY),
    "anomaly_sweep_all_tables": lambda s, d: A.sweep({n: table(s, d, n) for n in METRICS}, KEYS, "IQR"),
    "anomaly_sweep_all_methods": lambda s, d: A.sweep({n: table(s, d, n) for n in METRICS}, KEYS),
}

LINE_METRICS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
ORACLE = {
    "anomaly_scan_all_methods": all_methods_sql(*EVENT),
    "anomaly_isolation_forest_lineitem": forest_sql("lineitem", LINE_METRICS, LINE_ID, f"'Row ' || {LINE_ID}"),
    "anomaly_sweep_all_methods": sweep_sql(KEYS, METRICS, all_methods_sql),
    "anomaly_sweep_all_tables": sweep_sql(KEYS, METRICS),
    "anomaly_zscore_events": EVENTS_ZSCORE,
    "anomaly_iqr_events": EVENTS_IQR,
    "anomaly_iqr_documents": iqr_sql("documents", "n_chars", "CAST(doc_id AS VARCHAR)", "'Row ' || doc_id"),
    "anomaly_rolling_events": rolling_sql(*EVENT, "ts, event_id"),
    "anomaly_rolling_lineitem": rolling_sql(
        "lineitem", "l_extendedprice", LINE_ID, f"'Row ' || {LINE_ID}", "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"),
    "anomaly_rolling_per_supplier": rolling_sql(
        "lineitem", "l_extendedprice", LINE_ID, "CAST(l_suppkey AS VARCHAR)",
        "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey", "l_suppkey"),
    "anomaly_scan_severities": f"""SELECT count(*) AS total_anomalies,
        count(*) FILTER (WHERE severity = 'LOW') AS low_count, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_count,
        count(*) FILTER (WHERE severity = 'HIGH') AS high_count, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count
      FROM (({EVENTS_ZSCORE}) UNION ALL ({EVENTS_IQR}))""",
    "anomaly_scan_top": f"""SELECT * FROM (({EVENTS_ZSCORE}) UNION ALL ({EVENTS_IQR}))
      ORDER BY score DESC, method, row_id LIMIT 100""",
}
