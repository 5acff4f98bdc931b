"""Sources, sinks, samples, masking and sanitising on whole tables."""

from pyspark.sql import functions as F

from checks.common import rounded, table
from checks.catalogs import COLUMNS, KEYS, whole
from lakesight.functions.columns import finite, sanitise, wall_time
from lakesight.functions.sketches import K as SKETCH_SIZE, POINTS, rank_error
from lakesight.functions.masking import mask_secret, mask_sensitive_fields, mask_urls
from lakesight.operators import catalog as K
from lakesight.operators import data_drift as D
from lakesight.operators.profile import numeric_profile
from lakesight.session import scratch_folder
from lakesight.sources import files, sampling, sinks
from checks.drifts import DRIFT, halves


def parquet_views(spark, folder):
    """Row count of every dataset found in the data folder."""
    return K.table_counts({n: K.TableInfo(df) for n, df in files.register_files(spark, folder).items()})


def csv_views(spark, folder):
    """customer and orders written as CSV, registered with inferred types, and joined by SQL."""
    target = scratch_folder(spark)
    sinks.write_csv(table(spark, folder, "customer"), f"{target}/Csv-Customer.csv")
    sinks.write_csv(table(spark, folder, "orders"), f"{target}/csv orders.csv")
    files.register_files(spark, target, "csv")
    return spark.sql("""SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue,
        max(o_orderdate) AS latest FROM csv_orders JOIN csv_customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")


def odd_numbers(spark, folder):
    """events with NaN and infinite values."""
    third = F.col("event_id") % 9
    return table(spark, folder, "events").withColumn(
        "value",
        F.when(third == 0, float("nan")).when(third == 1, float("inf")).when(third == 2, float("-inf")).otherwise(F.col("value")))


def json_sink(spark, folder):
    """Nested events with NaN and infinities, written as JSON and read back."""
    df = odd_numbers(spark, folder).select(
        "event_id", "ts", F.array("value", F.col("value") * 2).alias("pair"), F.struct("value", "event_type").alias("inner"))
    target = scratch_folder(spark)
    sinks.write_json(df, target)
    back = spark.read.schema("event_id bigint, ts string, pair array<double>, inner struct<value:double,event_type:string>").json(target)
    return back.select(
        "event_id", "ts", F.col("pair")[0].alias("first"), F.col("pair")[1].alias("second"),
        F.col("inner.value").alias("inner_value"), F.col("inner.event_type").alias("event_type"))


def stored_drift(spark, folder):
    """Baseline of the old half saved with all its values, loaded again, and compared with the new half."""
    current, old = halves(spark, folder)
    store = scratch_folder(spark)
    sinks.save_baseline(table(spark, folder, "orders"), "sales", "orders", store, exact=True)
    sinks.save_baseline(old, "sales", "lineitem", store, exact=True)
    return D.compare_with_stored(*sinks.load_baseline(spark, "sales", "lineitem", store), current)


def sketched_drift(spark, folder):
    """The same with a baseline of sketches; which columns have drifted, and how much, beyond the sketches' error."""
    current, old = halves(spark, folder)
    store = scratch_folder(spark)
    sinks.save_baseline(old, "sales", "lineitem", store)
    found = D.compare_with_stored(*sinks.load_baseline(spark, "sales", "lineitem", store), current)
    return found.select("column_name", "drift_detected", "severity", "mean_shift_pct", "ks_error")


def secrets(spark, folder):
    """Connection strings and keyed secrets built from customers."""
    c = table(spark, folder, "customer")
    return c.select(
        "c_custkey",
        F.format_string("postgresql://%s:pw%d@db%d:5432/main", F.col("c_mktsegment"), F.col("c_custkey"), F.col("c_nationkey")).alias("conn_url"),
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("api_token"),
        F.struct(F.col("c_name").alias("password"), F.col("c_acctbal").alias("metric")).alias("nested"),
        F.create_map(F.lit("auth"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("more"),
        F.create_map(F.lit("db"), F.struct(F.col("c_name").alias("password"), F.col("c_mktsegment").alias("host"))).alias("map_of_structs"),
        F.array(F.struct(F.col("c_name").alias("api_key"), F.col("c_nationkey").alias("port"))).alias("list_of_structs"),
        F.create_map(F.lit("x"), F.create_map(F.lit("token"), F.col("c_name"), F.lit("url"), F.col("c_mktsegment"))).alias("map_of_maps"),
        F.create_map(F.lit("password"), F.array("c_name", "c_mktsegment"), F.lit("names"), F.array("c_name")).alias("map_of_lists"),
        F.parse_json(F.to_json(F.struct(F.struct(F.col("c_name").alias("secret"), F.col("c_acctbal").alias("n")).alias("inner")))).alias("variant"),
    )


def masked_secrets(spark, folder):
    raw = secrets(spark, folder)
    return mask_sensitive_fields(raw).select(
        "c_custkey", "conn_url", "api_token", F.col("nested.password").alias("nested_password"), F.col("nested.metric").alias("nested_metric"),
        F.col("more")["auth"].alias("map_auth"), F.col("more")["segment"].alias("map_segment"),
        F.col("map_of_structs")["db"]["password"].alias("deep_password"), F.col("map_of_structs")["db"]["host"].alias("deep_host"),
        F.col("list_of_structs")[0]["api_key"].alias("listed_key"), F.col("list_of_structs")[0]["port"].alias("listed_port"),
        F.col("map_of_maps")["x"]["token"].alias("deep_token"), F.col("map_of_maps")["x"]["url"].alias("deep_url"),
        F.array_join(F.col("map_of_lists")["password"], ",").alias("listed_passwords"), F.array_join(F.col("map_of_lists")["names"], ",").alias("listed_names"),
        F.variant_get("variant", "$.inner.secret", "string").alias("variant_secret"), F.variant_get("variant", "$.inner.n", "double").alias("variant_number"))


_ODD = """CASE WHEN event_id % 9 = 0 THEN 'nan'::DOUBLE WHEN event_id % 9 = 1 THEN 'inf'::DOUBLE
    WHEN event_id % 9 = 2 THEN '-inf'::DOUBLE ELSE value END"""
_CLEAN = "CASE WHEN event_id % 9 > 2 THEN value END"
_ISO = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END"""

QUERIES = {
    "source_parquet_views": parquet_views,
    "source_csv_views": csv_views,
    "source_bounded_sample": lambda s, d: sampling.bounded_sample(table(s, d, "orders"), ["o_orderkey"], 500),
    "sink_json_sanitised": json_sink,
    "sink_stored_baseline_drift": stored_drift,
    "sink_sketched_baseline_drift": sketched_drift,
    "finite_values_only": lambda s, d: odd_numbers(s, d).select(
        "event_id", finite(odd_numbers(s, d), "value").alias("value")).filter("value is not null"),
    "sanitised_columns": lambda s, d: sanitise(odd_numbers(s, d).drop("props")),
    "dates_from_text": lambda s, d: (lambda df: df.select("o_orderkey", wall_time(df, "d").alias("d")).filter("d is not null"))(
        table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("d"))),
    "masked_urls_in_pages": lambda s, d: table(s, d, "pages").select(
        "page_id", mask_urls(F.regexp_replace("html", "https?://", "http://user:secret@")).alias("html")),
    "masked_urls_in_conversations": lambda s, d: table(s, d, "conversations").select(
        "conv_id", "turn", mask_urls(F.concat(F.lit("see ftp://bot:hunter2@host "), F.col("text"))).alias("text")),
    "masked_secrets": lambda s, d: table(s, d, "customer").select("c_custkey", mask_secret(F.col("c_name")).alias("name"),
                                                                 mask_secret(F.substring("c_name", 1, 2)).alias("short")),
    "masked_sensitive_fields": masked_secrets,
}

ORACLE = {
    "source_parquet_views": "\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, {len(c)} AS column_count, count(*) AS row_count FROM {n}" for n, c in COLUMNS.items()),
    "source_csv_views": f"""SELECT c_mktsegment, count(*) AS orders, {rounded('sum(o_totalprice)', 2)} AS revenue,
        max(o_orderdate) AS latest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "source_bounded_sample": "SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500",
    "sink_json_sanitised": f"""SELECT event_id, {_ISO} AS ts, {_CLEAN} AS first, {_CLEAN} * 2 AS second,
        {_CLEAN} AS inner_value, event_type FROM events""",
    "sink_stored_baseline_drift": DRIFT,
    # no distance of these halves lies near a threshold, so sketches give the same verdicts
    "sink_sketched_baseline_drift": f"""SELECT column_name, drift_detected, severity, mean_shift_pct,
        {rounded(str(2 * rank_error(SKETCH_SIZE) + 2 / POINTS), 4)} AS ks_error FROM ({DRIFT})""",
    "finite_values_only": "SELECT event_id, value FROM events WHERE event_id % 9 > 2",
    "sanitised_columns": f"SELECT event_id, {_ISO} AS ts, user_id, event_type, {_CLEAN} AS value FROM events",
    "dates_from_text": "SELECT o_orderkey, o_orderdate AS d FROM orders WHERE o_orderkey % 3 <> 0",
    "masked_urls_in_pages": """SELECT page_id, regexp_replace(regexp_replace(html, 'https?://', 'http://user:secret@', 'g'),
        '://([^:]+):([^@]+)@', '://\\1:****@', 'g') AS html FROM pages""",
    "masked_urls_in_conversations": """SELECT conv_id, turn, regexp_replace('see ftp://bot:hunter2@host ' || text,
        '://([^:]+):([^@]+)@', '://\\1:****@', 'g') AS text FROM conversations""",
    "masked_secrets": """SELECT c_custkey, left(c_name, 2) || '****' || right(c_name, 1) AS name, '********' AS short FROM customer""",
    "masked_sensitive_fields": """SELECT c_custkey, 'postgresql://' || c_mktsegment || ':****@db' || c_nationkey || ':5432/main' AS conn_url,
        '********' AS api_token, '********' AS nested_password, c_acctbal AS nested_metric, '********' AS map_auth,
        c_mktsegment AS map_segment, '********' AS deep_password, c_mktsegment AS deep_host, '********' AS listed_key, c_nationkey AS listed_port,
        '********' AS deep_token, c_mktsegment AS deep_url, '********,********' AS listed_passwords, c_name AS listed_names,
        '********' AS variant_secret, c_acctbal AS variant_number FROM customer""",
}
