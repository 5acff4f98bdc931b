"""Profiles of whole tables."""

from checks.common import percent, rounded, table
from lakesight.operators import profile as P

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUMERIC = LINEITEM[:8]
LINEITEM_TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double",
                  "string", "string", "timestamp_ntz"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _base_sql(name, columns, types, categories):
    return _union(
        f"""SELECT {i} AS ordinal, '{c}' AS column_name, '{t}' AS inferred_type, '{k}' AS type_category,
          count(*) AS total_count, count({c}) AS valid_count, count(*) - count({c}) AS null_count,
          {percent(f"(count(*) - count({c}))", "count(*)")} AS null_percentage,
          count(DISTINCT {c}) AS unique_count, count({c}) - count(DISTINCT {c}) AS duplicate_count
        FROM {name}"""
        for i, (c, t, k) in enumerate(zip(columns, types, categories))
    )


def _numeric_sql(name, columns):
    return _union(
        f"""SELECT '{c}' AS column_name, n AS finite_count, {rounded('lo', 4)} AS min, {rounded('hi', 4)} AS max,
          {rounded('mean', 4)} AS mean, {rounded('q2', 4)} AS median, {rounded('coalesce(sd, 0)', 4)} AS std_dev,
          {rounded('coalesce(sk, 0)', 4)} AS skewness, {rounded('q1', 4)} AS p25, {rounded('q2', 4)} AS p50,
          {rounded('q3', 4)} AS p75, {rounded('q95', 4)} AS p95, {rounded('q3 - q1', 4)} AS iqr,
          out AS outliers_count, {percent('out', 'n')} AS outliers_percentage
        FROM (SELECT count({c}) AS n, min({c}) AS lo, max({c}) AS hi, avg({c}) AS mean, stddev_samp({c}) AS sd,
                skewness({c}) AS sk, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2,
                quantile_cont({c}::DOUBLE, 0.75) AS q3, quantile_cont({c}::DOUBLE, 0.95) AS q95 FROM {name}) s,
          LATERAL (SELECT count(*) AS out FROM {name}
            WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) o"""
        for c in columns
    )


def _histogram_sql(name, columns):
    return _union(
        f"""SELECT '{c}' AS column_name, b::INT AS bin, {rounded('lo + b * step', 2)} AS bin_start,
          {rounded('CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * step END', 2)} AS bin_end, count(v) AS count
        FROM (SELECT lo, hi, (hi - lo) / 10 AS step FROM
                (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c})::DOUBLE END AS lo,
                        CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c})::DOUBLE END AS hi FROM {name})) e
        CROSS JOIN range(10) r(b)
        LEFT JOIN (SELECT {c}::DOUBLE AS v FROM {name}) t
          ON (v >= lo + b * step OR b = 0) AND (v < lo + (b + 1) * step OR b = 9)
        GROUP BY b, lo, hi, step"""
        for c in columns
    )


def _top_sql(name, columns):
    return _union(
        f"""SELECT '{c}' AS column_name, rank::INT AS rank, value, n AS count,
          {percent('n', f"(SELECT count({c}) FROM {name})")} AS percentage
        FROM (SELECT left(CAST({c} AS VARCHAR), 100) AS value, count(*) AS n,
                row_number() OVER (ORDER BY count(*) DESC, left(CAST({c} AS VARCHAR), 100)) AS rank
              FROM {name} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""
        for c in columns
    )


def _string_sql(name, columns):
    return _union(
        f"""SELECT '{c}' AS column_name, min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length,
          {rounded(f'avg(length({c}))', 2)} AS average_length,
          count(*) FILTER (WHERE regexp_matches({c}, '^\\s*$')) AS empty_string_count FROM {name}"""
        for c in columns
    )


QUERIES = {
    "profile_base_lineitem": lambda s, d: P.base_profile(table(s, d, "lineitem")),
    "profile_base_documents": lambda s, d: P.base_profile(table(s, d, "documents")),
    "profile_numeric_lineitem": lambda s, d: P.numeric_profile(table(s, d, "lineitem")),
    "profile_numeric_events": lambda s, d: P.numeric_profile(table(s, d, "events")),
    "profile_histogram_lineitem": lambda s, d: P.histogram(table(s, d, "lineitem")),
    "profile_top_values_orders": lambda s, d: P.top_values(
        table(s, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]),
    "profile_top_values_documents": lambda s, d: P.top_values(table(s, d, "documents"), ["text", "lang", "source"]),
    "profile_datetime_orders": lambda s, d: P.datetime_profile(table(s, d, "orders")),
    "profile_months_lineitem": lambda s, d: P.monthly_distribution(table(s, d, "lineitem")),
    "profile_weekdays_lineitem": lambda s, d: P.weekday_distribution(table(s, d, "lineitem")),
    "profile_strings_documents": lambda s, d: P.string_profile(table(s, d, "documents")),
    "profile_strings_pages": lambda s, d: P.string_profile(table(s, d, "pages")),
    "profile_table_customer": lambda s, d: P.profile_table(table(s, d, "customer"), "customer")
        .filter("stat in ('valid_count', 'unique_count', 'finite_count', 'count', 'min_length', 'max_length', "
                "'empty_string_count', 'outliers_count', 'total_rows', 'column_count')"),
}

_CUSTOMER_TEXT = ["c_name", "c_mktsegment"]
_CUSTOMER_NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal"]
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _melted(column, stat, value, source, detail="''"):
    return (f"SELECT 'customer' AS table_name, {column} AS column_name, '{stat}' AS stat, {detail} AS detail, "
            f"CAST({value} AS VARCHAR) AS value FROM ({source})")


def _profile_table_sql():
    base = _base_sql("customer", _CUSTOMER, [""] * 5, [""] * 5)
    numeric = _numeric_sql("customer", _CUSTOMER_NUMERIC)
    text = _string_sql("customer", _CUSTOMER_TEXT)
    parts = [_melted("column_name", s, s, base) for s in ("valid_count", "unique_count")]
    parts += [_melted("column_name", s, s, numeric) for s in ("finite_count", "outliers_count")]
    parts += [_melted("column_name", s, s, text) for s in ("min_length", "max_length", "empty_string_count")]
    parts.append(_melted("column_name", "count", "count", _top_sql("customer", _CUSTOMER), "CAST(rank AS VARCHAR)"))
    parts.append(_melted("column_name", "count", "count", _histogram_sql("customer", _CUSTOMER_NUMERIC),
                         "CAST(bin AS VARCHAR)"))
    parts.append(_melted("CAST(NULL AS VARCHAR)", "total_rows", "n", "SELECT count(*) AS n FROM customer"))
    parts.append(_melted("CAST(NULL AS VARCHAR)", "column_count", "n",
                         "SELECT count(*) AS n FROM (DESCRIBE customer)"))
    return _union(parts)


ORACLE = {
    "profile_base_lineitem": _base_sql("lineitem", LINEITEM, LINEITEM_TYPES,
                                       ["NUMERIC"] * 8 + ["STRING"] * 2 + ["DATETIME"]),
    "profile_base_documents": _base_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"],
                                        ["bigint", "string", "string", "string", "bigint"],
                                        ["NUMERIC", "STRING", "STRING", "STRING", "NUMERIC"]),
    "profile_numeric_lineitem": _numeric_sql("lineitem", LINEITEM_NUMERIC),
    "profile_numeric_events": _numeric_sql("events", ["event_id", "user_id", "value"]),
    "profile_histogram_lineitem": _histogram_sql("lineitem", LINEITEM_NUMERIC),
    "profile_top_values_orders": _top_sql("orders", ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]),
    "profile_top_values_documents": _top_sql("documents", ["text", "lang", "source"]),
    "profile_datetime_orders": """SELECT 'o_orderdate' AS column_name,
        strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS min_date,
        strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS max_date,
        CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000) AS BIGINT) AS timespan_days
        FROM orders""",
    "profile_months_lineitem": """SELECT 'l_shipdate' AS column_name, strftime(l_shipdate, '%Y-%m') AS month,
        count(*) AS count FROM lineitem GROUP BY 2 ORDER BY 2 DESC LIMIT 12""",
    "profile_weekdays_lineitem": """SELECT 'l_shipdate' AS column_name, dayname(l_shipdate) AS weekday,
        count(*) AS count FROM lineitem GROUP BY 2""",
    "profile_strings_documents": _string_sql("documents", ["text", "lang", "source"]),
    "profile_strings_pages": _string_sql("pages", ["url", "html"]),
    "profile_table_customer": _profile_table_sql(),
}
