"""Distances of distributions, stored baselines, versioned stores, and the forest's draw."""

import math
from itertools import combinations
from threading import Thread

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesight.functions import sketches
from lakesight.functions.masking import mask_sensitive_fields
from lakesight.functions.stats import ks_exact_p_value, ks_p_value
from lakesight.operators import data_drift, distribution, isolation_forest
from lakesight.operators.catalog import TableInfo
from lakesight.sources import sinks
from lakesight.sources.store import VersionedStore


def frame(spark, columns):
    return spark.createDataFrame([(n, float(v), 1) for n, values in columns.items() for v in values], "column_name string, value double, n long")


def plain_ks(a, b):
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return max(abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)))


@pytest.mark.parametrize("cells", [distribution.CELLS, 64, 8])
def test_ks_by_refining_is_exact(spark, cells):
    r = np.random.default_rng(5)
    old = {"near": r.normal(size=3000), "far": r.normal(size=500), "tail": np.exp(r.normal(size=800) * 40), "few": r.integers(0, 5, 900),
           "same": r.random(400), "one": [7.0] * 9, "ends": [-math.inf, 1, 2, math.inf, math.inf], "wide": [-1e308, 1e308, 3], "gone": [1.0]}
    new = {"near": r.normal(size=2000), "far": r.normal(2, size=700), "tail": np.exp(r.normal(size=900) * 40 + 3), "few": r.integers(0, 6, 700),
           "same": old["same"], "one": [7.0] * 4, "ends": [-math.inf, -math.inf, 1, 3, math.inf], "wide": [-1e308, 2, 1e308], "new": [1.0]}
    got = {x.column_name: x for x in distribution.ks_statistics(frame(spark, old), frame(spark, new), cells).collect()}
    assert set(got) == set(old) & set(new)
    for name, x in got.items():
        assert math.isclose(x.ks, plain_ks(old[name], new[name]), abs_tol=1e-12), name
        assert (x.size_b, x.size_c) == (len(old[name]), len(new[name]))


@pytest.mark.parametrize("cells, few_rows", [(distribution.CELLS, distribution.FEW_ROWS), (distribution.CELLS, 0), (256, 0), (8, 0)])
@pytest.mark.parametrize("stored", [False, True])
def test_ks_of_tables_is_exact(spark, cells, few_rows, stored):
    """Columns of tables with nulls, NaN and infinities; the ends are known, or not, or one side is stored counts."""
    r, odd = np.random.default_rng(8), [None, math.nan, math.inf, -math.inf]
    draw = lambda n, shift: [{"a": float(r.normal(shift)), "b": int(r.integers(0, 7)), "c": odd[i] if i < 4 else float(np.exp(r.normal() * 30)), "d": None}
                             for i in range(n)]
    rows = draw(2500, 0), draw(1800, 0.02)
    old, new = (spark.createDataFrame(x, "a double, b int, c double, d double") for x in rows)
    baseline = data_drift.value_counts(old) if stored else distribution.Values(old, old.columns, {"a": (2500, *[f(x["a"] for x in rows[0]) for f in (min, max)])})
    got = {x.column_name: x for x in distribution.ks_statistics(baseline, distribution.Values(new, new.columns), cells, few_rows).collect()}
    assert set(got) == {"a", "b", "c"}
    for name, x in got.items():
        a, b = ([y[name] for y in side if y[name] is not None and not math.isnan(y[name])] for side in rows)
        assert math.isclose(x.ks, plain_ks(a, b), abs_tol=1e-12), name
        assert (x.size_b, x.size_c) == (len(a), len(b))


def test_first_grid_leaves_few_rows(spark):
    """Of two samples of one distribution, the first grid closes most cells, so that the next scan keeps few rows."""
    r = np.random.default_rng(2)
    old, new = (spark.createDataFrame([(float(x),) for x in r.random(40_000)], "v double") for _ in range(2))
    columns = [distribution._Column("v", 0.0, 1.0, 40_000, 40_000)]
    sides = [distribution.Values(df, ["v"]) for df in (old, new)]
    _, inside = distribution._refined(distribution._both(*sides, columns, distribution.FIRST_BITS), columns, distribution.FIRST_BITS, 0)
    assert inside < 4_000


def test_ks_of_counts_and_of_no_rows(spark):
    counted = frame(spark, {"c": [1, 2, 2, 3]}).groupBy("column_name", "value").agg(F.sum("n").alias("n"))
    assert distribution.ks_statistics(counted, frame(spark, {"c": [2, 2, 5, 5]})).first().ks == 0.5
    assert distribution.ks_statistics(counted.limit(0), counted).count() == 0


def test_exact_p_against_all_orders(spark):
    rows = []
    for n in range(1, 8):
        for m in range(1, 8):
            gaps = []
            for places in combinations(range(n + m), n):
                i = best = 0
                for s in range(n + m):
                    i += s in places
                    best = max(best, abs(i * m - (s + 1 - i) * n))
                gaps.append(best)
            for edge in {min(gaps), sorted(gaps)[len(gaps) // 2], max(gaps)}:
                rows.append((edge / (n * m), n, m, sum(g >= edge for g in gaps) / len(gaps)))
    df = spark.createDataFrame(rows, "d double, n long, m long, want double").withColumn("got", ks_exact_p_value(F.col("d"), F.col("n"), F.col("m")))
    assert all(math.isclose(x.got, x.want, abs_tol=1e-9) for x in df.collect())


def test_p_is_exact_for_few_values_and_asymptotic_for_many(spark):
    df = spark.createDataFrame([(0.3, 20, 30), (0.03, 2000, 3000), (0.0, 5, 5)], "d double, n long, m long")
    few, many, none = [r.p for r in df.select(ks_p_value(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    assert math.isclose(few, 0.19, abs_tol=0.03) and 0.1 < many < 0.3 and none == 1.0


def test_sketch_distance_is_within_its_error_and_slices_merge(spark):
    r = np.random.default_rng(8)
    old, new = r.normal(size=40_000), r.normal(0.2, size=30_000)
    as_df = lambda values: spark.createDataFrame([(float(v),) for v in values], "x double")
    parts = [sketches.sketched(as_df(p)) for p in np.array_split(old, 3)]
    whole = sketches.merged(*parts)
    found = sketches.ks_of_sketches(whole, sketches.sketched(as_df(new))).first()
    assert whole.first().n == 40_000 and abs(found.ks - plain_ks(old, new)) <= found.ks_error < 0.01
    assert len(whole.first().sketch) < 150_000


def test_approximate_quantiles_keep_their_error(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    got = sketches.approximate_quantiles(df, {"v": F.col("v"), "none": F.lit(None).cast("double")}, (0.1, 0.5, 0.99), error=0.005)
    assert all(abs(v / 50_000 - p) <= 0.006 for p, v in got["v"].items()) and got["none"] == {}
    with pytest.raises(ValueError):
        sketches.k_for(1e-9)


def test_baseline_size_does_not_grow_with_rows(spark, tmp_path):
    sizes = []
    for rows in (20_000, 200_000):
        df = spark.range(rows).select(F.rand(3).alias("v"))
        sinks.save_baseline(df, "d", f"t{rows}", str(tmp_path))
        stats, stored = sinks.load_baseline(spark, "d", f"t{rows}", str(tmp_path))
        assert stats.first().sample_size == rows and "error" in stored.columns
        sizes.append(len(stored.first().sketch))
    assert sizes[1] < 1.5 * sizes[0]


def test_verdict_near_a_threshold_says_so(spark, tmp_path):
    old = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    sinks.save_baseline(old, "d", "t", str(tmp_path), k=64)
    stored = sinks.load_baseline(spark, "d", "t", str(tmp_path))
    near = data_drift.compare_with_stored(*stored, old.select((F.col("v") + 1500).alias("v"))).first()
    assert "within the sketches' error" in near.summary and near.ks_error > 0.05
    far = data_drift.compare_with_stored(*stored, old.select((F.col("v") + 8000).alias("v"))).first()
    assert far.drift_detected and "within" not in far.summary


def test_columns_of_an_older_baseline_are_kept(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    sinks.save_baseline(df, "d", "t", str(tmp_path))
    sinks.save_baseline(df.select((F.col("a") + 1).alias("a")), "d", "t", str(tmp_path))
    stats, stored = sinks.load_baseline(spark, "d", "t", str(tmp_path))
    assert {r.column_name: r.min_val for r in stats.collect()} == {"a": 1.0, "b": 0.0}
    assert sorted(r.column_name for r in stored.collect()) == ["a", "b"]


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    assert store.read("a") is None and store.read_all("a") is None
    assert store.commit(lambda number, last: {"a": spark.range(3), "b": spark.range(1)}) == 1
    broken = spark.range(2).select(F.raise_error(F.lit("disk")).alias("id"))
    with pytest.raises(Exception, match="disk"):
        store.commit(lambda number, last: {"a": spark.range(9), "b": broken})
    assert store.versions() == [1] and store.read("a").count() == 3
    assert store.commit(lambda number, last: {"a": spark.range(number)}) == 2
    assert store.read("a").count() == 2 and store.read("a", 1).count() == 3 and store.read_all("a").count() == 5 and store.read("b") is None


def test_writers_at_the_same_time_get_different_numbers(spark, tmp_path):
    catalog, taken = {"t": TableInfo(spark.range(3).toDF("k"), ["k"])}, []
    writers = [Thread(target=lambda: taken.append(sinks.append_schema_snapshot(catalog, "db", str(tmp_path)))) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(taken) == [1, 2, 3, 4]
    assert sorted(r.taken for r in sinks.read_history(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


# isolation forest

def test_one_row_repeated_fills_every_tree(spark):
    points = spark.range(100_000).select(F.lit("same").alias("_id"), F.lit(1.0).alias("_x0")).union(
        spark.range(2000).select(F.col("id").cast("string"), F.col("id").cast("double")))
    per_tree = isolation_forest.dealt(points, ["_x0"], 102_000, 20, 256).groupBy("tree").count().collect()
    assert len(per_tree) == 20 and all(r["count"] == 256 for r in per_tree)


@pytest.mark.parametrize("rows", [50, 639, 641, 5000])
def test_the_pool_is_the_smallest_hashes_at_every_size(spark, rows):
    import hashlib

    points = spark.range(rows).select(F.col("id").cast("string").alias("_id"), F.col("id").cast("double").alias("_x0"))
    got = {r["_id"] for r in isolation_forest.pool(points, ["_x0"], rows, 640).collect()}
    digest = lambda i: hashlib.md5(f"{isolation_forest.SEED}|{i}".encode()).hexdigest()
    assert got == {str(i) for i in sorted(range(rows), key=digest)[:640]}


def test_trees_and_rows_are_arguments(spark):
    df = spark.range(400).select("id", F.when(F.col("id") == 7, 1e6).otherwise(F.col("id") % 20).cast("double").alias("v"))
    found = isolation_forest.detect_isolation_forest(df, ["v"], ["id"], trees=20, per_tree=64)
    assert "7" in {r.row_id for r in found.collect()}


# masking

def test_secrets_in_any_nesting_are_masked(spark):
    df = spark.sql("""SELECT map('db', named_struct('password', 'p1', 'host', 'h')) AS a, array(named_struct('token', 't1', 'n', 1)) AS b,
        map('x', map('token', 's1', 'ok', 'v')) AS c, map('password', array('p2', 'p3')) AS d, map(1, 'k') AS secret,
        array(map('conn_url', 'db://u:pw@h', 'z', 'y')) AS e, map('auth', map('inner', 'v2')) AS f,
        parse_json('{"x": [{"api_key": "k1", "n": 1.50}], "passwords": ["p4"], "conn_url": "db://u:pw@h"}') AS v,
        named_struct('v', parse_json('"plain"')) AS w, CAST(NULL AS array<struct<password: string>>) AS n""")
    got = mask_sensitive_fields(df).select("a", "b", "c", "d", "secret", "e", "f", F.to_json("v").alias("v"), F.to_json("w.v").alias("w"), "n").first()
    star = "********"
    assert got.a["db"].password == star and got.a["db"].host == "h" and got.b[0].token == star and got.b[0].n == 1
    assert got.c == {"x": {"token": star, "ok": "v"}} and got.d == {"password": [star, star]} and got.secret == {1: star}
    assert got.e == [{"conn_url": "db://u:****@h", "z": "y"}] and got.f == {"auth": {"inner": "v2"}} and got.n is None
    assert "k1" not in got.v and "p4" not in got.v and "db://u:****@h" in got.v and got.w == '"plain"'
    with pytest.raises(ValueError):
        mask_sensitive_fields(spark.sql("SELECT array(parse_json('1')) AS a"))
