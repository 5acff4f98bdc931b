"""Isolation forest (Liu, Ting and Zhou 2008) as a Spark job.

The rows of the trees are drawn by one rule at every size: the rows with the
smallest hashes are the pool, and each tree takes the rows of the pool with the
smallest hashes of its own. All trees grow together, a level per round, with
features and cut points drawn from a hash of seed, tree and node, so every
engine that can hash grows the same forest. All trees together are a node table
of bounded size, which scores every row of the table in Arrow batches. The
threshold is an exact quantile of the scores of all rows.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesight.functions import columns as C
from lakesight.functions.summary import exact_quantiles, summarise
from lakesight.operators.anomaly import MIN_ROWS, NORMAL_SIGMAS, _label, anomalies, row_id
from lakesight.session import materialise, small_frame

# Send these functions to the Python workers by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Forest size, contamination bounds and severity cut.
TREES = 100
ROWS_PER_TREE = 256
CONTAMINATION = 0.03
MIN_CONTAMINATION, MAX_CONTAMINATION = 0.01, 0.5
HIGH_SCORE = 0.15
SCORE_SCALE = 10
SEED = 42

PATH_UNIT = 1_000_000  # path lengths are whole numbers of this part, so that their sums do not depend on an order
SPREAD_BELOW = 5_000_000
_EULER = 0.5772156649015329


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def levels(per_tree: int) -> int:
    """Depth at which trees of ``per_tree`` rows end."""
    return max(1, math.ceil(math.log2(max(per_tree, 2))))


def _hash(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _uniform(*parts: str | int) -> float:
    """A number in [0, 1): the first 52 bits of a hash."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def pool(points: DataFrame, features: Sequence[str], n: int, size: int) -> DataFrame:
    """The ``size`` rows with the smallest hashes of their names (all, if fewer), with ``_copy`` numbering rows that are equal.

    Only rows below a bound are counted; the bound starts where twice as many
    rows as needed are expected, and rises until there are enough, so that
    rows that repeat neither crowd others out nor leave the pool short. Equal
    rows are one row with a count before anything is shuffled.
    """
    columns = ["_id", *features]
    hashed = points.select(_hash(SEED, F.col("_id")).alias("_h"), *columns)
    share = 2.0 * size / max(n, 1)
    while True:
        near = hashed.filter(F.col("_h") < f"{int(share * 16**13):013x}") if share < 1 else hashed
        counted = materialise(near.groupBy("_h", *columns).agg(F.count("*").alias("_n")))
        if share >= 1 or (counted.agg(F.sum("_n")).first()[0] or 0) >= size:
            break
        share *= 8
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_h", *columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = counted.withColumn("_left", size - before).filter("_left > 0")
    return kept.select(*columns, F.explode(F.sequence(F.lit(1), F.least("_n", "_left").cast("int"))).alias("_copy"))


def dealt(points: DataFrame, features: Sequence[str], n: int, trees: int, per_tree: int) -> DataFrame:
    """(tree, _x): for each tree the rows of the common pool of ``trees * per_tree`` with the smallest hashes of tree and row."""
    drawn = pool(points, features, n, trees * per_tree).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = [_hash(F.col("tree"), F.col("_id"), F.col("_copy")), F.col("_id"), *map(F.col, features), F.col("_copy")]
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    return ranked.filter(F.col("_r") <= per_tree).select("tree", F.array(*features).alias("_x"))


def fit(points: DataFrame, features: Sequence[str], n: int, trees: int = TREES, per_tree: int = ROWS_PER_TREE) -> pd.DataFrame:
    """The forest's node table (tree, node, feature, threshold, rows, depth): at most ``trees * (2 * per_tree - 1)`` rows.

    The children of node k are 2k and 2k + 1; leaves have feature -1. A round
    per level counts rows and ranges of all open nodes of all trees; a node's
    feature and cut follow from its ranges and a hash, and rows move on by a
    join with these cuts, at most one per drawn row.
    """
    per_tree = min(per_tree, n)
    limit, d = levels(per_tree), len(features)
    x, nodes = F.col("_x"), []
    rounds = [dealt(points, features, n, trees, per_tree).withColumn("node", F.lit(1)).persist()]
    try:
        for depth in range(limit + 1):
            ranges = [f(x[i]).alias(f"{f.__name__}{i}") for i in range(d) for f in (F.min, F.max)]
            cuts = []
            for tree, node, count, *ends in rounds[-1].groupBy("tree", "node").agg(F.count("*").alias("n"), *ranges).collect():
                can = [i for i in range(d) if ends[2 * i + 1] > ends[2 * i]]
                if depth == limit or count <= 1 or not can:
                    nodes.append((tree, node, -1, 0.0, count, depth))
                    continue
                feature = can[int(_uniform(SEED, "feature", tree, node) * len(can))]
                low, high = ends[2 * feature : 2 * feature + 2]
                cut = low + _uniform(SEED, "cut", tree, node) * (high - low)
                cuts.append((tree, node, feature, cut if cut < high else low))  # the sum may round up to the upper end
                nodes.append((*cuts[-1], count, depth))
            if not cuts:
                break
            known = F.broadcast(small_frame(points.sparkSession, cuts, "tree int, node int, feature int, threshold double"))
            child = 2 * F.col("node") + (F.get("_x", F.col("feature")) > F.col("threshold")).cast("int")
            rounds.append(rounds[-1].join(known, ["tree", "node"]).select("tree", "_x", child.alias("node")).persist())
    finally:
        for r in rounds:
            r.unpersist()
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "rows", "depth"])


def score(rows: DataFrame, features: Sequence[str], nodes: pd.DataFrame, per_tree: int, n: int, trees: int = TREES) -> DataFrame:
    """Add ``raw``: 2 ** (-mean path / expected path), nearer 1 for easily isolated rows."""
    names, depth = list(features), levels(per_tree)
    shape = (trees, 2 << depth)
    feature, threshold, path = np.full(shape, -1), np.zeros(shape), np.zeros(shape, dtype=np.int64)
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    feature[at], threshold[at] = nodes["feature"], nodes["threshold"]
    path[at] = [round((d + mean_path(k)) * PATH_UNIT) for d, k in zip(nodes["depth"], nodes["rows"])]
    shared = rows.sparkSession.sparkContext.broadcast((feature, threshold, path))
    expected = mean_path(per_tree) * PATH_UNIT * trees

    def add_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            at_row = np.arange(len(x))
            total = np.zeros(len(x), dtype=np.int64)
            for own, cuts, paths in zip(*shared.value):
                node = np.ones(len(x), dtype=np.int64)
                for _ in range(depth):
                    f = own[node]
                    node = np.where(f < 0, node, 2 * node + (x[at_row, np.maximum(f, 0)] > cuts[node]))
                total += paths[node]
            yield batch.assign(raw=np.power(2.0, -total / expected))

    spark = rows.sparkSession
    if n <= SPREAD_BELOW:  # a small table may sit in one file; scoring is the costly part
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    schema = T.StructType([*rows.schema.fields, T.StructField("raw", T.DoubleType())])
    return rows.mapInPandas(add_score, schema)


def detect_isolation_forest(
    df: DataFrame, metrics: Sequence[str], keys: Sequence[str], entity: str | None = None,
    contamination: float = CONTAMINATION, trees: int = TREES, per_tree: int = ROWS_PER_TREE,
) -> DataFrame:
    """The ``contamination`` share of rows that are isolated most easily over all metrics.

    Value, range and deviation are reported for the first metric. The forest
    has ``trees`` trees of ``per_tree`` rows, drawn from all rows by hash.
    """
    metrics = [m for m in metrics if m in C.numeric_columns(df)]
    features = [f"_x{i}" for i in range(len(metrics))]
    rows = df.select(
        row_id(keys).alias("row_id"),
        _label(entity, keys).alias("entity"),
        *[C.finite(df, m).alias(x) for m, x in zip(metrics, features)],
    ).dropna(subset=features)
    summary = summarise(rows, {"x": F.col("_x0")})[0]["x"] if metrics else None
    n = summary.count if summary else 0
    if n < MIN_ROWS:
        empty = df.select(row_id(keys).alias("row_id"), _label(entity, keys).alias("entity"), F.lit(0.0).alias("v")).limit(0)
        zero = F.lit(0.0)
        return anomalies(empty, ", ".join(metrics), "ISOLATION_FOREST", F.col("v"), zero, zero, zero, zero, F.lit(""), F.lit(""))
    if n * contamination < 1:
        contamination = max(1.0 / n, MIN_CONTAMINATION)
    contamination = min(contamination, MAX_CONTAMINATION)

    per_tree = min(per_tree, n)
    nodes = fit(rows.withColumnRenamed("row_id", "_id"), features, n, trees, per_tree)
    # written once: the threshold and the detections must see the same scores
    scored = materialise(
        score(rows, features, nodes, per_tree, n, trees).select("row_id", "entity", F.col("_x0").alias("v"), "raw")
    )
    threshold = exact_quantiles(scored, F.col("raw"), (1 - contamination,))[1 - contamination]
    margin = F.col("raw") - threshold
    spread = summary.std or 0.0
    low, high = F.lit(summary.mean - NORMAL_SIGMAS * spread), F.lit(summary.mean + NORMAL_SIGMAS * spread)
    text = F.format_string("isolated easily over %s (score %.3f); first value %.1f", F.lit(", ".join(metrics)), margin, F.col("v"))
    return anomalies(
        scored.filter(margin > 0), ", ".join(metrics), "ISOLATION_FOREST", F.col("v"), low, high, F.lit(summary.mean),
        margin * SCORE_SCALE, F.when(margin > HIGH_SCORE, "HIGH").otherwise("MEDIUM"), text,
    )
