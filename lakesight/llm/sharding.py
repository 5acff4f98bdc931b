"""Sharding by extendible hashing: a bucket over its byte limit splits on one more bit of its documents' hashes.

The directory is found without moving texts: bytes are summed per hash prefix a
little deeper than the average shard needs, these cells are summed up to all
shorter prefixes, and each cell takes the shortest prefix that fits. Cells that
are too large even so are refined alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesight.llm.common import own_names, without
from lakesight.session import materialise

BITS = 60
LIMIT_BYTES = 1 << 20
EXTRA_BITS = 3
RESULT = ["shard", "depth", "n_bytes", "shard_bytes", "shard_documents"]


def _prefix(bits):
    return F.shiftrightunsigned("_hash", F.lit(BITS) - bits) if not isinstance(bits, int) else F.shiftrightunsigned("_hash", BITS - bits)


def hashed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_bytes and the 60-bit hash of id and text; ids alone may repeat or be missing."""
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")), F.lit("|"), digest))
    return without(docs, RESULT).withColumn(
        "n_bytes", F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    ).withColumn("_hash", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))


def directory(keys: DataFrame, limit: int = LIMIT_BYTES) -> tuple[DataFrame, int]:
    """(cells, bits): for each prefix of ``bits`` bits that rows of ``keys`` (_hash, n_bytes) have, its depth.

    A bucket stops splitting when its bytes fit the limit, or when all its rows
    have the same hash, which no further bit can part.
    """
    total = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + EXTRA_BITS)
    above, pending, found = -1, keys, []
    while True:
        cells = materialise(pending.groupBy(_prefix(bits).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.min("_hash").alias("low"), F.max("_hash").alias("high")))
        depths = F.explode(F.sequence(F.lit(above + 1), F.lit(bits))).alias("depth")
        sums = cells.select("cell", depths, "bytes", "low", "high").withColumn("node", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
        fits = sums.groupBy("depth", "node").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        fits = fits.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).select("depth", "node")
        settled = materialise(sums.select("cell", "depth", "node").join(fits, ["depth", "node"]).groupBy("cell").agg(F.min("depth").alias("depth")))
        found.append((settled, bits))
        pending = pending.withColumn("cell", _prefix(bits)).join(cells.join(settled, "cell", "left_anti").select("cell"), "cell", "left_semi").drop("cell")
        if bits == BITS or pending.isEmpty():
            break
        pending, above, bits = materialise(pending), bits, min(BITS, bits + 8)
    deepest = found[-1][1]
    out = None
    for settled, at in found:
        part = settled.select(F.col("cell"), F.lit(at).alias("bits"), "depth")
        out = part if out is None else out.unionByName(part)
    return out, deepest


@own_names(["shard", "depth", "n_bytes", "shard_bytes", "shard_documents"], "id", "text")
def assigned(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` with shard (its hash prefix as 0 and 1), depth, n_bytes, shard_bytes and shard_documents.

    Every shard holds at most ``limit`` bytes, unless a single document (or
    repeats of one row) is larger. Defined cases: null texts have 0 bytes; rows
    without an id are parted by their texts; empty tables give no shards; input
    columns named like a result are replaced.
    """
    rows = hashed(docs, id, text)
    keys = materialise(rows.select("_hash", "n_bytes"))
    cells, _ = directory(keys, limit)
    levels = sorted(r[0] for r in cells.select("bits").distinct().collect())  # a handful of refinements
    placed = rows
    depth = F.lit(None).cast("int")
    for bits in levels:
        part = cells.where(F.col("bits") == bits).select(F.col("cell").alias(f"_cell_{bits}"), F.col("depth").alias(f"_depth_{bits}"))
        placed = placed.withColumn(f"_at_{bits}", _prefix(bits)).join(part, F.col(f"_at_{bits}") == F.col(f"_cell_{bits}"), "left")
        depth = F.coalesce(depth, F.col(f"_depth_{bits}"))
    placed = placed.withColumn("depth", depth).withColumn("_node", F.expr(f"shiftrightunsigned(_hash, {BITS} - depth)"))
    shard = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(_node), depth, '0')"))
    placed = placed.withColumn("shard", shard).drop("_node", *[f"_{n}_{b}" for b in levels for n in ("at", "cell", "depth")])
    shards = None
    for bits in levels:
        at = keys.withColumn("cell", _prefix(bits)).join(cells.where(F.col("bits") == bits), "cell")
        shards = at if shards is None else shards.unionByName(at)
    if shards is None:
        return placed.drop("_hash").withColumn("shard_bytes", F.lit(0).cast("long")).withColumn("shard_documents", F.lit(0).cast("long"))
    node = F.expr(f"shiftrightunsigned(_hash, {BITS} - depth)").alias("node")
    sizes = shards.select("depth", node, "n_bytes").groupBy("depth", "node").agg(
        F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_documents"))
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(node), depth, '0')"))
    sizes = sizes.select(name.alias("shard"), "shard_bytes", "shard_documents")
    return placed.join(sizes, "shard").drop("_hash")


def write_shards(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """One file per shard below ``folder``/shard=<prefix>; the root shard is named "all"."""
    rows = assigned(docs, id, text, limit)
    rows = rows.withColumn("shard", F.when(F.col("shard") == "", "all").otherwise(F.concat(F.lit("b"), F.col("shard"))))
    rows.repartition("shard").write.partitionBy("shard").parquet(folder)
