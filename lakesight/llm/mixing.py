"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents form a shuffled stream of words, repeated as often as
its target asks and cut into blocks of equal numbers of words. The schedule's
slots are the van der Corput points m / 2^bits: the sources own consecutive
ranges of m, as wide as their number of blocks (the cumulative weights), and
the time of a point is its bit reversal, so every source's slots are spread
evenly over the schedule. A slot's rank among its source's slots is counted
from the bits alone, and slot r takes the source's block r.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesight.llm.common import WORD, own_names, with_package
from lakesight.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 2048
BUCKET_DOCUMENTS = 4096
SLOTS_PER_ROW = 1 << 16


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = MAX_REPEATS) -> DataFrame:
    """(no, _source, source_size, weight, target) per source of ``sized`` (_source, _size).

    Sources by code point, null last, take the weights in turn. Targets share
    the total by weight; one above ``repeats`` times its source's size stops
    there and the excess is shared anew among the others, until none is above.
    The rounds see a row per source; only their sums reach the driver.
    """
    order = Window.orderBy(F.col("_source").isNull(), F.col("_source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialise(
        sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
        .withColumn("no", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("weight", F.element_at(cycle, (F.col("no") % len(weights) + 1).cast("int")))
    )
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    full = F.lit(False)
    share = 0.0
    stopped = -1
    while True:
        at_limit, weight, number = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * repeats)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        share = (total - at_limit) / weight if weight else 0.0
        if number == stopped or not weight:
            break
        stopped = number
        full = full | (F.col("weight") * F.lit(share) > F.col("source_size") * repeats)
    target = F.when(full, F.col("source_size") * float(repeats)).otherwise(F.col("weight") * F.lit(share))
    return sources.withColumn("target", target.cast("double"))


def rank_in_schedule(low: np.ndarray, high: np.ndarray, time: np.ndarray, bits: int) -> np.ndarray:
    """How many points m in [low, high) have a bit reversal (of ``bits`` bits) below ``time``.

    Times below ``time`` fall into blocks: one per set bit t, whose times share
    the bits above t and leave t bits free. Their points are m = r mod 2^(bits - t)
    with r the reversal of the fixed bits, so they are counted by a division.
    """
    out = np.zeros(len(time), dtype=np.int64)
    fixed = np.zeros(len(time), dtype=np.int64)
    for t in range(bits - 1, -1, -1):
        has = time >> t & 1 == 1
        step = np.int64(1) << (bits - t)
        up_to = lambda x, r=fixed, s=step: np.maximum(0, (x - r + s - 1) // s)  # noqa: E731  points r, r + s, ... below x
        out += np.where(has, up_to(high) - up_to(low), 0)
        fixed |= np.where(has, np.int64(1) << (bits - 1 - t), 0)
    return out


def reversed_bits(m: np.ndarray, bits: int) -> np.ndarray:
    out, m = np.zeros_like(m), m.copy()
    for _ in range(bits):
        out = out << 1 | m & 1
        m >>= 1
    return out


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(no, rank, slot): the source's block ``rank`` stands at place ``slot`` of the mix. Needs no and target."""
    owned = sources.withColumn("blocks", F.ceil(F.round("target") / F.lit(block_words)).cast("long"))
    order = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    owned = materialise(owned.withColumn("high", F.sum("blocks").over(order)).select("no", "blocks", "high"))
    total = owned.agg(F.coalesce(F.max("high"), F.lit(0))).first()[0]
    bits = max(1, int(total).bit_length())
    pieces = owned.where("blocks > 0").select(
        "no", (F.col("high") - F.col("blocks")).alias("low"), "high",
        F.explode(F.sequence(F.col("high") - F.col("blocks"), F.col("high") - 1, F.lit(SLOTS_PER_ROW).cast("long"))).alias("at"))

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for no, low, high, at in frame.itertuples(index=False):
                m = np.arange(at, min(high, at + SLOTS_PER_ROW), dtype=np.int64)
                slot = reversed_bits(m, bits)
                rank = rank_in_schedule(np.full(len(m), low), np.full(len(m), high), slot, bits)
                yield pd.DataFrame({"no": no, "rank": rank, "slot": slot})

    return with_package(pieces).repartition("no", "at").mapInPandas(mapped, "no long, rank long, slot long")


def _streams(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``sized`` with its source's numbers and the document's first word in its source's shuffled stream.

    A source's documents are dealt to buckets by their shuffle key. Sums over a
    source's buckets and sums within a bucket give the first word, so that no
    source is ever sorted in one task.
    """
    joined = sized.join(sources.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    number = sized.count()
    buckets = max(1, -(-number // BUCKET_DOCUMENTS))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("")), "_digest"))
    dealt = joined.withColumn("_key", key).withColumn(
        "_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long"))
    dealt = materialise(dealt)
    before = Window.partitionBy("no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("no", "_bucket").agg(F.sum("_size").alias("n")).select(
        "no", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("no", "_bucket").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(firsts, ["no", "_bucket"]).withColumn(
        "_start", F.col("_first") + F.col("_inside")).drop("_first", "_inside", "_bucket", "_key")


def mixed_blocks(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 7, row: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). ``row`` names a column that numbers the rows; without it they get numbers of their own.

    Documents: _row, _id, _size, source_size, target, one row per row of ``docs``.
    Pieces: _row, slot, first, last: the words [first, last) of a document that
    the slot takes; in order of slot and place they are the mix.
    """
    sized = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), F.col(f"`{id}`").alias("_id"), F.col(f"`{source}`").alias("_source"),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_digest"), sizes(docs, text).alias("_size"))
    sized = materialise(sized)
    sources = materialise(targets(sized, weights, repeats))
    streams = materialise(_streams(sized, sources, seed))
    # the stream is repeated as often as the target asks; each repeat of a document meets the blocks it overlaps
    goal = F.round("target").cast("long")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_round")
    placed = streams.where("_size > 0").select("*", rounds).withColumn("_from", F.col("_start") + F.col("_round") * F.col("source_size"))
    placed = placed.where(F.col("_from") < goal).withColumn("_to", F.least(F.col("_from") + F.col("_size"), goal))
    size = F.lit(block_words).cast("long")
    overlap = placed.withColumn("rank", F.explode(F.sequence(
        F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))))
    pieces = overlap.join(schedule(sources, block_words), ["no", "rank"]).select(
        "_row", "slot", "_from",
        (F.greatest(F.col("_from"), F.col("rank") * size) - F.col("_from")).alias("first"),
        (F.least(F.col("_to"), (F.col("rank") + 1) * size) - F.col("_from")).alias("last"))
    return streams.select("_row", "_id", "_size", "source_size", "target"), pieces


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """(id, size, source_size, target, taken) per row of ``docs``: the words the mix takes of it, repeats counted.

    A source's words add up to its rounded target, and no document gives more
    than ``repeats`` times its size. Defined cases: null texts have no words and
    give none; null is a source of its own, the last; repeated rows each take
    their place in the stream.
    """
    documents, pieces = mixed_blocks(docs, **options)
    taken = pieces.groupBy("_row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return documents.join(taken, "_row", "left").select(
        F.col("_id").alias(options.get("id", "doc_id")), F.col("_size").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@own_names([], "id", "text", "source")
def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Rows of ``docs`` as often as the mix begins them: whole documents, for stages that need them whole."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    # the numbers are written with the rows, so that every later scan sees the same ones
    numbered = materialise(docs.withColumn("_mix_row", F.monotonically_increasing_id()))
    _, pieces = mixed_blocks(numbered, id=id, text=text, source=source, row="_mix_row", **options)
    times = pieces.where("first = 0").groupBy("_row").agg(F.count("*").cast("int").alias("_times"))
    return numbered.join(times.withColumnRenamed("_row", "_mix_row"), "_mix_row").withColumn(
        "_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*names)
