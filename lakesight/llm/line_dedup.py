"""Reversible, incremental line dedup: sharded cuckoo filters in front of exact reference-count tables.

State in one folder per version, all in Parquet:

    refs      (hi, lo, doc_id)           every document that holds a key, exactly
    counts    (shard, hi, lo, n, top)    documents per key and the largest of them
    filters   (shard, filter)            a cuckoo filter of the shard's keys

Adding documents asks each shard's filter about the new keys. A key that the
filter does not know is new for certain and is appended; only the others are
joined with the exact counts, and those that the filter knew wrongly get marks
of their own. So there is one mark for each key of the counts, and removing
documents lowers the counts and takes the mark of a key that no document holds
any more, and no other's. Shards are dealt anew when they outgrow their bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesight.llm.common import extended, own_names, with_package
from lakesight.llm.cuckoo import MARK_BITS, CuckooFilter
from lakesight.session import materialise, small_frame

MIN_CHARS = 20
MIN_DOCUMENTS = 3
SHARD_KEYS = 1 << 17
MIN_SHARDS = 64
BATCHES = 3
_SPACE = b" \t\n\x0b\x0c\r"
REFS, COUNTS, FILTERS = "hi long, lo long, doc_id long", "shard int, hi long, lo long, n long, top long", "shard int, filter binary"
KEY = ["hi", "lo"]
RESULT = ["n_lines", "n_dropped", "kept_text"]


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of a line's key; None if the key is too short to count."""
    key = line.strip(_SPACE).lower()  # bytes: A-Z only
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(key)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def references(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(hi, lo, doc_id): the distinct long keys of each text. Documents without an id hold no references."""
    source = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = {k for k in map(line_key, _lines(content)) if k}
                keys += found
                owners += [doc_id] * len(found)
            pairs = np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2).astype(np.int64)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(owners, pa.int64())], names=["hi", "lo", "doc_id"])

    return with_package(source).mapInArrow(mapped, REFS).distinct()


def _hashes(keys: pd.DataFrame) -> np.ndarray:
    return keys["hi"].to_numpy().view(np.uint64) ^ (keys["lo"].to_numpy().view(np.uint64) << np.uint64(1))


def _asked(mark_bits: int):
    """One shard: which of the new keys its filter knows, and the filter with the others added."""
    def updated(shard: tuple, delta: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        keys = _hashes(delta)
        old = CuckooFilter.from_bytes(state["filter"].iloc[0], mark_bits) if len(state) else CuckooFilter.for_keys(max(1, len(keys)), mark_bits)
        seen = old.contains(keys) if len(state) else np.zeros(len(keys), dtype=bool)
        full = not old.room(int((~seen).sum())) or not old.insert(keys[~seen])
        rows = delta.assign(seen=seen, full=full, filter=None)
        if full:  # grown from the exact counts afterwards
            return rows
        last = pd.DataFrame({"shard": [int(shard[0])], "hi": [0], "lo": [0], "n": [0], "top": [None], "seen": [False], "full": [False], "filter": [old.to_bytes()]})
        return pd.concat([rows, last]).astype({"top": "Int64"}) if len(rows) else last

    return updated


def _marked(mark_bits: int):
    """One shard: its filter with marks for further keys; null if there is no room."""
    def marked(shard: tuple, keys: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        found = [None] * len(state)
        if len(state):
            old = CuckooFilter.from_bytes(state["filter"].iloc[0], mark_bits)
            if not len(keys) or (old.room(len(keys)) and old.insert(_hashes(keys))):
                found = [old.to_bytes()]
        return pd.DataFrame({"shard": [int(shard[0])] * len(found), "filter": found})

    return marked


def _built(mark_bits: int):
    """One shard: a filter of all its keys."""
    def built(shard: tuple, keys: pd.DataFrame) -> pd.DataFrame:
        number = len(keys)
        while True:
            new = CuckooFilter.for_keys(2 * number, mark_bits)
            if new.insert(_hashes(keys)):
                return pd.DataFrame({"shard": [int(shard[0])], "filter": [new.to_bytes()]})
            number *= 2

    return built


class LineIndex:
    """State of the line dedup; every change gives a new index and leaves the old one as it was."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, shard_keys: int = SHARD_KEYS, mark_bits: int = MARK_BITS):
        self.refs, self.counts, self.filters, self.shards = refs, counts, filters, shards
        self.shard_keys, self.mark_bits = shard_keys, mark_bits

    @classmethod
    def empty(cls, spark: SparkSession, shards: int, shard_keys: int = SHARD_KEYS, mark_bits: int = MARK_BITS) -> LineIndex:
        """``shard_keys`` bounds what one task holds: the index gets more shards when they have more keys than that on average."""
        frame = lambda schema: small_frame(spark, [], schema)
        return cls(frame(REFS), frame(COUNTS), frame(FILTERS), shards, shard_keys, mark_bits)

    def _like(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int | None = None) -> LineIndex:
        return LineIndex(refs, counts, filters, shards or self.shards, self.shard_keys, self.mark_bits)

    def _shard(self):
        return F.pmod(F.xxhash64("hi"), F.lit(self.shards)).cast("int").alias("shard")

    def dealt_anew(self, shards: int) -> LineIndex:
        """The same index in another number of shards."""
        moved = self._like(self.refs, self.counts, self.filters, shards)
        counts = materialise(self.counts.select(moved._shard(), *KEY, "n", "top"))
        filters = with_package(counts).groupBy("shard").applyInPandas(_built(self.mark_bits), FILTERS)
        return moved._like(self.refs, counts, materialise(filters))

    def add(self, refs: DataFrame) -> LineIndex:
        """Index with the references of further documents; references that it has already change nothing."""
        refs = materialise(refs.join(self.refs, [*KEY, "doc_id"], "left_anti"))
        delta = refs.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).select(self._shard(), *KEY, "n", "top")
        asked = materialise(with_package(delta).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(
            _asked(self.mark_bits), f"{COUNTS}, seen boolean, full boolean, filter binary"))
        new = asked.where("filter IS NULL")
        known = new.where("seen").select("hi", "lo", F.col("n").alias("more"), F.col("top").alias("higher"))
        counts = (
            self.counts.join(known, KEY, "full").select(
                F.coalesce("shard", self._shard()).alias("shard"), *KEY,
                (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("top", "higher").alias("top"))
            .unionByName(new.where("not seen").select("shard", *KEY, "n", "top"))
        )
        counts = materialise(counts)
        filters = asked.where("filter IS NOT NULL").select("shard", "filter")
        unmarked = materialise(new.where("seen").select("shard", *KEY).join(self.counts.select(*KEY), KEY, "left_anti"))
        if not unmarked.isEmpty():  # keys that a filter knew wrongly
            filters = materialise(with_package(unmarked).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_marked(self.mark_bits), FILTERS))
        full = new.where("full").select("shard").unionByName(filters.where("filter IS NULL").select("shard")).distinct()
        grown = with_package(counts).join(full, "shard").groupBy("shard").applyInPandas(_built(self.mark_bits), FILTERS)
        filters = materialise(filters.where("filter IS NOT NULL").unionByName(grown))
        index = self._like(materialise(self.refs.unionByName(refs)), counts, filters)
        number, shards = counts.count(), self.shards
        while number > shards * self.shard_keys:
            shards *= 2
        return index if shards == self.shards else index.dealt_anew(shards)

    def remove(self, ids: DataFrame) -> LineIndex:
        """Index without the documents of ``ids`` (one column)."""
        ids = ids.select(F.col(f"`{ids.columns[0]}`").cast("long").alias("doc_id")).distinct()
        gone = materialise(self.refs.join(ids, "doc_id").select(*KEY).distinct())
        refs = materialise(self.refs.join(ids, "doc_id", "left_anti").select(*KEY, "doc_id"))
        left = refs.join(gone, KEY).groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).select(self._shard(), *KEY, "n", "top")
        left = materialise(left)
        counts = materialise(self.counts.join(gone, KEY, "left_anti").unionByName(left))
        dropped = gone.join(left, KEY, "left_anti").select(self._shard(), *KEY)
        mark_bits = self.mark_bits

        def without_keys(shard: tuple, keys: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            kept = CuckooFilter.from_bytes(state["filter"].iloc[0], mark_bits)
            kept.remove(_hashes(keys))
            return pd.DataFrame({"shard": [int(shard[0])], "filter": [kept.to_bytes()]})

        filters = with_package(dropped).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(without_keys, FILTERS)
        return self._like(refs, counts, materialise(filters))

    def dropped_keys(self) -> DataFrame:
        """(doc_id, keys): for each document the keys whose lines it loses, as 16-byte hashes in one binary."""
        often = self.counts.where(F.col("n") >= MIN_DOCUMENTS).select(*KEY, "top")
        lost = self.refs.join(often, KEY).where("doc_id <> top")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("keys"))


@own_names(RESULT, "id", "text")
def dedup(docs: DataFrame, index: LineIndex, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (the lines left, joined by line ends).

    A key of at least 20 code points that at least 3 documents hold loses its
    lines everywhere but in the largest id. Defined cases: a null or empty text
    is one empty line; repeated rows of an id are one document; rows without an
    id hold no references and lose nothing.
    """
    names = RESULT
    schema, given = extended(docs, "n_lines long, n_dropped long, kept_text string"), docs.columns
    keys = index.dropped_keys().select(F.col("doc_id").alias("_doc"), F.col("keys").alias("_keys"))
    joined = docs.join(keys, F.col(f"`{id}`") == F.col("_doc"), "left").drop("_doc")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted, lost, left = [], [], []
            for content, keys in zip(batch.column(text).to_pylist(), batch.column("_keys").to_pylist()):
                lines = _lines(content)
                drop = {np.array([k["hi"], k["lo"]], dtype=">i8").tobytes() for k in keys or ()}
                kept = [line for line in lines if line_key(line) not in drop] if drop else lines
                counted.append(len(lines))
                lost.append(len(lines) - len(kept))
                left.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            columns = [batch.column(c) for c in given]
            yield pa.record_batch([*columns, pa.array(counted, pa.int64()), pa.array(lost, pa.int64()), pa.array(left, pa.string())], names=[*given, *names])

    return with_package(joined).mapInArrow(mapped, schema)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """All of ``docs`` added to an empty index in ``batches`` steps, then freed of their repeated lines."""
    refs = materialise(references(docs, id, text))
    shards = max(MIN_SHARDS, -(-refs.count() // SHARD_KEYS))
    index = LineIndex.empty(docs.sparkSession, shards)
    for batch in range(batches):
        index = index.add(refs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == batch))
    return dedup(docs, index, id, text)
