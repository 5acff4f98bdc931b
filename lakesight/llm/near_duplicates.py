"""SimHash near-duplicates found by fuzzy hashing with the Golay code.

A 64-bit fingerprint falls into two 23-bit segments A and B and 18 more bits C
with halves C1 and C2. At most 3 differing bits fall on them as (a, b, c), and
in every case some parts are equal and some Golay segment differs in one bit at
most, so that one word's codeword is among the other's nearby ones:

    c = 0   C equal, and A or B differs in at most 1 bit
    c = 1   C1 or C2 equal, and A and B differ in at most 1 bit each, or one of them is equal (2 bits in the other)
    c >= 2  A equal and B differs in at most 1 bit, or the other way round

Every fingerprint enters one key per case, and probes the keys of its nearby
codewords. Distinct fingerprints that meet under a key are compared exactly. A
key's group gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesight.llm import golay
from lakesight.llm.common import extended, texts, with_package, without
from lakesight.llm.components import connected_components
from lakesight.session import materialise

SHINGLE = 3
SEED = 42
MAX_BITS = 3
GROUP_LIMIT = 200_000  # rows of a key that one task holds; larger groups are dealt out as pairs of blocks
SMALL = 8
_ROWS_AT_ONCE = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of the XXH64 of all word shingles, repeats included; zero for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    if len(words) < size:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(words) - size + 1)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _ROWS_AT_ONCE):
        part = hashes[at : at + _ROWS_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of each text."""
    docs = without(docs, [name])
    schema = extended(docs, f"`{name}` long")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(map(fingerprint, texts(batch.column(text))), dtype=np.uint64, count=batch.num_rows)
            yield batch.append_column(name, pa.array(prints.view(np.int64)))

    return with_package(docs).mapInArrow(mapped, schema)


def _mixed(family: int, *parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of a family number and its parts; the fields fit, so different parts give different keys."""
    key = np.uint64(family)
    for part, bits in parts:
        key = (key << np.uint64(bits)) | part.astype(np.uint64)
    return key


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """All keys of the fingerprints (unsigned) as (row numbers, keys, keys per row that are its own).

    The first columns are the own keys, the others the probes.
    """
    low = np.uint64((1 << 23) - 1)
    a, b = (prints & low).astype(np.uint32), (prints >> np.uint64(23) & low).astype(np.uint32)
    c = prints >> np.uint64(46)
    halves = (c & np.uint64(511), c >> np.uint64(9))
    near_a, near_b = golay.nearby(a), golay.nearby(b)
    keys = []
    for i in range(6):
        keys += [_mixed(1, (c, 18), (near_a[:, i], 12)), _mixed(2, (c, 18), (near_b[:, i], 12))]
        keys += [_mixed(5, (b, 23), (near_a[:, i], 12)), _mixed(6, (a, 23), (near_b[:, i], 12))]
        for j in range(6):
            keys += [_mixed(3 + 4 * h, (half, 9), (near_a[:, i], 12), (near_b[:, j], 12)) for h, half in enumerate(halves)]
    for h, half in enumerate(halves):
        keys += [_mixed(4 + 4 * h, (half, 9), (a, 23)), _mixed(9 + h, (half, 9), (b, 23))]
    stacked = np.stack(keys, axis=1)
    own = np.zeros(stacked.shape[1], dtype=bool)
    own[:6] = own[-4:] = True  # the first codeword of each case is the word's own
    stacked = np.concatenate([stacked[:, own], stacked[:, ~own]], axis=1)
    return stacked, own.sum()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, own): own keys once, probes once each."""
    for batch in batches:
        signed = np.asarray(batch.column(0))
        for at in range(0, len(signed), 4096):
            part = signed[at : at + 4096]
            keys, own = keys_of(part.view(np.uint64))
            order = np.argsort(keys[:, own:], axis=1)
            probes = np.take_along_axis(keys[:, own:], order, axis=1)
            new = np.ones(probes.shape, dtype=bool)
            new[:, 1:] = probes[:, 1:] != probes[:, :-1]
            # a word's own codeword may come back among the nearby ones
            for k in range(own):
                new &= probes != keys[:, k : k + 1]
            row, column = np.nonzero(new)
            key = np.concatenate([keys[:, :own].ravel(), probes[row, column]])
            fp = np.concatenate([np.repeat(part, own), part[row]])
            mine = np.zeros(len(key), dtype=bool)
            mine[: own * len(part)] = True
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp), pa.array(mine)], names=["key", "fp", "own"])


def _forest(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one group: each word reached takes all words near it that nothing has reached yet."""
    links, rest = [], np.unique(prints)
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for word in queue.pop():
                near = np.bitwise_count(rest ^ word) <= MAX_BITS
                if near.any():
                    found, rest = rest[near], rest[~near]
                    links.append((np.full(len(found), word), found))
                    queue.append(found)
                if not len(rest):
                    break
    return links


def _linked(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    owns = np.add.reduceat(own.astype(np.int64), starts) if len(key) else np.zeros(0, dtype=np.int64)
    busy = (sizes > 1) & (owns > 0)
    small = np.repeat(busy & (sizes <= SMALL), sizes)
    k, f = key[small], fp[small]
    out = []
    for shift in range(1, min(SMALL, len(k))):
        same = k[shift:] == k[:-shift]
        if not same.any():
            break
        x, y = f[:-shift][same], f[shift:][same]
        near = (np.bitwise_count(x ^ y) <= MAX_BITS) & (x != y)
        out.append((x[near], y[near]))
    for start, size in zip(starts[busy & (sizes > SMALL)], sizes[busy & (sizes > SMALL)]):
        out += _forest(fp[start : start + size])
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _matcher(limit: int | None):
    """Map over rows sorted by key: links of its groups; rows of a group over ``limit`` come out as they are."""
    names = ["a", "b", "over"]

    def rows(a: np.ndarray, b: np.ndarray, over: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), over))], names=names)

    def done(parts: list) -> pa.RecordBatch:
        key, fp, own = (np.concatenate(x) for x in zip(*parts))
        a, b = _linked(key, fp, own)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.uint64)
        return rows(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), False)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, spilling = [], 0, None
        for batch in batches:
            key, fp = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            own = np.asarray(batch.column(2).to_numpy(zero_copy_only=False))
            if spilling is not None:
                n = int(np.searchsorted(key.view(np.int64), spilling, side="right"))
                yield rows(key[:n], fp[:n], True)
                if n == len(key):
                    continue
                key, fp, own, spilling = key[n:], fp[n:], own[n:], None
            if not len(key):
                continue
            held.append((key, fp, own))
            count += len(key)
            if count < _ROWS_AT_ONCE:
                continue
            key, fp, own = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(key.view(np.int64), key[-1].view(np.int64), side="left"))  # the last group may go on
            if last:
                yield done([(key[:last], fp[:last], own[:last])])
            key, fp, own = key[last:], fp[last:], own[last:]
            held, count = [(key, fp, own)], len(key)
            if limit and count > limit:
                yield rows(key, fp, True)
                held, count, spilling = [], 0, key[-1].view(np.int64)
        if held:
            yield done(held)

    return mapped


def links(prints: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within 3 bits of each other."""
    exploded = with_package(prints).mapInArrow(_exploded, "key long, fp long, own boolean")
    met = materialise(exploded.repartition("key").sortWithinPartitions("key").mapInArrow(_matcher(limit), "a long, b long, over boolean"))
    found = met.where("not over").select("a", "b")
    over = met.where("over").select(F.col("a").alias("key"), F.col("b").alias("fp")).distinct()
    if over.isEmpty():
        return found
    over = materialise(over)
    blocks = over.groupBy("key").agg(F.ceil(F.count("*") / F.lit(max(1, limit // 2))).alias("blocks"))
    dealt = over.join(materialise(blocks), "key").withColumn("x", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = dealt.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "fp", F.lit(True).alias("own"))
    more = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_matcher(None), "a long, b long, over boolean")
    return found.unionByName(more.select("a", "b"))


def _classes(docs: DataFrame, id: str, text: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows: _id, digest, fp), (fingerprints: fp, component, component_id)."""
    rows = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), _digest(text).alias("digest"))
    rows = materialise(with_fingerprints(rows, "_text", "fp").select("_id", "digest", "fp"))
    prints = materialise(rows.groupBy("fp").agg(F.min("_id").alias("first")))
    # whatever connects the fingerprints connects the documents
    component = connected_components(links(prints.select("fp"), limit))
    marked = materialise(prints.join(component.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")))
    smallest = marked.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows, materialise(marked.join(smallest, "component").select("fp", "component", "component_id"))


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = GROUP_LIMIT) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``: the smallest id reachable over near fingerprints.

    Defined cases: a null text is an empty one; empty texts share fingerprint
    zero and link like any other; repeated rows each get their row; a component
    without any id has a null component_id. Copies meet in one fingerprint and
    never form pairs.
    """
    rows, classes = _classes(docs, id, text, limit)
    return rows.join(classes, "fp").select(
        F.col("_id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = GROUP_LIMIT) -> DataFrame:
    """The rows of ``docs`` that stand for their group: its smallest id, and one row if that is repeated.

    A group whose rows all lack an id keeps one of them.
    """
    rows, classes = _classes(docs, id, text, limit)
    own = rows.join(classes, "fp").where(F.col("_id").eqNullSafe(F.col("component_id")))
    kept = own.groupBy("component").agg(F.min(F.struct("_id", "digest")).alias("k")).select(
        F.col("k._id").alias("_kept"), F.col("k.digest").alias("_digest"))
    # the row travels as one struct, whatever its columns are called
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id}`").alias("own"), _digest(text).alias("digest"))
    whole = F.col("row").cast("string")
    first = Window.partitionBy("_kept", "_digest").orderBy(F.xxhash64(whole), whole)
    joined = given.join(kept, F.col("own").eqNullSafe(F.col("_kept")) & (F.col("digest") == F.col("_digest")))
    return joined.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")
