"""Ranked lexical search over bit-sliced Bloom signatures, with exact results.

The index has a row per block of documents of similar size. A block's
signatures lie in slices: bit ``d`` of slice ``p`` says that position ``p`` is
set for document ``d``. A term sets ``HASHES`` positions for each of its
``LEVELS`` (it occurs 1, 2, 4, 8, 16 times at least), so the AND of a term's
slices is a bitmap of the documents that may hold it that often. Each row of
the index also has the block's terms with their document counts.

A query adds its terms' weights over these bitmaps. Bitmaps overestimate, so
the sums are upper bounds of the scores. The documents with the highest bounds
are scored exactly, which gives a score that the last result has at least; all
documents whose bounds do not rule them out are then scored exactly too.
Queries are taken in blocks of a bounded size, one after the other.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesight.llm.common import slices as text_slices
from lakesight.llm.common import with_package
from lakesight.session import materialise

TOP = 10
HASHES = 4
BITS_PER_ENTRY = 12
LEVELS = 5
BLOCK_DOCUMENTS = 4096
BLOCK_BITS = 1 << 25
SIZE_STEP = 4  # documents of a block differ by this factor in entries at most
SEEDS = 3 * TOP  # documents with the highest bounds, scored first
QUERY_PAIRS = 200_000  # (query, term) pairs of a block of queries
BROADCAST_KEYS = 500_000  # more candidates than this are joined by a shuffle
LAST = (1 << 63) - 1  # stands for a missing id: it comes after all others
INDEX = """keys array<long>, ids array<long>, lengths array<long>, n_documents long, n_terms long, width long, slices binary,
    terms array<binary>, frequencies array<long>"""
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order; in UTF-8 all bytes of characters beyond ASCII are term bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, seed=42)


def positions(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """(terms, HASHES) slices of the terms at a level."""
    x = (hashes ^ np.uint64((level * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    first, step = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)


class _Block:
    """Documents of one size class, until the block is full."""

    def __init__(self, entries: int):
        self.width = -(-BITS_PER_ENTRY * entries // 64) * 64
        self.room = max(8, min(BLOCK_DOCUMENTS, BLOCK_BITS // self.width))
        self.keys: list[int] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.entries: list[list[np.ndarray]] = []
        self.frequencies: Counter = Counter()

    def add(self, key: int, id: int | None, counted: Counter, levels: list[np.ndarray]) -> None:
        self.keys.append(key)
        self.ids.append(id)
        self.lengths.append(sum(counted.values()))
        self.entries.append(levels)
        self.frequencies.update(counted.keys())

    def row(self) -> pa.RecordBatch:
        bits = np.zeros((self.width, -(-len(self.keys) // 8) * 8), dtype=bool)
        for d, levels in enumerate(self.entries):
            for level, hashes in enumerate(levels):
                bits[positions(hashes, level, self.width), d] = True
        values = [self.keys, self.ids, self.lengths, sum(n > 0 for n in self.lengths), sum(self.lengths), self.width,
                  np.packbits(bits, axis=1, bitorder="little").tobytes(), list(self.frequencies), list(self.frequencies.values())]
        types = [pa.list_(pa.int64())] * 3 + [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        names = ["keys", "ids", "lengths", "n_documents", "n_terms", "width", "slices", "terms", "frequencies"]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=names)


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(key, doc_id, text); a key names a row's id and text, and equal rows share one."""
    named = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as rows of blocks; write it to keep it. A null or empty text is a document without terms."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, _Block] = {}
        for batch in text_slices(batches, "text", 8 << 20):
            for key, doc_id, content in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
                counted = Counter(terms_of(content))
                if not counted:
                    continue
                hashes = np.fromiter(map(term_hash, counted), dtype=np.uint64, count=len(counted))
                often = np.fromiter(counted.values(), dtype=np.int64, count=len(counted))
                levels = [hashes, *(hashes[often >= 1 << level] for level in range(1, LEVELS))]
                entries = 64
                while entries < sum(map(len, levels)):
                    entries *= SIZE_STEP
                block = open_blocks.setdefault(entries, _Block(entries))
                block.add(key, doc_id, counted, levels)
                if len(block.keys) >= block.room:
                    yield block.row()
                    del open_blocks[entries]
        for block in open_blocks.values():
            yield block.row()

    return with_package(_keyed(docs, id, text)).mapInArrow(mapped, INDEX)


@dataclass
class Queries:
    """One block of queries: per query its weighted terms, and the score and id that a result must not fall behind."""

    numbers: list[int]
    terms: list[bytes]
    of_query: list[tuple[np.ndarray, np.ndarray]]  # per query: places in ``terms``, weights times repeats
    documents: int
    words: int
    least: list[tuple[int, int]]

    def __post_init__(self):
        self.hashes = np.array([term_hash(t) for t in self.terms], dtype=np.uint64)
        self.place = {number: i for i, number in enumerate(self.numbers)}

    def size_factor(self, n: np.ndarray | int):
        """m of the scoring rule: a document's length against the mean."""
        return 25 + 75 * n * self.documents // self.words

    def bounds(self, block: dict) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the query, upper bounds for all documents of a block), where any is above zero."""
        width, n = block["width"], np.array(block["lengths"], dtype=np.int64)
        bits = np.frombuffer(block["slices"], dtype=np.uint8).reshape(width, -1)
        m, gains, maps, below, before = self.size_factor(n), [], [], None, 0
        for level in range(LEVELS):
            most = np.minimum(n, 2 * (1 << level) - 1) if level < LEVELS - 1 else n
            value = 1_000_000_000 * most // (1000 * most + 8 * m)
            gains.append(value - before)
            before = value
            at = positions(self.hashes, level, width)
            found = bits[at[:, 0]]
            for i in range(1, HASHES):
                found &= bits[at[:, i]]
            if below is not None:
                found &= below
            below = found
            maps.append((found, found.any(axis=1)))
        for q, (places, weights) in enumerate(self.of_query):
            total = np.zeros(len(n), dtype=np.int64)
            for (found, any_), gain in zip(maps, gains):
                held = any_[places]
                if not held.any():
                    break
                rows = np.unpackbits(found[places[held]], axis=1, count=len(n), bitorder="little")
                total += (weights[held].astype(np.float64) @ rows).astype(np.int64) * gain
            if total.any():
                yield q, total

    def score(self, query: int, counted: Counter, n: int) -> int:
        places, weights = self.of_query[query]
        m = int(self.size_factor(n))
        out = 0
        for p, w in zip(places.tolist(), weights.tolist()):
            tf = counted.get(self.terms[p])
            if tf:
                out += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        return out


def _best(held: dict[int, list[tuple]], keep: int) -> None:
    for q, rows in held.items():
        rows.sort()
        del rows[keep:]


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _highest_bounds(index: DataFrame, queries: Queries) -> DataFrame:
    """(query, key): the ``SEEDS`` documents with the highest bounds per query."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for block in _blocks(batch):
                ids = np.array([LAST if i is None else i for i in block["ids"]], dtype=np.int64)
                for q, bound in queries.bounds(block):
                    some = np.lexsort((ids, -bound))[:SEEDS]
                    held[q] += [(-int(bound[d]), int(ids[d]), block["keys"][d]) for d in some if bound[d] > 0]
                _best(held, SEEDS)
        rows = [(q, -bound, id, key) for q, rows in held.items() for bound, id, key in rows]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query", "bound", "id", "key"])

    found = with_package(index).mapInArrow(mapped, "query long, bound long, id long, key long")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "id"))
    return found.withColumn("n", first).where(F.col("n") <= SEEDS).select("query", "key").distinct()


def _not_excluded(index: DataFrame, queries: Queries) -> DataFrame:
    """(query, key): all documents whose bounds do not put them behind the result that is known already."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                ids = np.array([LAST if i is None else i for i in block["ids"]], dtype=np.int64)
                keys = np.array(block["keys"], dtype=np.int64)
                for q, bound in queries.bounds(block):
                    least, last = queries.least[q]
                    on = (bound > least) | (bound == least) & (ids <= last) if least else bound > 0
                    yield pa.record_batch([pa.array(np.full(int(on.sum()), q)), pa.array(keys[on])], names=["query", "key"])

    return with_package(index).mapInArrow(mapped, "query long, key long").distinct()


def _scores(docs: DataFrame, candidates: DataFrame, queries: Queries) -> DataFrame:
    """(number, doc_id, score, rank): exact scores of the candidates, the best ``TOP`` of each task per query."""
    by_key = materialise(candidates.groupBy("key").agg(F.collect_list("query").alias("queries")))
    few = by_key.count() <= BROADCAST_KEYS
    wanted = docs.join(F.broadcast(by_key) if few else by_key, "key").select("doc_id", "text", "queries")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        for batch in text_slices(batches, "text", 8 << 20):
            for doc_id, content, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "queries"))):
                terms = terms_of(content)
                counted = Counter(terms)
                for q in asked:
                    if score := queries.score(q, counted, len(terms)):
                        held[q].append((-score, LAST if doc_id is None else doc_id, doc_id))
            _best(held, TOP)
        rows = [(queries.numbers[q], doc_id, -score) for q, rows in held.items() for score, _, doc_id in rows]
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["number", "doc_id", "score"])

    best = with_package(wanted).mapInArrow(mapped, "number long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return materialise(best.withColumn("rank", place).where(F.col("rank") <= TOP))


def _query_terms(queries: DataFrame, text: str) -> DataFrame:
    """(number, term, repeats) of the numbered queries."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(number, term, times) for number, content in zip(*(batch.column(c).to_pylist() for c in ("number", "text")))
                    for term, times in Counter(terms_of(content)).items()]
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()))], names=["number", "term", "repeats"])

    return with_package(queries.select("number", F.col(f"`{text}`").alias("text"))).mapInArrow(mapped, "number long, term binary, repeats long")


def _loaded(terms: DataFrame, documents: int, words: int) -> Queries:
    """One block's queries on the driver; their number of terms is bounded by the block."""
    of_query: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
    for r in terms.orderBy("number", "term").collect():
        of_query[r.number].append((bytes(r.term), r.weight * r.repeats))
    every = sorted({t for own in of_query.values() for t, _ in own})
    place = {t: i for i, t in enumerate(every)}
    arrays = [(np.array([place[t] for t, _ in own]), np.array([w for _, w in own], dtype=np.int64)) for own in of_query.values()]
    return Queries(list(of_query), every, arrays, documents, words, [(0, LAST)] * len(arrays))


def search(docs: DataFrame, index: DataFrame, queries: DataFrame, id: str = "doc_id", text: str = "text", query_id: str = "item_id",
           query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the ``TOP`` best documents of every query; ``index`` is that of ``docs``, read from files.

    Equal scores rank by ascending id, rows without an id last. Defined cases:
    a query without terms, or whose terms no document holds, has no rows, and
    neither has any query on an empty table; repeated query rows have their own
    results each, repeated documents are results of their own; other columns
    are left out.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id, text)
    numbered = materialise(queries.select(
        F.monotonically_increasing_id().alias("number"), F.col(f"`{query_id}`").alias("query_id"), F.col(f"`{query_text}`").alias("text")))
    own = materialise(_query_terms(numbered, "text"))
    asked = materialise(own.select("term").distinct())
    documents, words = index.agg(F.sum("n_documents"), F.sum("n_terms")).first()
    held = index.select(F.inline(F.arrays_zip("terms", "frequencies"))).toDF("term", "frequency")
    held = held.join(F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked, "term")
    held = held.groupBy("term").agg(F.sum("frequency").alias("frequency"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * (documents or 0)) + 2) / (2 * F.col("frequency") + 1)))
    weighted = materialise(own.join(held, "term").select("number", "term", "repeats", weight.cast("long").alias("weight")).where("weight > 0"))
    blocks = -(-weighted.count() // QUERY_PAIRS)
    results = []
    signatures = index.select("keys", "ids", "lengths", "width", "slices")
    for block in range(blocks):
        terms = weighted.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block)
        loaded = _loaded(terms, documents, words)
        seeds = _scores(keyed, _highest_bounds(signatures, loaded), loaded)
        for r in seeds.where(F.col("rank") == TOP).collect():  # a row per query of the block
            loaded.least[loaded.place[r.number]] = (r.score, LAST if r.doc_id is None else r.doc_id)
        results.append(_scores(keyed, _not_excluded(signatures, loaded), loaded))
    if not results:
        return numbered.select(
            F.col("query_id").alias(query_id), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("long").alias("score")).where(F.lit(False))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.join(numbered.select("number", F.col("query_id").alias(query_id)), "number").select(query_id, "rank", "doc_id", "score")
