"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of a bounded number of words, indexes
a shard's words, searches all test phrases backwards through wavelet ranks,
locates the occurrences by sampled suffix positions and merges them into spans.
The training text is never shuffled; the phrases come to it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesight.llm.common import extended, own_names, slices, texts, with_package, without
from lakesight.llm.fm_index import FmIndex
from lakesight.session import materialise

WINDOW = 13
MIN_PERCENT = 5  # 20 * n_hit >= n_words
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20  # test texts that one pass brings to the driver and the tasks
RESULT = "n_words long, n_hit long, items array<long>, spans array<struct<first:long,last:long>>"
COLUMNS = ["n_words", "n_hit", "items", "spans", "contaminated", "clean_text"]
# letters and digits of ASCII and all bytes of other characters make words; A-Z are lower-cased
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words before A-Z are lower-cased


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Phrases:
    """The distinct windows of a block of test items, as numbers of the block's words."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, words in items:
            ids = [numbers[w] for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[i : i + window])].add(item)
        self.words, phrases = list(numbers), list(owners)
        self.lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        self.rows = np.full((len(phrases), window), -1, dtype=np.int64)
        for i, p in enumerate(phrases):
            self.rows[i, window - len(p) :] = p
        known = [sorted(x for x in owners[p] if x is not None) for p in phrases]
        self.first = np.concatenate([[0], np.cumsum([len(k) for k in known])]).astype(np.int64)
        self.items = np.array([x for k in known for x in k], dtype=np.int64)


def _pieces(size: int, limit: int, window: int) -> list[tuple[int, int]]:
    """Cut a document of ``size`` words so that every window lies in one piece."""
    step = max(1, limit - window + 1)
    return [(at, min(size, at + limit)) for at in range(0, max(1, size - window + 1), step)]


class Shard:
    """Documents, or pieces of a very long one, up to a bounded number of words."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.places: list[tuple[int, int]] = []  # (document, its first word) per part
        self.size = 0

    def add(self, document: int, offset: int, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.int32, count=len(words)))
        self.places.append((document, offset))
        self.size += len(words)

    def occurrences(self, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, first words, phrases) for each part with occurrences."""
        if not self.size or not len(phrases.lengths):
            return
        # each part starts with a number of its own, so no phrase runs across parts and copies end apart
        above = len(self.parts) + 1
        text = np.concatenate([x for i, part in enumerate(self.parts) for x in ([i + 1], part + above)])
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in self.parts])])
        index = FmIndex(text)
        known = np.array([self.vocabulary.get(w, -1) for w in phrases.words] + [-1], dtype=np.int64)
        symbols = np.where(known >= 0, known + above, -1)[phrases.rows]
        low, high = index.search(symbols, phrases.lengths)
        found = np.flatnonzero(high > low)
        if not len(found):
            return
        times = (high - low)[found]
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        phrase, at = np.repeat(found, times), index.locate(rows)
        by = np.argsort(at, kind="stable")
        phrase, at = phrase[by], at[by]
        part = np.searchsorted(starts, at, side="right") - 1
        for first, last in _runs(part):
            document, offset = self.places[part[first]]
            yield document, at[first:last] - starts[part[first]] - 1 + offset, phrase[first:last]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans."""
    by = np.argsort(first, kind="stable")
    first, last = first[by], np.maximum.accumulate(last[by])
    new = np.concatenate([[True], first[1:] > last[:-1]]) if len(first) else np.zeros(0, dtype=bool)
    ends = np.flatnonzero(new)[1:] - 1
    return first[new], np.concatenate([last[ends], last[-1:]])


def _judged(sizes: list[int], shards: list[Shard], phrases: Phrases) -> list[pa.Array]:
    """Result columns for documents whose parts lie in ``shards``."""
    spans: dict[int, list] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    for shard in shards:
        for document, first, phrase in shard.occurrences(phrases):
            spans[document].append((first, first + phrases.lengths[phrase]))
            for p in np.unique(phrase):
                items[document].update(phrases.items[phrases.first[p] : phrases.first[p + 1]].tolist())
    hits, found = np.zeros(len(sizes), dtype=np.int64), [[] for _ in sizes]
    for document, pairs in spans.items():
        first, last = merged(*(np.concatenate(x) for x in zip(*pairs)))
        hits[document] = (last - first).sum()
        found[document] = [{"first": int(a), "last": int(b)} for a, b in zip(first, last)]
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return [
        pa.array(sizes, pa.int64()), pa.array(hits), pa.array([sorted(items.get(i, ())) for i in range(len(sizes))], pa.list_(pa.int64())),
        pa.array(found, span),
    ]


def _searcher(phrases: Phrases, text: str, window: int, shard_words: int):
    names = ["n_words", "n_hit", "items", "spans"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sizes: list[int] = []
        shards = [Shard()]

        def done() -> Iterator[pa.RecordBatch]:
            columns, at = _judged(sizes, shards, phrases), 0
            for batch in held:
                yield pa.record_batch([*batch.columns, *(c.slice(at, batch.num_rows) for c in columns)],
                                      names=[*batch.schema.names, *names])
                at += batch.num_rows

        for batch in slices(batches, text, 8 * shard_words):
            if sum(sizes) and sum(sizes) + batch.nbytes // 8 > shard_words:
                yield from done()
                held, sizes, shards = [], [], [Shard()]
            for document in texts(batch.column(text)):
                words = words_of(document)
                for i, (first, last) in enumerate(_pieces(len(words), shard_words, window)):
                    if i or shards[-1].size + len(words) > shard_words:
                        shards.append(Shard())
                    shards[-1].add(len(sizes), first, words[first:last])
                sizes.append(len(words))
            held.append(batch)
        if held:
            yield from done()

    return mapped


def _block(items: DataFrame, block: int, blocks: int) -> Phrases:
    """One block's windows; the driver holds one block at a time."""
    own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
    return Phrases([(r.item, words_of(r.text)) for r in own.toLocalIterator()])


@own_names(COLUMNS, "text")
def find_benchmark_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items, spans (of words, last excluded) and contaminated.

    An item's windows are its runs of 13 words; a shorter item is one window. A
    document is contaminated if windows cover at least 5 % of its words.

    Defined cases: null texts have no words; an item without an id marks words
    but is not listed; repeated items and rows count as they are; without
    documents there are no rows, without items no document is contaminated;
    input columns named like a result are replaced. Test sets above
    ``block_bytes`` are searched block by block, what each finds is written, and
    the spans are united.
    """
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        found = with_package(docs).mapInArrow(_searcher(_block(items, 0, 1), text, WINDOW, shard_words), extended(docs, RESULT))
    else:
        found = _by_blocks(docs, items, blocks, text, shard_words)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= MIN_PERCENT * F.col("n_words")))


def _by_blocks(docs: DataFrame, items: DataFrame, blocks: int, text: str, shard_words: int) -> DataFrame:
    """Rows of ``docs`` with what all blocks find. Rows are numbered in a written copy; each block's finds are written without texts."""
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()))
    texts_only = numbered.select("_row", F.col(f"`{text}`").alias("text"))
    every, sizes = None, None
    for block in range(blocks):
        searched = with_package(texts_only).mapInArrow(_searcher(_block(items, block, blocks), "text", WINDOW, shard_words), extended(texts_only, RESULT))
        hits = materialise((searched if block == 0 else searched.where("n_hit > 0")).drop("text"))
        sizes = hits.select("_row", "n_words") if block == 0 else sizes
        every = hits.drop("n_words") if block == 0 else every.unionByName(hits.drop("n_words"))
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= s["first"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], s["last"]).alias("last"))))
    ).otherwise(F.concat(acc, F.array(s)))
    spans = F.aggregate(F.sort_array(F.col("spans")), F.array().cast("array<struct<first:long,last:long>>"), step)
    united = (
        every.where("n_hit > 0").groupBy("_row")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .withColumn("spans", spans)
        .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"]))
    )
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return numbered.join(sizes, "_row").join(united, "_row", "left").select(
        *[F.col(f"`{c}`") for c in docs.columns], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        none("items", "array<long>"), none("spans", "array<struct<first:long,last:long>>"))


def without_spans(text: str | None, spans: list[dict]) -> str | None:
    """``text`` without the characters from each span's first word to its last."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for span in spans:
        out.append(text[at : places[span["first"]][0]])
        at = places[span["last"] - 1][1]
    return "".join([*out, text[at:]])


def with_passages_removed(found: DataFrame, text: str = "text") -> DataFrame:
    """``clean_text``: the texts without the spans found by ``find_benchmark_passages``."""
    found = without(found, ["clean_text"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = map(without_spans, batch.column(text).to_pylist(), batch.column("spans").to_pylist())
            yield batch.append_column("clean_text", pa.array(list(clean), pa.string()))

    return with_package(found).mapInArrow(mapped, extended(found, "clean_text string"))
