"""Repeated passages by a sparse suffix array over all texts.

Only suffixes at minimiser positions are retained: in every run of ``STRIDE``
words the one whose next ``GRAM`` words hash smallest. Any passage of ``LENGTH``
words has its first such position within its first ``STRIDE`` words, at the
same offset in every copy, with at least ``CORE`` words of the passage to the
right of it. The retained suffixes
of all texts are sorted by their next ``CORE`` words, over as many tasks as
there are ranges, and neighbours are compared word by word: equal ones of
different texts are the candidates. Each candidate is extended left and right to
all passages of ``LENGTH`` words that hold it; extending neighbours alone would
miss a pair that is further apart in the order but agrees further to the left.
Extended passages are compared by 128 bits of hash; one counts if it occurs in
another document too. The union of these passages
is exact: every word of every passage of LENGTH words that two documents share.
Whole copies of a text are found by its digest first and extended once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesight.llm.common import WORD, extended, own_names, with_package
from lakesight.session import materialise

LENGTH = 50
STRIDE = 40
GRAM = 4
CORE = LENGTH - STRIDE + 1
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, so that powers can be divided out


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if count else out


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Hash of any run of words of a text from prefix sums."""

    def __init__(self, words: np.ndarray, base: int = _BASES[0]):
        self.size = len(words)
        self.inverse = _powers(pow(base, -1, 1 << 64), self.size + 1)
        self.sums = np.zeros(self.size + 1, dtype=np.uint64)
        np.cumsum(words * _powers(base, self.size), out=self.sums[1:])

    def hashes(self, first: np.ndarray, length: int) -> np.ndarray:
        x = (self.sums[first + length] - self.sums[first]) * self.inverse[first]
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(31)


def minimisers(rolling: Rolling) -> np.ndarray:
    """For each start of a ``LENGTH``-word passage the position of its suffix (ascending)."""
    passages = rolling.size - LENGTH + 1
    if passages <= 0:
        return np.zeros(0, dtype=np.int64)
    grams = rolling.hashes(np.arange(passages + STRIDE - 1), GRAM)
    # smallest of each run by doubling spans; the position breaks ties
    best, span = np.arange(len(grams)), 1
    while span < STRIDE:
        step = min(span, STRIDE - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    return best


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray, list | None]]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            yield row


def _gathered(rows: Iterator[tuple[np.ndarray, ...]], build) -> Iterator[pa.RecordBatch]:
    """``build`` of the concatenated arrays of several documents, up to a bounded number of rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= 1 << 17:
            yield build(*(np.concatenate(c) for c in zip(*held)))
            held, size = [], 0
    if held:
        yield build(*(np.concatenate(c) for c in zip(*held)))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, core, digest): the different suffixes of each text, however often it repeats them, once per task for all its copies.

    ``words`` orders suffixes: 32 bits of each of the next ``CORE`` words in turn; ``core`` is a hash of them.
    """
    def rows():
        seen: set[int] = set()
        for digest, text in _documents(batches):
            if digest in seen:
                continue
            seen.add(digest)
            words = word_hashes(text)
            rolling = Rolling(words)
            at = np.unique(minimisers(rolling))
            if len(at):
                cores, first = np.unique(rolling.hashes(at, CORE).view(np.int64), return_index=True)
                yield cores, (words >> np.uint64(32)).astype(">u4")[at[first][:, None] + np.arange(CORE)], np.full(len(cores), digest)

    return _gathered(rows(), lambda core, words, digest: pa.record_batch([_binary(words), pa.array(core), pa.array(digest)], names=["words", "core", "digest"]))


def _binary(words: np.ndarray) -> pa.Array:
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * CORE), len(words), [None, pa.py_buffer(words.tobytes())])
    return flat.cast(pa.binary())


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, core, digest, edge) of the sorted suffixes that equal a neighbour of another text, and of the first and last of the range."""
    def found(words: np.ndarray, core: np.ndarray, digest: np.ndarray, chosen: np.ndarray, edge: bool) -> pa.RecordBatch:
        return pa.record_batch([_binary(words[chosen]), pa.array(core[chosen]), pa.array(digest[chosen]), pa.array([edge] * len(chosen), pa.bool_())],
                               names=["words", "core", "digest", "edge"])

    held = None  # the last row so far, whose neighbour behind is not known yet
    for batch in batches:
        if not batch.num_rows:
            continue
        words = np.frombuffer(b"".join(batch.column("words").to_pylist()), dtype=">u4").reshape(-1, CORE)
        rows = words, batch.column("core").to_numpy(), batch.column("digest").to_numpy()
        if held is None:
            yield found(*rows, np.zeros(1, dtype=np.int64), True)
        else:
            rows = tuple(np.concatenate(pair) for pair in zip(held, rows))
        words, _, digest = rows
        same = (words[1:] == words[:-1]).all(axis=1) & (digest[1:] != digest[:-1])
        shared = np.zeros(len(digest), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        yield found(*rows, np.flatnonzero(shared), False)  # a held row may come twice; candidates are sets
        held = tuple(x[-1:] for x in rows)
    if held is not None:
        yield found(*held, np.zeros(1, dtype=np.int64), True)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(passage, more, doc, first): all passages that hold a candidate, each once per document with all its starts."""
    def rows():
        for doc, text, candidates in _documents(batches):
            words = word_hashes(text)
            rolling, other = Rolling(words), Rolling(words, _BASES[1])
            of = minimisers(rolling)
            first = np.flatnonzero(np.isin(rolling.hashes(of, CORE).view(np.int64), np.array(candidates)))
            passages, more = (r.hashes(first, LENGTH).view(np.int64) for r in (rolling, other))
            by = np.lexsort((first, more, passages))
            passages, more, first = passages[by], more[by], first[by]
            new = np.ones(len(first), dtype=bool)
            new[1:] = (passages[1:] != passages[:-1]) | (more[1:] != more[:-1])
            at = np.flatnonzero(new)
            yield passages[at], more[at], np.full(len(at), doc), np.diff(at, append=len(first)), first

    def build(passages: np.ndarray, more: np.ndarray, docs: np.ndarray, times: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(times)]).astype(np.int32)
        starts = pa.ListArray.from_arrays(pa.array(ends), pa.array(first, pa.int32()))
        return pa.record_batch([pa.array(passages), pa.array(more), pa.array(docs), starts], names=["passage", "more", "doc", "first"])

    return _gathered(rows(), build)


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(passages: doc, first, keeper), (copies: doc, of, n_words).

    ``passages`` has the starts of every passage of LENGTH words that different
    texts hold, for the smallest id of each text, with the smallest id of all.
    ``copies`` has the ids of texts that several documents have. Rows without an
    id are left out; repeated rows of an id are one document; null, empty and
    short texts hold no passage; other columns are not looked at.
    """
    named = docs.select(
        F.col(f"`{id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("digest")).where("doc IS NOT NULL")
    suffixes = with_package(named).select("digest", "text").mapInArrow(_suffixes, "words binary, core long, digest long")
    # ranges are cut by words and text, so that a hot suffix is spread over tasks; it then stands at their edges
    ordered = suffixes.repartitionByRange("words", "digest").sortWithinPartitions("words", "digest")
    compared = materialise(with_package(ordered).mapInArrow(_neighbours, "words binary, core long, digest long, edge boolean"))
    edges = compared.where("edge")
    across = edges.groupBy("words").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("words")
    shared = compared.where("NOT edge").select("digest", "core").unionByName(edges.join(across, "words").select("digest", "core"))
    candidates = shared.groupBy("digest").agg(F.collect_set("core").alias("cores"))
    texts = named.select("doc", "digest", F.md5("text").alias("md5"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    texts = materialise(texts.where(F.col("n_words") >= LENGTH))
    owners = materialise(texts.groupBy("md5").agg(
        F.min("doc").alias("of"), F.max("doc").alias("last"), F.min("digest").alias("digest")))
    copies = texts.join(owners.where("of < last").select("md5", "of"), "md5").select("doc", "of", "n_words").distinct()
    wanted = candidates.join(owners.select("digest", F.col("of").alias("owner"), F.col("md5").alias("of_text")), "digest").drop("digest")
    # an id may stand in repeated rows, even with different texts
    first = named.join(wanted, (F.col("doc") == F.col("owner")) & (F.md5("text") == F.col("of_text"))).select("doc", "text", "cores")
    passages = materialise(with_package(first).mapInArrow(_extended, "passage long, more long, doc long, first array<int>"))
    twice = passages.groupBy("passage", "more").agg(F.min("doc").alias("keeper"), F.max("doc").alias("high")).where("keeper < high").drop("high")
    return passages.join(twice, ["passage", "more"]).select("doc", "first", "keeper"), copies


def _spans(starts):
    """Union of passages at ascending ``starts`` as (first, last excluded)."""
    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), (s + LENGTH).alias("last"))))
        return F.when((F.size(acc) > 0) & (last["last"] >= s), joined).otherwise(
            F.concat(acc, F.array(F.struct(s.alias("first"), (s + LENGTH).alias("last")))))

    return F.aggregate(starts, F.array().cast("array<struct<first:int,last:int>>"), step)


def _covered(starts):
    """Words covered by passages at ascending ``starts``."""
    zero = F.struct(F.lit(-LENGTH).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, s: F.struct(s.alias("last"), (acc["total"] + F.least(F.lit(LENGTH), s - acc["last"])).alias("total"))
    return F.aggregate(starts, zero, step)["total"]


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document that shares a passage: id, n_repeated, n_removed, spans, removed.

    ``spans`` are word ranges [first, last) shared with other documents;
    ``removed`` those that a smaller id holds too, so that the smallest keeps
    them. Documents without a shared passage of 50 words have no row, and so
    have null and empty texts, rows without an id and empty tables. Of equal
    passages within one document none is removed.
    """
    passages, copies = repeated_passages(docs, id, text)
    shared = passages.groupBy("doc").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("first")))).alias("all"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("keeper") < F.col("doc"), F.col("first")))))).alias("later"))
    # a copied text is repeated as a whole, and all its documents but the smallest lose it
    joined = shared.join(copies.withColumnRenamed("doc", "copy"), F.col("doc") == F.col("copy"), "full")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last")))
    later = F.coalesce("later", F.array().cast("array<int>"))
    copied, lost = F.col("copy").isNotNull(), F.col("copy") > F.col("of")
    return joined.select(
        F.coalesce("doc", "copy").alias(id),
        F.when(copied, F.col("n_words")).otherwise(_covered(F.col("all"))).alias("n_repeated"),
        F.when(lost, F.col("n_words")).otherwise(_covered(later)).alias("n_removed"),
        F.when(copied, whole).otherwise(_spans(F.col("all"))).alias("spans"),
        F.when(lost, whole).otherwise(_spans(later)).alias("removed"))


@own_names(["clean_text"], "id", "text")
def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with clean_text: the words left when removed spans are cut, joined by blanks; other texts unchanged."""
    spans = repeated_spans(docs, id, text).select(F.col(id).alias("_doc"), F.col("removed").alias("_removed"))
    joined, given = docs.join(spans, F.col(f"`{id}`") == F.col("_doc"), "left").drop("_doc"), docs.columns

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for content, removed in zip(batch.column(text).to_pylist(), batch.column("_removed").to_pylist()):
                if removed:
                    words = content.encode("utf-8", "surrogatepass").split()
                    keep = np.ones(len(words), dtype=bool)
                    for span in removed:
                        keep[span["first"] : span["last"]] = False
                    content = b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "surrogatepass")
                clean.append(content)
            yield pa.record_batch([*(batch.column(c) for c in given), pa.array(clean, pa.string())], names=[*given, "clean_text"])

    return with_package(joined).mapInArrow(mapped, extended(docs, "clean_text string"))
