"""Token ids as blocks of frequency-ranked, variable-length bytes, written in ascending document order.

Format: a Parquet table with a row per block. ``part`` and ``seq`` order the
blocks; ``doc_ids`` and ``lengths`` list the documents; ``ids_by_frequency``
is the block's code table (little-endian uint32); ``control`` and ``data`` hold
the ranks (``varbytes``). A block can be decoded alone, and Spark commits and
reads the files in any store.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesight.llm import varbytes
from lakesight.llm.common import slices, with_package

END = 2
BLOCK_TOKENS = 1 << 20
CACHED_WORDS = 1_000_000
RANGE_CHARACTERS = 32  # of the text that parts rows of one id
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: a caret (it marks bare words), any white space but blanks and line ends, white space in a row or at an end, or nothing
_UNUSUAL = rf"\^|[{_SPACES}][{_SPACES}]|^[{_SPACES}]|[{_SPACES}]$|[\t\r\f\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]|^$"
BLOCKS = """part int, seq int, doc_ids array<long>, lengths array<long>, n_tokens long,
    ids_by_frequency binary, control binary, data binary"""


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts, as the tokenizer gives them, with the ids of words kept.

    The tokenizer's pattern always ends a match before a blank that a visible
    character follows, around a line end between two visible characters, and
    between a letter and a final full stop or comma. So a text whose white space
    is all of these kinds is put together from its words' ids; other texts are
    encoded as a whole. New words are encoded as one text, whose ids fall apart
    at the blanks or line ends between them.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.blank[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True  # ids whose bytes start with a blank
        (self.line_end,) = self._plain("\n")
        self._forget()

    def _forget(self) -> None:
        """Known words ("^word": without a blank before it) with the first and number of their ids in one array."""
        self.words = pa.array(["^\n"], pa.string())
        self.ids, self.first, self.number = np.array([self.line_end], dtype="<u4"), np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        all_ids, size, first, number, names = [self.ids], len(self.ids), [self.first], [self.number], []
        for bare in (False, True):
            group = [w for w in words if (w[0] == "^") is bare]
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                ids = self._plain("".join(f"\n{w[1:]}" if bare else f" {w}" for w in part))
                edges = np.flatnonzero(ids == self.line_end if bare else self.blank[ids])
                if len(edges) == len(part):
                    first.append(edges + size + bare)
                    number.append(np.diff(edges, append=len(ids)) - bare)
                else:  # a word does not fall apart from its neighbours; encode each by itself
                    each = [self._plain(w[1:] if bare else f" {w}") for w in part]
                    sizes = np.array([len(e) for e in each])
                    ids = np.concatenate(each)
                    first.append(np.cumsum(sizes) - sizes + size)
                    number.append(sizes)
                all_ids.append(ids)
                size += len(ids)
            names += group
        self.words = pa.concat_arrays([self.words, pa.array(names, pa.string())])
        self.ids, self.first, self.number = np.concatenate(all_ids), np.concatenate(first), np.concatenate(number)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text)."""
        column = pc.fill_null(column, "")
        whole = np.asarray(pc.match_substring_regex(column, _UNUSUAL))
        out: list = [None] * len(column)
        for i in np.flatnonzero(whole):
            out[i] = self._plain(column[i].as_py())
        plain = np.flatnonzero(~whole)
        if len(plain):
            every, numbers = self._by_words(column.take(pa.array(plain)))
            if not whole.any():
                return every, numbers
            for i, ids in zip(plain, np.split(every, np.cumsum(numbers)[:-1])):
                out[i] = ids
        return np.concatenate([np.zeros(0, dtype="<u4"), *out]), np.array([len(x) for x in out], dtype=np.int64)

    def _by_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring_regex(column, r"([a-zA-Z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,])( |\n|$)", r"\1 ^\2\3")
        marked = pc.binary_join_element_wise("^", pc.replace_substring(marked, "\n", " ^\n ^"), "")
        parts = pc.split_pattern(marked, " ")
        coded = parts.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, self.words)
        if place.null_count:
            if len(self.words) + place.null_count > CACHED_WORDS:
                self._forget()
                place = pc.index_in(coded.dictionary, self.words)
            self._learn(coded.dictionary.filter(place.is_null()).to_pylist())
            place = pc.index_in(coded.dictionary, self.words)
        word = np.asarray(place)[np.asarray(coded.indices)]
        number = self.number[word]
        ends = np.cumsum(number)
        every = self.ids[np.repeat(self.first[word] - ends + number, number) + np.arange(ends[-1])]
        edges = np.concatenate([[0], ends])[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
        return every, np.diff(edges)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded_blocks(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = END,
                   block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of ``docs`` in ascending order of ``id`` (nulls first, equal ids by the first characters of the text, and in a range by all of it).

    Rows of one id, or without any, are cut into ranges by these characters, and
    rows that agree in them by their number, so that no id is bound to one task. Defined cases: a
    null text is an empty one and has the end id alone; repeated rows each have
    their ids; an empty table has no blocks; other columns are left out.
    """
    ordered = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.substring(f"`{text}`", 1, RANGE_CHARACTERS).alias("start"),
                          F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"))
    ordered = ordered.repartitionByRange("id", "start", "row").sortWithinPartitions("id", "text").select("id", "text")

    names = T.StructType.fromDDL(BLOCKS).names

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lengths: list = []
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            by_frequency, ranks = varbytes.ranked(np.concatenate(held))
            control, data = varbytes.encode(ranks)
            row = [part, seq, doc_ids, lengths, size, by_frequency.astype("<u4").tobytes(), control, data]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=names)

        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in slices(batches, "text", 5 << 20):
            ids, sizes = encoder.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(sizes), end)
            doc_ids += batch.column("id").to_pylist()
            lengths += (sizes + 1).tolist()
            held.append(ids)
            size += len(ids)
            if size >= block_tokens:
                yield block()
                doc_ids, lengths, held, size, seq = [], [], [], 0, seq + 1
        if held:
            yield block()

    return with_package(ordered).mapInArrow(mapped, BLOCKS)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, **options) -> None:
    encoded_blocks(docs, tokenizer, **options).write.parquet(folder)


def decoded(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document, first token in the block, ids) for each document of a block."""
    ranks = varbytes.decode(row["control"], row["data"], row["n_tokens"])
    ids = np.frombuffer(row["ids_by_frequency"], dtype="<u4")[ranks]
    at = 0
    for doc_id, length in zip(row["doc_ids"], row["lengths"]):
        yield doc_id, at, ids[at : at + length]
        at += length


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and the ids on demand, per document of the files.

    ``start`` counts the ids of all documents before: block totals are summed
    per part, parts in order, so that one task sees a row per part and others a
    row per block of a part.
    """
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    fields = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = T.StructType.fromDDL(fields).names

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                documents = list(decoded(row))
                columns = [
                    pa.array([row["part"]] * len(documents), pa.int32()), pa.array([row["seq"]] * len(documents), pa.int32()),
                    pa.array([d for d, _, _ in documents], pa.int64()), pa.array([at for _, at, _ in documents], pa.int64()),
                    pa.array([len(ids) for _, _, ids in documents], pa.int64()),
                    pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, _, ids in documents], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids.astype(np.int32) for _, _, ids in documents], pa.list_(pa.int32())))
                yield pa.record_batch(columns, names=names)

    sizes = blocks.select("part", "seq", "n_tokens")
    earlier = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", "seq", F.coalesce(inside, F.lit(0)).alias("inside")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("before") + F.col("inside")).alias("first"))
    documents = with_package(blocks).mapInArrow(mapped, fields).join(starts, ["part", "seq"])
    return documents.select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
