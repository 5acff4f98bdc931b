"""Alignment of the tokens of a byte-level tokenizer (A) and a piece tokenizer (B) over the same bytes.

Each text's tokens of A and of B end at ascending byte offsets. All documents
of a batch are merged at once: one state vector holds a pointer into A and one
into B per document, every step compares the two ends, emits a link and a cut
where they are equal, and moves the pointer with the smaller end (both, if
equal). Finished documents are taken out of the vector. The merge can start
anywhere, so long texts are dealt to several places of the vector.

Tokens whose ranges end together are such that one's bytes end with the
other's: the vocabularies bound the number of different pairs, whatever the
size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesight.llm.common import slices, with_package
from lakesight.llm.token_output import Encoder
from lakesight.session import materialise

SLICE_BYTES = 4 << 20
KEPT_WORDS = 300_000  # words whose pieces a worker keeps
LANE_BYTES = 4096  # bytes of a text that one place of the state vector merges
PIECE_BLANK = "▁"
ALIGNED = """row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,
    links array<struct<a: int, b: int, times: int>>"""


class Vocabulary:
    """Bytes of every id, as one array."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ``ids``, one after the other."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteTokenizer(Encoder):
    """Tokenizer A; the strings of its special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()
        alphabet, entries = byte_alphabet(), self.tokenizer.get_vocab()
        tokens = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            tokens[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.vocabulary = Vocabulary(tokens)

    def encode_after_blank(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number per text) of a blank and each text.

        The tokenizer's pattern never looks back and ends a match before a
        blank, so a letter in front, which is a token of its own, changes
        nothing behind it and keeps the blank from the text's start.
        """
        ids, number = self.encode(pc.binary_join_element_wise("x", column, " "))
        first = np.zeros(len(ids), dtype=bool)
        first[np.cumsum(number) - number] = True
        return ids[~first].astype(np.int64), number - 1


class PieceTokenizer:
    """Tokenizer B, with the ids of words kept.

    No piece has a blank mark after another character, so no merge crosses the
    blank before a word, and a text of words with single blanks is put together
    from its words' ids. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.by_words = not any(PIECE_BLANK in p.lstrip(PIECE_BLANK) for p in pieces)
        self.vocabulary = Vocabulary([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(PIECE_BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.words: dict[str, list[int]] = {}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number per text); the model itself puts a blank in front."""
        column = pc.fill_null(column, "")
        odd = np.asarray(pc.match_substring_regex(column, rf"^ | $|  |{PIECE_BLANK}|^$")) if self.by_words else np.ones(len(column), dtype=bool)
        out: list = [None] * len(column)
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.model.encode(column[i].as_py()), dtype=np.int64)
        plain = np.flatnonzero(~odd)
        if len(plain):
            parts = pc.split_pattern(column.take(pa.array(plain)), " ")
            coded = parts.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            new = [w for w in names if w not in self.words]
            if len(new) + len(self.words) > KEPT_WORDS:
                self.words.clear()
                new = names
            self.words.update(zip(new, self.model.encode(new, num_threads=1)))
            ids = [self.words[w] for w in names]
            number = np.array([len(x) for x in ids], dtype=np.int64)
            every = np.array([i for x in ids for i in x], dtype=np.int64)
            at = np.asarray(coded.indices)
            sizes = number[at]
            ends = np.cumsum(sizes)
            every = every[np.repeat((np.cumsum(number) - number)[at] - ends + sizes, sizes) + np.arange(ends[-1])]
            edges = np.concatenate([[0], ends])[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
            if not odd.any():
                return every, np.diff(edges)
            for i, a, b in zip(plain, edges, edges[1:]):
                out[i] = every[a:b]
        return np.concatenate([np.zeros(0, dtype=np.int64), *out]), np.array([len(x) for x in out], dtype=np.int64)


@cache
def tokenizers(path_a: str, path_b: str) -> tuple[ByteTokenizer, PieceTokenizer]:
    return ByteTokenizer(path_a), PieceTokenizer(path_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ends_a`` and ``ends_b`` (both ascending) of the ends they share, by merging all lanes between ``edges`` at once."""
    a, b = np.searchsorted(ends_a, edges, "right"), np.searchsorted(ends_b, edges, "right")
    a, stop_a, b, stop_b = a[:-1], a[1:], b[:-1], b[1:]
    met_a, met_b = np.zeros(len(ends_a), dtype=bool), np.zeros(len(ends_b), dtype=bool)
    while True:
        on = (a < stop_a) & (b < stop_b)
        if not on.all():  # finished lanes leave the vector
            a, stop_a, b, stop_b = a[on], stop_a[on], b[on], stop_b[on]
        if not len(a):
            return np.flatnonzero(met_a), np.flatnonzero(met_b)
        x, y = ends_a[a], ends_b[b]
        met = x == y
        met_a[a[met]] = True
        met_b[b[met]] = True
        a, b = a + (x <= y), b + (y <= x)


def lanes(sizes: np.ndarray) -> np.ndarray:
    """Ascending byte offsets that cut texts of ``sizes`` bytes, laid end to end, into lanes."""
    ends = np.cumsum(sizes)
    pieces = -(-sizes // LANE_BYTES)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.unique(np.concatenate([[0], np.repeat(ends - sizes, pieces) + nth * LANE_BYTES, ends]))


@cache
def _digits(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids below ``count``, right-justified before a free byte, and which bytes are used."""
    width = len(str(max(count - 1, 1)))
    ids = np.arange(count)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    used = ids > 0
    used[:, -1] = True
    return np.pad((ids % 10 + 48).astype(np.uint8), ((0, 0), (0, 1))), np.pad(used, ((0, 0), (0, 1)), constant_values=True)


def rendered(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2,b3;`` for all groups, and the offset behind each group.

    ``cut_a`` and ``cut_b`` are the places of the groups' last tokens.
    """
    group_a = np.searchsorted(cut_a, np.arange(len(a)), "left")
    group_b = np.searchsorted(cut_b, np.arange(len(b)), "left")
    before = np.concatenate([[0], cut_b + 1])  # tokens of B in the groups before
    order_a, order_b = np.arange(len(a)) + before[group_a], np.arange(len(b)) + cut_a[group_b] + 1
    count = int(max(a.max(initial=0), b.max(initial=0))) + 1
    table, used = _digits(1 << count.bit_length())
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[order_a], ids[order_b] = a, b
    mark = np.full(len(ids), ord(","), dtype=np.uint8)
    mark[order_a[cut_a]], mark[order_b[cut_b]] = ord("|"), ord(";")
    cells = table[ids]
    cells[:, -1] = mark
    kept = used[ids]
    return cells[kept], np.cumsum(kept.sum(axis=1))[order_b[cut_b]]


class Aligned:
    """The texts of one slice, aligned: per text its tokens' numbers, cuts and links."""

    def __init__(self, column: pa.Array, path_a: str, path_b: str):
        left, right = tokenizers(path_a, path_b)
        column = pc.fill_null(column, "")
        self.size = len(column)
        ids_a, n_a = left.encode_after_blank(column)
        ids_b, n_b = right.encode(column)
        sizes = np.asarray(pc.binary_length(column)).astype(np.int64) + 1
        good = self._same_bytes(column, sizes, left.vocabulary, ids_a, n_a) & self._same_bytes(column, sizes, right.vocabulary, ids_b, n_b)
        good &= sizes > 1
        self.a, self.b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        self.n_a, self.n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        self.ends = np.cumsum(left.vocabulary.lengths[self.a])  # byte offsets over all good texts, laid end to end
        self.cut_a, self.cut_b = lockstep(self.ends, np.cumsum(right.vocabulary.lengths[self.b]), lanes(sizes[good]))
        self.first_group = np.searchsorted(self.cut_a, np.concatenate([[0], np.cumsum(self.n_a)]), "left")
        self.n_groups = np.diff(self.first_group)

    @staticmethod
    def _same_bytes(column: pa.Array, sizes: np.ndarray, vocabulary: Vocabulary, ids: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which texts' joined tokens are a blank and the text."""
        lengths = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])
        edges = lengths[np.concatenate([[0], np.cumsum(number)])]
        good = np.diff(edges) == sizes
        got = vocabulary.joined(ids[np.repeat(good, number)])
        want = np.frombuffer(b"".join(b" " + t.encode() for t, g in zip(column.to_pylist(), good) if g), dtype=np.uint8)
        ends = np.cumsum(sizes[good])
        wrong = np.unique(np.searchsorted(ends, np.flatnonzero(got != want), "right"))
        good[np.flatnonzero(good)[wrong]] = False
        return good

    def groups(self) -> list[bytes]:
        """The text form of each document's groups."""
        flat, behind = rendered(self.a, self.b, self.cut_a, self.cut_b)
        edges = np.concatenate([[0], behind])[self.first_group]
        whole = flat.tobytes()
        return [whole[x : y - 1] if y > x else b"" for x, y in zip(edges, edges[1:])]

    def cuts(self) -> list[np.ndarray]:
        """Byte offsets in each text at which tokens of both kinds end; the blank in front is offset 0 to 1."""
        base = np.concatenate([[0], self.ends])[np.cumsum(self.n_a) - self.n_a]
        return [self.ends[self.cut_a[x:y]] - z for x, y, z in zip(self.first_group, self.first_group[1:], base)]

    def links(self) -> pa.Array:
        """Per document the distinct linked pairs with the number of their links."""
        doc = np.repeat(np.arange(self.size), self.n_groups)
        a, b = self.a[self.cut_a], self.b[self.cut_b]
        order = np.lexsort((b, a, doc))
        doc, a, b = doc[order], a[order], b[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        times = np.diff(first, append=len(doc))
        pairs = pa.StructArray.from_arrays(
            [pa.array(v, pa.int32()) for v in (a[first], b[first], times)], names=["a", "b", "times"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(self.size + 1)), pa.int32()), pairs)


def aligned(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: numbers of tokens, groups and links, digest of the groups, distinct linked pairs.

    Defined cases: a null or empty text, or one whose joined tokens are not its
    bytes behind a blank, has no tokens, no links and '' for the digest;
    repeated rows each get their row; other columns are left out. ``row``
    numbers the rows of one run and means nothing beyond it.
    """
    source = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SLICE_BYTES):
            found = Aligned(batch.column("text"), path_a, path_b)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups()]
            numbers = [pa.array(v, pa.int64()) for v in (found.n_a, found.n_b, found.n_groups, found.n_groups)]
            yield pa.record_batch(
                [pa.array(np.arange(row, row + found.size)), batch.column("doc_id"), *numbers, pa.array(digests, pa.string()), found.links()],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
            row += found.size

    return with_package(source).mapInArrow(mapped, ALIGNED)


def alignments(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, groups, cuts): each text's groups written out, and the byte offsets of their ends. Cases as in ``aligned``."""
    source = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = Aligned(batch.column("text"), path_a, path_b)
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([g.decode() for g in found.groups()], pa.string()),
                pa.array([c.astype(np.int32) for c in found.cuts()], pa.list_(pa.int32()))], names=["doc_id", "groups", "cuts"])

    return with_package(source).mapInArrow(mapped, "doc_id long, groups string, cuts array<int>")


def most_pairs(path_a: str, path_b: str) -> int:
    """Bound on the number of different linked pairs: one token's bytes end with the other's."""
    left, right = (t.vocabulary.tokens for t in tokenizers(path_a, path_b))
    number: list[dict[bytes, int]] = []
    for tokens in (left, right):
        counted: dict[bytes, int] = {}
        for t in tokens:
            counted[t] = counted.get(t, 0) + 1
        number.append(counted)
    shorter = lambda tokens, other, first: sum(other.get(t[i:], 0) for t in tokens for i in range(first, len(t)))
    return shorter(left, number[1], 0) + shorter(right, number[0], 1)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each pair over all rows of ``aligned``, and whether no pair of the same b has more."""
    pairs = found.select(F.inline("links")).groupBy("a", "b").agg(F.sum("times").alias("n"))
    pairs = materialise(pairs)
    highest = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return materialise(pairs.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``aligned`` with n_best (links of the best pairs of their b) and count_sum (the pairs' counts, summed over the links).

    The counts are broadcast: ``most_pairs`` bounds them by the vocabularies,
    a few megabytes however large the corpus is.
    """
    found = materialise(aligned(docs, path_a, path_b, id, text))
    pair = lambda: F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair")
    counts = pair_counts(found).select(pair(), "n", "best")
    small = counts.count() <= most_pairs(path_a, path_b)
    links = found.select("row", F.inline("links")).select("row", pair(), "times")
    joined = links.join(F.broadcast(counts) if small else counts, "pair")
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
