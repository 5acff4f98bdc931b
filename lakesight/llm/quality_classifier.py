"""Quality scores by histogram gradient-boosted trees over statistics of whole texts.

A map turns each text into a row of numbers. Labelled rows are joined with
these numbers, never with texts. The model is fitted on at most
``TRAINING_ROWS`` of them (in expectation), chosen by a hash of their content:
values become bins, each level of a tree sums gradients per (node, feature,
bin), and the best cuts split all nodes of the level at once. All trees are
flattened into arrays, and a batch of rows walks down all of them together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesight.llm.common import slices, with_package
from lakesight.session import materialise

TRAINING_ROWS = 50_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST_WEIGHT = 1.0  # sum of second derivatives below which no node is made
SHRINKAGE = 1.0
PREDICT_FROM = 0.3
SCORED = "doc_id long, score double"

#: Kinds of bytes whose share of the text is a statistic.
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" ", "line end": b"\n",
    "other space": b"\t\x0b\x0c\r", "stop": b".", "comma": b",", "question": b"!?", "colon": b":;", "quote": b"'\"`", "bracket": b"()[]{}",
    "slash": b"/\\", "bar": b"|", "symbol": b"#$%&*+<=>@^_~", "dash": b"-", "beyond": bytes(range(128, 256)),
}
_KIND_OF = np.zeros(256, dtype=np.uint8)
for _i, _members in enumerate(_KINDS.values(), 1):
    _KIND_OF[list(_members)] = _i
STATISTICS = [
    *(f"share of {k}" for k in _KINDS), "log bytes", "log words", "log lines", "bytes per word", "words per line", "share of different words",
    "share of the most frequent word", "share of words in repeated lines", "longest word", "words with a capital", "words in capitals",
    "words without letters or digits", "words ending in a symbol", "lines ending a sentence", "share of different two-word runs",
]


def _of_words(content: bytes) -> list[float]:
    """Statistics of one text's words and lines."""
    words, lines = content.split(), [line for line in content.split(b"\n") if line.strip()]
    n = len(words)
    if not n:
        return [0.0] * 15
    counted = Counter(words)
    seen: set[bytes] = set()
    repeated = 0
    for line in lines:
        if line in seen:
            repeated += line.count(b" ") + 1
        seen.add(line)
    capital = upper = bare = symbol = longest = 0
    for w, times in counted.items():
        longest = max(longest, len(w))
        if 65 <= w[0] <= 90:
            capital += times
        letters = w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        if not letters:
            bare += times
        elif letters.isupper():
            upper += times
        if w[-1] in b"#$%&*+<=>@^_~|!":
            symbol += times
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines)
    runs = len(set(zip(words, words[1:])))
    return [np.log1p(len(content)), np.log1p(n), np.log1p(len(lines)), len(content) / n, n / len(lines), len(counted) / n,
            max(counted.values()) / n, min(1.0, repeated / n), float(min(longest, 1000)), capital / n, upper / n, bare / n, symbol / n,
            ended / len(lines), runs / max(1, n - 1)]


def statistics_of(texts: list[str | None]) -> np.ndarray:
    """A row of ``STATISTICS`` per text; zeros for a null or empty one."""
    out = np.zeros((len(texts), len(STATISTICS)), dtype=np.float32)
    for row, text in zip(out, texts):
        content = (text or "").encode("utf-8", "surrogatepass")
        if content:
            kinds = np.bincount(_KIND_OF[np.frombuffer(content, dtype=np.uint8)], minlength=len(_KINDS) + 1)
            row[: len(_KINDS)] = kinds[1:] / len(content)
            row[len(_KINDS) :] = _of_words(content)
    return out


def document_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, statistics): one map over whole texts."""
    source = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = statistics_of(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "statistics"])

    return with_package(source).mapInArrow(mapped, "doc_id long, statistics array<float>")


@dataclass
class Trees:
    """All trees in flat arrays: a node's feature (-1: leaf), bin, first child (the second follows it) and value."""

    edges: np.ndarray  # (features, BINS - 1) upper edges of the bins
    roots: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    value: np.ndarray
    base: float

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, "left") for e, v in zip(self.edges, values.T)], axis=1).astype(np.uint8)

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Every row goes down every tree, one level of all trees at a time."""
        bins, rows = self.binned(values), np.arange(len(values))[:, None]
        node = np.broadcast_to(self.roots, (len(values), len(self.roots)))
        for _ in range(DEPTH):
            feature = self.feature[node]
            right = bins[rows, np.maximum(feature, 0)] > self.bin[node]
            node = np.where(feature < 0, node, self.child[node] + right)
        return self.base + self.value[node].sum(axis=1)

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(values)))


def fit(values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Trees:
    """Boosted trees for the logarithmic loss. Without rows, or with one label only, a constant near that label's share."""
    total = weights.sum()
    share = ((weights * labels).sum() + 0.5) / (total + 1)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.quantile(v, quantiles, method="lower") for v in values.T] if len(values) else [np.zeros(BINS - 1)] * values.shape[1]
    trees = Trees(np.array(edges, dtype=np.float32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64),
                  np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    if not 0 < (weights * labels).sum() < total:
        return trees
    bins, margins = trees.binned(values).astype(np.int64), np.full(len(values), trees.base)
    roots, nodes = [], []  # a node: [feature, bin, child, value]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margins))
        gradient, curvature = weights * (labels - p), weights * p * (1 - p)
        first = len(nodes)
        at = np.full(len(values), first)  # node of each row
        roots.append(first)
        nodes.append([-1, 0, 0, 0.0])
        level = [first]
        for depth in range(DEPTH + 1):
            low, count = level[0], len(level)
            here = at >= low
            local = at[here] - low
            g, h = (np.bincount(local, w[here], count) for w in (gradient, curvature))
            for i, node in enumerate(level):
                nodes[node][3] = RATE * g[i] / (h[i] + SHRINKAGE)
            if depth == DEPTH:
                break
            best, cut = np.full(count, 1e-9), np.zeros((count, 2), dtype=np.int64)
            for f in range(values.shape[1]):
                cell = local * BINS + bins[here, f]
                left_g, left_h = (np.bincount(cell, w[here], count * BINS).reshape(count, BINS).cumsum(axis=1) for w in (gradient, curvature))
                right_g, right_h = g[:, None] - left_g, h[:, None] - left_h
                gain = left_g**2 / (left_h + SHRINKAGE) + right_g**2 / (right_h + SHRINKAGE) - (g**2 / (h + SHRINKAGE))[:, None]
                gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
                b = gain.argmax(axis=1)
                better = gain[np.arange(count), b] > best
                best[better] = gain[np.arange(count), b][better]
                cut[better] = np.stack([np.full(count, f), b], axis=1)[better]
            split = np.flatnonzero(best > 1e-9)
            if not len(split):
                break
            child = np.zeros(count, dtype=np.int64)
            child[split] = len(nodes) + 2 * np.arange(len(split))
            for i in split:
                nodes[level[i]][:3] = [int(cut[i, 0]), int(cut[i, 1]), int(child[i])]
            moves = np.flatnonzero(here)[child[local] > 0]
            own = at[moves] - low
            at[moves] = child[own] + (bins[moves, cut[own, 0]] > cut[own, 1])
            level = list(range(len(nodes), len(nodes) + 2 * len(split)))
            nodes += [[-1, 0, 0, 0.0] for _ in level]
        margins += np.array([n[3] for n in nodes])[at]
    flat = list(zip(*nodes))
    trees.roots = np.array(roots)
    trees.feature, trees.bin, trees.child = (np.array(c, dtype=np.int64) for c in flat[:3])
    trees.value = np.array(flat[3])
    return trees


def is_held_out(id: Column) -> Column:
    """The fold whose labels are never looked at; a missing id belongs to it."""
    return F.coalesce(F.crc32(id.cast("string")) % 5, F.lit(0)) == 0


def training_rows(statistics: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(statistics, label, weight): equal rows of an id as one with a weight, and ``limit`` of them in expectation.

    Held-out ids are left out before any label is read. A row is drawn by the
    hash of its own content, so that a draw does not depend on partitions.
    """
    known = labels.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label"))
    known = known.where(~is_held_out(F.col("doc_id")) & F.col("label").isin(0.0, 1.0)).distinct()
    rows = statistics.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id", "statistics").agg(F.count("*").cast("double").alias("weight"))
    rows = materialise(rows.join(known, "doc_id"))
    number = rows.count()
    place = F.pmod(F.xxhash64("doc_id", "statistics", "label"), F.lit(1 << 30))
    return rows.withColumn("place", place).where(F.col("place") < int((1 << 30) * min(1.0, limit / max(1, number)))).drop("doc_id")


def fitted(rows: DataFrame) -> Trees:
    """The model of ``training_rows``; these bounded rows are all that the driver sees."""
    held = rows.select("statistics", "label", "weight").toArrow().combine_chunks()
    values = np.array(held.column("statistics").to_pylist(), dtype=np.float32).reshape(-1, len(STATISTICS))
    label, weight = (held.column(c).to_numpy().astype(np.float64) for c in ("label", "weight"))
    order = np.lexsort((weight, label, *values.T))  # the same sums in every run
    return fit(values[order], label[order], weight[order])


def scored(statistics: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score): probability of label 1 for every row."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                values = part.column("statistics").flatten().to_numpy().reshape(-1, len(STATISTICS))
                yield pa.record_batch([part.column("doc_id"), pa.array(trees.scores(values))], names=["doc_id", "score"])

    return with_package(statistics.select("doc_id", "statistics")).mapInArrow(mapped, SCORED)


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; predicted is 1 from a score of ``PREDICT_FROM`` on.

    Only the texts decide a score. Defined cases: a null or empty text has
    statistics of zero and is scored like any other; repeated rows each get
    their row; a row without an id is held out; labels other than 0 and 1 and
    labels of unknown ids are ignored, and an id with both counts once for
    each; without labels of both kinds every score is the same. Other columns
    are left out, whatever their names.
    """
    statistics = materialise(document_statistics(docs, id, text))
    trees = fitted(training_rows(statistics, labels, limit, id, label))
    return scored(statistics, trees).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
