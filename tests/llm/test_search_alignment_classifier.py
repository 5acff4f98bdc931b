"""Quality classifier, cross-tokenizer alignment and ranked search against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lakesight.llm import cross_tokenizer, quality_classifier, ranked_search
from lakesight.session import materialise
from tests.llm.test_operators import prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


# cross-tokenizer alignment

def plain_tokens(text):
    """(ids of A, byte ends of A, ids of B, byte ends of B), all empty where a tokenizer changes the text."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    left, right = cross_tokenizer.tokenizers(A, B)
    a, b = tokenizer.encode(f" {text}", add_special_tokens=False).ids, SentencePieceProcessor(model_file=B).encode(text)
    parts = [[v.vocabulary.tokens[i] for i in ids] for v, ids in ((left, a), (right, b))]
    if not text or any(b"".join(p) != f" {text}".encode() for p in parts):
        return [], [], [], []
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    return a, ends[0], b, ends[1]


def brute_alignments(rows):
    found, counts = [], Counter()
    for doc, text in rows:
        a, ends_a, b, ends_b = plain_tokens(text or "")
        links = [(i, j) for i, x in enumerate(ends_a) for j, y in enumerate(ends_b) if x == y] if len(a) < 500 else None
        if links is None:
            at = {y: j for j, y in enumerate(ends_b)}
            links = [(i, at[x]) for i, x in enumerate(ends_a) if x in at]
        counts.update((a[i], b[j]) for i, j in links)
        groups, i, j = [], 0, 0
        for x, y in links:
            groups.append(f"{','.join(map(str, a[i:x + 1]))}|{','.join(map(str, b[j:y + 1]))}")
            i, j = x + 1, y + 1
        found.append((doc, len(a), len(b), ";".join(groups), [(a[i], b[j]) for i, j in links]))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for doc, n_a, n_b, groups, links in found:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        yield doc, n_a, n_b, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest


def test_alignment_equals_plain_python(make, odd_rows):
    r = random.Random(5)
    parts = ["ab", "Z", " ", "  ", "\n", "\t", "'s", "é", "—", "…", "①", "漢", "🙂", "▁", "<|endoftext|>", "<s>", "\r\n", " ", "don't", "ﬁ", "\x00", ".", "9,0"]
    rows = [(r_[0], r_[1]) for r_ in odd_rows]
    rows += [(100 + i, "".join(r.choice(parts) for _ in range(r.randrange(30)))) for i in range(300)]
    rows += [(1000 + i, prose(i % 40, 60)) for i in range(60)]
    frame = make(rows).withColumn("links", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("n_a", F.lit("x"))
    got = Counter(map(tuple, cross_tokenizer.scored(frame, A, B).collect()))
    assert got == Counter(brute_alignments(rows))


def test_long_texts_are_merged_from_several_places(monkeypatch):
    text = pa.array([prose(3, 4000), "", prose(4, 30), None, prose(5, 900)])
    whole = cross_tokenizer.Aligned(text, A, B)
    monkeypatch.setattr(cross_tokenizer, "LANE_BYTES", 7)
    pieces = cross_tokenizer.Aligned(text, A, B)
    assert whole.groups() == pieces.groups() and whole.groups()[1] == b""
    assert [c.tolist() for c in whole.cuts()] == [c.tolist() for c in pieces.cuts()]
    assert whole.cuts()[2][-1] == len(prose(4, 30)) + 1


def test_groups_written_out(make):
    (row,) = cross_tokenizer.alignments(make([(1, "unbelievable tokenizations")]), A, B).collect()
    a, ends_a, b, ends_b = plain_tokens("unbelievable tokenizations")
    assert row.cuts == sorted(set(ends_a) & set(ends_b))
    sides = [g.split("|") for g in row.groups.split(";")]
    assert ",".join(s[0] for s in sides) == ",".join(map(str, a)) and ",".join(s[1] for s in sides) == ",".join(map(str, b))


def test_pairs_are_bounded_by_the_vocabularies():
    left, right = (t.vocabulary.tokens for t in cross_tokenizer.tokenizers(A, B))
    some = random.Random(1).sample(range(len(right)), 20)
    ends = sum(len(right[j]) > 0 and len(x) > 0 and (x.endswith(right[j]) or right[j].endswith(x)) for j in some for x in left)
    assert ends < cross_tokenizer.most_pairs(A, B) < 1_000_000


# ranked search

def brute_search(rows, items, top=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: pattern.findall((t or "").translate(lower))
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    big_n, big_l = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 25 + 75 * sum(c.values()) * big_n // big_l
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        for rank, (score, missing, d) in enumerate(sorted(scores)[:top], 1):
            yield item, rank, None if missing else d, -score


@pytest.mark.parametrize("sizes", [{}, {"QUERY_PAIRS": 40, "BROADCAST_KEYS": 3, "BITS_PER_ENTRY": 2, "BLOCK_DOCUMENTS": 16}])
def test_search_equals_plain_python(spark, make, odd_rows, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked_search, name, value)
    r = random.Random(2)
    rows = [(r_[0], r_[1]) for r_ in odd_rows]
    rows += [(100 + i, " ".join(r.choice("AbC dE fgh Ünï 12 x-y zz q1 q2 q3 q4 q5".split()) for _ in range(r.randrange(1, 40)))) for i in range(150)]
    rows += [(5000 - i, "the same text many times q1 q1 q2") for i in range(40)]
    items = [(1, "abc q1 q2"), (2, "abc q1 q2 q2 q3 zz nowhere"), (2, "12 ünï Ünï"), (3, None), (4, ""), (5, "nowhere else"), (None, "one two"), (6, "many same")]
    items += [(10 + i, " ".join(r.choice("abc de fgh q1 q2 q3 q4 q5 x y".split()) for _ in range(12))) for i in range(8)]
    docs = make(rows).withColumn("key", F.lit("clash")).withColumn("score", F.lit(0))
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit("clash"))
    index = materialise(ranked_search.build_index(docs))
    got = Counter(map(tuple, ranked_search.search(docs, index, queries).collect()))
    assert got == Counter(brute_search(rows, items))


def test_bounds_are_never_below_scores_and_rule_documents_out(spark, make):
    rows = [(i, prose(i, 40)) for i in range(400)]
    index = ranked_search.build_index(make(rows, 1))
    words = prose(7, 40).split()[:6]
    queries = ranked_search.Queries([0], sorted({w.encode() for w in words}), [(np.arange(len(set(words))), np.full(len(set(words)), 1000))], 400, 16_000, [(0, 0)])
    texts, ruled_out = dict(rows), 0
    for block in index.collect():
        block = block.asDict()
        bounds = dict(queries.bounds(block))
        for d, doc_id in enumerate(block["ids"]):
            bound = int(bounds[0][d]) if bounds else 0
            terms = ranked_search.terms_of(texts[doc_id])
            score = queries.score(0, Counter(terms), len(terms))
            assert bound >= score
            ruled_out += bound == 0
    assert ruled_out > 200


# quality classifier

def auc(scores, labels):
    order = sorted(zip(scores, labels))
    ranks, i = {}, 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        ranks[order[i][0]] = (i + 1 + j) / 2
        i = j
    good = sum(labels)
    return (sum(ranks[s] for s, y in order if y) - good * (good + 1) / 2) / (good * (len(labels) - good))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    known = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    assert len(known) > 40 and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    assert auc([r.score for r, _ in known], [q for _, q in known]) > 0.97
    assert sum(r.predicted == q for r, q in known) / len(known) > 0.9


def test_scores_do_not_see_ids_sources_or_held_out_labels(spark, make):
    r = random.Random(4)
    rows = [(i, prose(i, 40) if i % 3 else "BUY NOW!! " * 30 + prose(i, r.randrange(3, 9))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = make(rows + [(None, None), (900, ""), (901, prose(1, 40)), (901, prose(1, 40))])
    first = {(x.doc_id, x.score, x.predicted) for x in quality_classifier.classify(docs, labels).collect()}
    second = quality_classifier.classify(docs.withColumn("source", F.lit("t")).withColumn("statistics", F.lit(1)), turned)
    assert first == {(x.doc_id, x.score, x.predicted) for x in second.collect()}
    by_id = {d: (s, p) for d, s, p in first}
    assert len(by_id) == 303 and by_id[901] == by_id[1] and all(0 <= s <= 1 for s, _ in by_id.values())
    assert all(by_id[i][1] == int(i % 3 > 0) for i in range(300))


def test_one_label_or_none_gives_one_score(spark, make):
    docs = make([(i, prose(i, 30)) for i in range(20)])
    for rows in ([], [(i, 1) for i in range(20)], [(i, 7) for i in range(20)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert len({r.score for r in quality_classifier.classify(docs, labels).collect()}) == 1


def test_the_draw_is_bounded_and_repeated_rows_are_weights(spark, make):
    docs = make([(i, prose(i, 20)) for i in range(600)] + [(1000, prose(1, 30))] * 500)
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(1000, 1)], "doc_id long, quality int")
    statistics = materialise(quality_classifier.document_statistics(docs))
    whole = quality_classifier.training_rows(statistics, labels).collect()
    assert sum(r.weight for r in whole) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in [*range(600), *[1000] * 500])
    assert len(whole) < 605
    assert 60 < quality_classifier.training_rows(statistics, labels, limit=100).count() < 140


def test_flattened_trees_walk_like_nested_ones():
    random_ = np.random.default_rng(3)
    values = random_.random((500, 3)).astype(np.float32)
    labels = (values[:, 0] + values[:, 1] ** 2 > 0.8).astype(float)
    trees = quality_classifier.fit(values, labels, np.ones(500))
    bins = trees.binned(values)
    for row, margin in zip(bins[:40], trees.margins(values)):
        total = trees.base
        for node in trees.roots:
            while trees.feature[node] >= 0:
                node = trees.child[node] + (row[trees.feature[node]] > trees.bin[node])
            total += trees.value[node]
        assert math.isclose(total, margin)
    assert ((trees.scores(values) > 0.5) == labels).mean() > 0.97
