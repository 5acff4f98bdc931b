"""The cuckoo line index under false positives and growth; the URL tree at any depth; clashing inner names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesight.llm import cuckoo, line_dedup, url_filter


def state(index):
    return sorted(map(tuple, index.counts.select("hi", "lo", "n", "top").collect())), sorted(map(tuple, index.refs.collect()))


def marks(index):
    return {r.shard: cuckoo.CuckooFilter.from_bytes(bytes(r.filter), index.mark_bits) for r in index.filters.collect()}


def assert_whole(index):
    """Every key of the counts is known and has one row and one mark."""
    filters, by_shard = marks(index), {}
    rows = index.counts.collect()
    assert len({(r.hi, r.lo) for r in rows}) == len(rows)
    for r in rows:
        by_shard.setdefault(r.shard, []).append((r.hi, r.lo))
    for shard, keys in by_shard.items():
        pairs = np.array(keys, dtype=np.int64)
        hashes = pairs[:, 0].view(np.uint64) ^ (pairs[:, 1].copy().view(np.uint64) << np.uint64(1))
        assert filters[shard].contains(hashes).all()
    assert {s: len(f) for s, f in filters.items() if len(f)} == {s: len(k) for s, k in by_shard.items()}


def test_adding_and_removing_is_reversible_with_marks_of_four_bits(spark, make):
    rows = [(i, "\n".join(f"line number {i * 40 + j:07d} of the text" for j in range(40)) + "\na line that every text has in it") for i in range(30)]
    refs = lambda low, high: line_dedup.references(make(rows).where(F.col("doc_id").between(low, high)))
    first = line_dedup.LineIndex.empty(spark, 2, mark_bits=4).add(refs(0, 9))
    both = first.add(refs(10, 29))
    assert_whole(both)
    ids = spark.createDataFrame([(i,) for i in range(10, 30)], "id long")
    back = both.remove(ids)
    assert_whole(back)
    assert state(back) == state(first)
    again = back.add(refs(10, 29))
    assert_whole(again)
    assert state(again) == state(both)


def test_removing_a_key_without_a_mark_is_refused():
    f = cuckoo.CuckooFilter.for_keys(100)
    keys = np.arange(1, 50, dtype=np.uint64)
    assert f.insert(keys)
    before = f.table.copy()
    with pytest.raises(KeyError):
        f.remove(np.array([10**15], dtype=np.uint64))
    assert (f.table == before).all()


def test_shards_are_dealt_anew_when_they_outgrow_their_bound(spark, make):
    rows = [(i, "\n".join(f"line number {i * 50 + j:07d} of the text" for j in range(50))) for i in range(20)]
    refs = line_dedup.references(make(rows))
    small = line_dedup.LineIndex.empty(spark, 1, shard_keys=100)
    grown = small.add(refs.where("doc_id < 3")).add(refs.where("doc_id >= 3"))
    assert grown.shards == 16 and grown.counts.count() == 1000
    assert_whole(grown)
    assert state(grown) == state(line_dedup.LineIndex.empty(spark, 1).add(refs))


def test_inner_names_may_be_taken(make):
    rows = [(i, f"own line of text number {i}\nthe same line in all of the texts") for i in range(5)]
    docs = make(rows).withColumns({c: F.lit("mine") for c in ("_doc", "_keys", "keys", "__doc", "n_lines")})
    got = line_dedup.deduplicated(docs)
    assert got.count() == 5 and {(r._doc, r._keys, r.keys, r["__doc"]) for r in got.collect()} == {("mine",) * 4}
    assert sum(r.n_dropped for r in got.collect()) == 4
    pages = docs.select(F.concat(F.lit("http://a.net/x/"), "doc_id").alias("url"), *[F.lit(7).alias(c) for c in ("_h", "_p", "_segment", "n", "given")])
    assert {(r._h, r._p, r._segment, r.n, r.given) for r in url_filter.filter_urls(pages).collect()} == {(7,) * 5}


def test_sections_are_told_apart_at_any_depth(spark):
    deep = "/".join(f"s{i}" for i in range(11))
    rules = (url_filter.Rule(f"a.net/{deep}/bad/1", False), url_filter.Rule(f"a.net/{deep}/good/1", True))
    urls = [f"http://a.net/{deep}/{kind}/{i}" for kind in ("bad", "good") for i in range(100, 300)]
    urls += ["http://a.net/" + "/".join(str(i) for i in range(60)), "http://a.net/", "http://a.net"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r for r in url_filter.filter_urls(pages, rules=rules).collect()}
    assert all(got[u].verdict == ("block" if "/bad/" in u else "allow") for u in urls)
    assert got[f"http://a.net/{deep}/bad/250"].template.endswith("/bad/<n>")
    assert got[urls[-3]].template == "/<n>" * 60 and got[urls[-2]].template == "/" and got[urls[-1]].template == ""
    shallow = {r.url: r for r in url_filter.filter_urls(pages, rules=rules, max_depth=3).collect()}
    assert len({r.template for u, r in shallow.items() if "/s10/" in u}) == 1
