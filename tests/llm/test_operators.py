"""Operators against brute force, planted cases and odd rows."""


import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakesight.llm import (
    cuckoo, decontamination, fm_index, golay, line_dedup, mixing, near_duplicates, pseudonyms, quality_rules, sharding, suffix_dedup,
    token_output, url_filter, varbytes,
)
from lakesight.llm.components import connected_components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(n))


# quality rules

def test_copies_do_not_condemn_their_own_lines(spark, make):
    copies = [(i, prose(1, 80) + "\n" + prose(2, 80)) for i in range(100)]
    menu = "\n".join(f"{prose(50 + j, 9)}" for j in range(9))
    sites = [(1000 + i, menu + "\n" + prose(2000 + i, 20)) for i in range(60)]
    clean = [(3000 + i, prose(3000 + i, 120) + "\n" + menu.split("\n")[0]) for i in range(60)]
    kept = {r.doc_id for r in quality_rules.kept(make(copies + sites + clean)).select("doc_id").collect()}
    assert kept == {d for d, *_ in copies + clean}


def test_quality_keeps_columns_and_cleans_texts(make):
    docs = make([(i, f"shared line of all\nown {prose(i, 60)}") for i in range(40)]).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(0))
    judged = quality_rules.judge(docs)
    assert judged.columns.count("kept") == 1 and judged.count() == 40 and dict(judged.dtypes)["kept"] == "boolean"
    assert quality_rules.kept(docs).columns == docs.columns
    assert {r.clean_text.split(" ")[0] for r in quality_rules.without_shared_lines(docs).collect()} == {"own"}


# decontamination

@given(st.lists(st.integers(1, 4), min_size=1, max_size=200), st.integers(1, 13))
@settings(max_examples=40, deadline=None)
def test_backward_search_finds_all_places(text, size):
    text = np.array(text)
    index = fm_index.FmIndex(text)
    patterns = {tuple(text[i : i + size]) for i in range(max(1, len(text) - size + 1))} | {(9,), (4, 4, 4)}
    rows, lengths = np.full((len(patterns), 13), -1), np.array([len(p) for p in patterns])
    for row, p in zip(rows, patterns):
        row[13 - len(p):] = p
    for p, low, high in zip(patterns, *index.search(rows, lengths)):
        want = [i for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(low, high)).tolist()) == want


@pytest.mark.parametrize("shard_words, block_bytes", [(1 << 20, 1 << 20), (64, 1 << 20), (64, 300)])
def test_passages_in_small_shards_and_blocks(spark, make, odd_rows, shard_words, block_bytes):
    items = [(i, prose(i, 30)) for i in range(12)] + [(50, "tiny item"), (51, None), (52, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = odd_rows[:3] + odd_rows[4:9]
    docs += [(100 + i, prose(500 + i, 90) + " " + prose(i, 30).upper() + "! " + prose(900 + i, 90)) for i in range(12)]
    docs += [(200, prose(5, 30) + " " + prose(6, 14)), (201, prose(7, 12)), (202, "a Tiny, item."), (203, prose(8, 30) * 40)]
    frame = make(docs).withColumn("spans", F.lit("clash"))
    found = decontamination.find_benchmark_passages(frame, benchmark, shard_words=shard_words, block_bytes=block_bytes)
    windows = defaultdict(set)
    for item, text in items:
        w = decontamination.words_of(text or "")
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    def brute(text):
        w, hit, got = decontamination.words_of(text or ""), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))):
                    hit.update(range(i, i + size))
                    got |= own
        return len(w), len(hit), tuple(sorted(got))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect())
    assert got == Counter((d[0], *brute(d[1])) for d in docs)
    clean = {r.doc_id: r.clean_text for r in decontamination.with_passages_removed(found).collect()}
    assert clean[202] == "a ." and decontamination.words_of(clean[105]) == decontamination.words_of(prose(505, 90) + " " + prose(905, 90))


# line dedup

def test_cuckoo_filter_inserts_and_deletes():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 30_000, dtype=np.uint64)
    f = cuckoo.CuckooFilter.for_keys(len(keys))
    assert f.insert(keys) and f.contains(keys).all() and len(f) == len(keys)
    f = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    f.remove(keys[:20_000])
    assert f.contains(keys[20_000:]).all() and len(f) == 10_000
    assert not cuckoo.CuckooFilter(4).insert(keys[:100])


def test_line_index_is_reversible(spark, make):
    shared, rare = "a line of more than twenty", "another line of some length"
    rows = [(i, "\n".join([f"own line of document {i:06d}", shared, "short"] + ([rare] if i < 3 else []))) for i in range(12)]
    docs = make(rows)
    refs = lambda low, high: line_dedup.references(docs.where(F.col("doc_id").between(low, high)))
    state = lambda x: (sorted(map(tuple, x.counts.select("hi", "lo", "n", "top").collect())), sorted(map(tuple, x.refs.collect())))
    first = line_dedup.LineIndex.empty(spark, 4).add(refs(0, 5))
    grown = first.add(refs(3, 11))
    assert state(grown.remove(spark.createDataFrame([(i,) for i in range(6, 12)], "id long"))) == state(first)
    assert {r.n for r in grown.counts.collect()} == {1, 3, 12}
    known = {r.shard: cuckoo.CuckooFilter.from_bytes(bytes(r.filter)) for r in grown.filters.collect()}
    assert sum(map(len, known.values())) == grown.counts.count()
    left = {r.doc_id: r for r in line_dedup.dedup(docs.withColumn("keys", F.lit(1)), grown).collect()}
    assert [left[i].n_dropped for i in range(12)] == [2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0]
    assert left[0].kept_text == "own line of document 000000\nshort" and left[11].kept_text == rows[11][1]
    nobody = grown.remove(docs.select("doc_id"))
    assert nobody.counts.count() == 0 and all(len(cuckoo.CuckooFilter.from_bytes(bytes(r.filter))) == 0 for r in nobody.filters.collect())


# repeated passages

def test_passages_of_fifty_words_are_found_exactly(make, odd_rows):
    passage = prose(77, 51)
    rows = [(100, f"{prose(1, 30)} {passage} {prose(2, 40)}"), (101, f"{passage} {prose(3, 9)}"), (102, f"{prose(4, 70)} {passage}"),
            (103, prose(5, 200)), (104, " ".join(passage.split()[:49])), (105, f"{prose(6, 60)} {prose(6, 60)}")]
    rows += [r for r in odd_rows if r[0] not in (4, 9)] + [(300, prose(8, 400)), (301, prose(8, 400)), (301, prose(8, 400))]
    found = {r.doc_id: r for r in suffix_dedup.repeated_spans(make(rows)).collect()}
    assert set(found) == {100, 101, 102, 300, 301}
    assert [(s["first"], s["last"]) for s in found[100].spans] == [(30, 81)] and found[100].n_removed == 0
    assert [(s["first"], s["last"]) for s in found[102].removed] == [(70, 121)] and found[301].n_removed == 400
    clean = {r.doc_id: r.clean_text for r in suffix_dedup.without_repeats(make(rows).withColumn("removed", F.lit(0))).collect()}
    assert clean[102] == prose(4, 70) and clean[101] == prose(3, 9) and clean[301] == "" and clean[103] == prose(5, 200) and clean[1] is None


# urls

def test_blocked_branches_are_learnt_per_host(spark):
    urls = [f"http://a.net/{kind}/{i}" for kind in ("ads", "news") for i in range(200)]
    rules = (url_filter.Rule("net/ads/1", False), url_filter.Rule("net/news/1", True))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.filter_urls(pages, rules=rules).collect()
    assert {(r.template, r.verdict) for r in got} == {("/ads/<n>", "block"), ("/news/<n>", "allow")} and len(got) == 400


@pytest.mark.parametrize("size", [1, 100])
def test_no_template_is_rejected_for_the_labels_of_others(spark, size):
    # 70 % of the labelled pages are blocked, all under /de/; /en/ has no label at all
    urls = [f"http://a.com/{kind}/{i}" for kind, n in (("de", 70), ("fr", 30), ("en", 100)) for i in range(n * size)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.filter_urls(pages)
    verdicts = {(r.section, r.verdict): r.n for r in got.groupBy(F.split("path", "/")[1].alias("section"), "verdict").agg(F.count("*").alias("n")).collect()}
    assert verdicts == {("de", "block"): 70 * size, ("fr", "allow"): 30 * size, ("en", "allow"): 100 * size}
    assert got.where("purity > 0.5 AND path NOT LIKE '/de/%'").count() == 0


def test_small_sections_of_a_broad_host_are_told_apart(spark):
    # 40 sections of a fortieth of the host each; all labels of one are blocks, of three allows, the others have none
    names = ["".join(chr(97 + int(d)) for d in f"{k:02d}") for k in range(40)]
    urls = [f"http://a.net/{name}/{i}" for name in names for i in range(100)]
    rules = (url_filter.Rule("net/aa/1", False), *(url_filter.Rule(f"net/{name}/1", True) for name in names[1:4]))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.filter_urls(pages, rules=rules).groupBy(F.split("path", "/")[1].alias("section"), "template", "verdict").count().collect()
    assert {(r.section, r.verdict): r["count"] for r in got} == {(n, "block" if n == "aa" else "allow"): 100 for n in names}
    assert [r.template for r in got if r.section == "aa"] == ["/aa/<n>"]


# token output

@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=70))
@settings(max_examples=60, deadline=None)
def test_variable_bytes_round_trip(values):
    values = np.array(values, dtype=np.uint32)
    control, data = varbytes.encode(values)
    assert len(control) == -(-len(values) // 4) and (varbytes.decode(control, data, len(values)) == values).all()


@given(st.lists(st.text(alphabet="ab .,\n\t'1^$é　<|>", max_size=30), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_cache_gives_the_tokenizers_ids(texts):
    import pyarrow as pa

    encoder = token_output._encoder(TOKENIZER)
    ids, numbers = encoder.encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(numbers)[:-1])
    assert [p.tolist() for p in parts] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark, make, odd_rows, tmp_path):
    rows = odd_rows + [(1000 + i, prose(i, 50) + "<|endoftext|>\n\nX ") for i in range(40)]
    token_output.write_tokens(make(rows).withColumn("part", F.lit(9)), str(tmp_path / "t"), TOKENIZER, block_tokens=500)
    got = token_output.read_documents(spark, str(tmp_path / "t"), with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    encoder = token_output._encoder(TOKENIZER).tokenizer
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for row, r in zip(rows, got, strict=True):
        ids = encoder.encode(row[1] or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (row[0], start, len(ids), ids)
        assert r.ids_crc32 == __import__("zlib").crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


# pseudonyms

def test_pseudonyms_keep_formats_and_links(spark):
    values = {"card": "4111111111111111", "dashed": "4111-1111-1111-1111", "phone": "+1 (988) 555-2485", "far": "+49 30 1234567", "ip": "42.144.35.254",
              "date": "2024-02-29", "day": "31.12.1999", "ssn": "123-45-6789", "mail": "bosbt.42@mail8.example.com"}
    wrong = ["4111111111111112", "2024-02-30", "300.1.1.1", "000-12-3456", "12345"]
    text = " and ".join([*values.values(), *wrong])
    docs = spark.createDataFrame([(1, text), (2, f"again {text}"), (3, None), (4, ""), (5, "plain words")], "doc_id long, text string")
    docs = docs.withColumn("n_pseudonyms", F.lit("clash"))
    hidden = pseudonyms.pseudonymise(docs, "k")
    rows = {r.doc_id: r for r in hidden.collect()}
    new = rows[1].pseudonymised.split(" and ")
    assert new[len(values):] == wrong and rows[2].pseudonymised == "again " + rows[1].pseudonymised and rows[1].n_pseudonyms == len(values)
    assert rows[3].pseudonymised is None and rows[4].pseudonymised == "" and rows[5].n_pseudonyms == rows[3].n_pseudonyms == 0
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    for old, masked in zip(values.values(), new):
        assert old != masked and (shape(old) == shape(masked) or all(int(x) < 256 for x in masked.split(".")))
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    assert luhn(new[0]) and new[0][0] == "4" and new[0] == new[1].replace("-", "")
    back = pseudonyms.pseudonymise(hidden.select("doc_id", F.col("pseudonymised").alias("text")), "k", undo=True).collect()
    assert {r.doc_id: r.pseudonymised for r in back} == {r.doc_id: r.text for r in rows.values()}
    other = pseudonyms.pseudonymise(docs, "another key").where("doc_id = 1").first()
    assert not set(other.pseudonymised.split(" and ")[: len(values)]) & set(new[: len(values)])


def test_feistel_network_is_a_permutation(spark):
    pairs = spark.range(7 * 11).select(F.col("id") % 7, F.floor(F.col("id") / 11 * 0 + F.col("id") / 7)).toDF("l", "r")
    sizes = (F.lit(7).cast("long"), F.lit(11).cast("long"))
    got = pairs.select(pseudonyms.permuted(F.col("l"), F.col("r"), sizes, "k", "t").alias("p")).select("p.*").distinct()
    assert got.count() == 77 and got.agg(F.max("l"), F.max("r")).first() == (6, 10)


# mixing

def test_ranks_and_slots_are_permutations():
    for bits, low, high in ((1, 0, 1), (5, 3, 19), (10, 100, 777)):
        m = np.arange(low, high)
        slot = mixing.reversed_bits(m, bits)
        rank = mixing.rank_in_schedule(np.full(len(m), low), np.full(len(m), high), slot, bits)
        assert (rank == np.argsort(np.argsort(slot))).all()


def test_mix_meets_targets_evenly(make, odd_rows):
    docs = make([(i, prose(i, 40), f"s{i % 3}") for i in range(300)] + [(900 + i, prose(i, 3), "s9") for i in range(3)])
    documents, pieces = mixing.mixed_blocks(docs, block_words=32)
    sources = {r.target: r for r in documents.groupBy("source_size", "target").agg(F.count("*").alias("n")).collect()}
    total = sum(r.source_size for r in sources.values()) if len(sources) == 4 else 12_009
    rows = pieces.join(documents, "_row").select("slot", "target", (F.col("last") - F.col("first")).alias("n")).collect()
    taken = Counter()
    for r in rows:
        taken[r.target] += r.n
    assert all(abs(taken[t] - t) <= 0.5 for t in taken) and sum(taken.values()) == pytest.approx(12_009, abs=3)
    assert total == 12_009
    # the heaviest source is spread over the whole schedule
    top = max(taken)
    slots = sorted({r.slot for r in rows if r.target == top})
    assert max(b - a for a, b in zip(slots, slots[1:])) <= 4
    again = mixing.mix_sizes(docs).collect()
    assert sorted(again, key=repr) == sorted(mixing.mix_sizes(docs).collect(), key=repr)
    assert all(r.taken <= 3 * r.size for r in again)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_sizes(make(odd_rows)).count() == len(odd_rows)


# sharding

def test_shards_fit_their_limit_and_keep_all_rows(spark, make, odd_rows, tmp_path):
    docs = make([(i, "x" * (i % 97)) for i in range(2000)] + [r for r in odd_rows if r[0] not in (4, 9)] + [(5000, "y" * 4000)] * 3)
    got = sharding.assigned(docs.withColumn("depth", F.lit("clash")), limit=2000).collect()
    assert len(got) == docs.count()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for name, rows in shards.items():
        assert rows[0].shard_bytes == sum(r.n_bytes for r in rows) and rows[0].shard_documents == len(rows) and rows[0].depth == len(name)
        assert rows[0].shard_bytes <= 2000 or {r.doc_id for r in rows} == {5000}
        assert not any(other != name and other.startswith(name) for other in shards)
        # nothing splits that would have fitted
        parent = [r for other, own in shards.items() if other.startswith(name[:-1]) for r in own]
        assert not name or sum(r.n_bytes for r in parent) > 2000
    sharding.write_shards(docs, str(tmp_path / "shards"), limit=2000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(got)


# near-duplicates

def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))
    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(i)] = min(smallest.get(root(i), d), d)
    return Counter((d, f"{p:016x}", smallest.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def test_golay_code_is_perfect():
    words = golay.codewords()
    assert len(set(words.tolist())) == 4096 and min(int(w).bit_count() for w in words[1:]) == 7
    some = np.random.default_rng(1).integers(0, 1 << 23, 500).astype(np.uint32)
    assert (np.bitwise_count(words[golay.decoder()[some]] ^ some) <= 3).all()


def test_near_fingerprints_share_a_key():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, r.integers(1, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    x, own = near_duplicates.keys_of(a)
    y, _ = near_duplicates.keys_of(b)
    assert all(set(p[:own]) & set(q) for p, q in zip(x.tolist(), y.tolist()))


@pytest.mark.parametrize("limit", [near_duplicates.GROUP_LIMIT, 40])
def test_near_duplicates_equal_brute_force(make, odd_rows, limit):
    r = random.Random(5)
    rows = [(d, t) for d, t, *_ in odd_rows if d not in (4, 9)]
    for group in range(6):
        words = prose(group, 300).split()
        for copy in range(60):
            changed = list(words)
            for _ in range(r.randrange(0, 3)):
                changed[r.randrange(len(changed))] = "changed%d" % r.randrange(1000)
            rows.append((1000 * (group + 1) + copy, " ".join(changed)))
    rows += [(20_000 + i, prose(100 + i, 40)) for i in range(200)]
    got = near_duplicates.near_duplicates(make(rows).withColumn("fingerprint", F.lit("clash")), limit=limit).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_one_document_of_each_group_stays(make, odd_rows):
    docs = make(odd_rows + [(50 + i, prose(1, 100)) for i in range(9)])
    kept = near_duplicates.one_of_each_group(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and kept.columns == docs.columns and len(ids) == len(set(ids)) and 50 in ids and not set(range(51, 59)) & set(ids) and 6 not in ids


def test_components_of_chains_and_stars(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000 + r.randrange(50), 5000 + r.randrange(50)) for _ in range(40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    graph = defaultdict(set)
    for a, b in edges:
        graph[a].add(b)
        graph[b].add(a)
    for node in [n for n in graph if graph[n] - {n}]:
        seen, todo = {node}, [node]
        while todo:
            for n in graph[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got[node] == min(seen)
