"""Inputs whose columns have the operators' inner names; limits, blocks and hot ids; pseudonyms against plain Python."""

import hashlib
import re
from collections import Counter
from datetime import date, timedelta

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakesight.llm import decontamination, mixing, near_duplicates, pseudonyms, quality_rules, sharding, suffix_dedup, token_output
from lakesight.session import materialise
from tests.llm.test_operators import prose

INNER = ["_doc", "_keys", "_kept", "_digest", "_rank", "_hash", "_found", "_new", "_host", "_text_hash", "_mix_row", "_row", "_times", "_again", "_removed",
         "_i", "_h", "_t", "_gone", "_words", "_n", "cell", "depth", "n_words", "spans", "shard", "n_pseudonyms", "__in0__", "words", "core"]

OPERATORS = {
    "one_of_each_group": (near_duplicates.one_of_each_group, []), "without_repeats": (suffix_dedup.without_repeats, []),
    "assigned": (sharding.assigned, ["shard", "depth"]), "pseudonymise": (lambda d: pseudonyms.pseudonymise(d, "k"), ["n_pseudonyms"]),
    "kept": (lambda d: quality_rules.kept(d), []), "judge": (lambda d: quality_rules.judge(d), ["n_words"]),
    "without_shared_lines": (quality_rules.without_shared_lines, []), "mixed_documents": (mixing.mixed_documents, []),
    "find_benchmark_passages": (lambda d: decontamination.find_benchmark_passages(d, d.sparkSession.createDataFrame([(1, prose(1, 20))], "item_id long, text string")), ["n_words", "spans"]),
    "find_in_blocks": (lambda d: decontamination.find_benchmark_passages(
        d, d.sparkSession.createDataFrame([(i, prose(i, 20)) for i in range(9)], "item_id long, text string"), block_bytes=150), ["n_words", "spans"]),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_inner_names_of_the_operators_may_be_taken(make, name):
    operator, replaced = OPERATORS[name]
    docs = make([(i, prose(i, 60)) for i in range(12)])
    taken = materialise(docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in INNER}))
    own = operator(docs)
    got = operator(taken)
    kept = [c for c in INNER if c not in replaced]
    assert [c for c in got.columns if c in kept] == kept and len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in kept)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in own.collect())


# quality rules

def test_boilerplate_in_a_small_and_in_a_hot_host(make):
    menu = "\n".join(prose(50 + j, 12) for j in range(9))
    rows = [(i, f"{menu}\n{prose(1000 + i, 25)}", "small") for i in range(40)]
    rows += [(1000 + i, f"{menu}\n{prose(3000 + i, 25)}" if i < 40 else prose(5000 + i, 70), "hot") for i in range(1500)]
    docs = make(rows)
    by_share = {r.doc_id for r in quality_rules.kept(docs).select("doc_id").collect()}
    assert by_share == {1000 + i for i in range(1500)}  # 40 of 1,500 are below the share
    by_number = {r.doc_id for r in quality_rules.kept(docs, max_documents=30).select("doc_id").collect()}
    assert by_number == {1040 + i for i in range(1460)}


def test_copies_count_once_or_each(make):
    docs = make([(i, prose(1, 80) + "\n" + prose(2, 80)) for i in range(60)] + [(100 + i, prose(100 + i, 80)) for i in range(60)])
    assert quality_rules.kept(docs).count() == 120
    assert quality_rules.kept(docs, copies="each").count() == 60


# suffixes

def test_a_hot_suffix_on_many_tasks(spark, make, monkeypatch):
    shared = prose(9, 55)
    rows = [(i, f"{prose(100 + i, 30)} {shared} {prose(900 + i, 30)}") for i in range(300)] + [(1000 + i, prose(2000 + i, 90)) for i in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r.doc_id: r for r in suffix_dedup.repeated_spans(make(rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert set(got) == set(range(300)) and all(55 <= r.n_repeated < 60 for r in got.values())  # short words may agree further by chance
    assert got[0].n_removed == 0 and all(55 <= got[i].n_removed < 60 for i in range(1, 300))


# token output

def test_rows_of_one_id_are_spread(spark, make, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(7, prose(i % 5, 20)) for i in range(400)] + [(None, prose(i, 20)) for i in range(200)] + [(1, "first"), (9, "last")]
    blocks = token_output.encoded_blocks(make(rows), public_tokenizers.path("byte_bpe_50k.json"))
    blocks.write.parquet(str(tmp_path / "t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(str(tmp_path / "t")).select("part", F.explode("doc_ids").alias("id"))
    assert parts.where("id = 7").select("part").distinct().count() > 1 and parts.where("id IS NULL").select("part").distinct().count() > 1
    found = sorted(token_output.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 200 + [1] + [7] * 400 + [9]
    assert found[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:]))


# pseudonyms: the same values by hashlib

def feistel(left, right, sizes, key, kind):
    for i in range(pseudonyms.ROUNDS):
        half = right if i % 2 == 0 else left
        number = int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + number % sizes[0]) % sizes[0]
        else:
            right = (right + number % sizes[1]) % sizes[1]
    return left, right


def digits_of(digits, key, kind):
    u = len(digits) // 2
    v = len(digits) - u
    left, right = feistel(int(digits[:u] or 0), int(digits[u:]), (10**u, 10**v), key, kind)
    return (f"{left:0{u}d}" if u else "") + f"{right:0{v}d}"


def filled(shape, digits):
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def luhn(digits):
    return sum((2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(map(int, reversed(digits))))


def email(value, key):
    def word(part):
        low, u = part.lower(), len(part) // 2
        number = lambda s: sum((ord(c) - 97) * 26**i for i, c in enumerate(reversed(s)))
        text = lambda n, w: "".join(chr(97 + n // 26**i % 26) for i in reversed(range(w)))
        left, right = feistel(number(low[:u]), number(low[u:]), (26**u, 26 ** (len(part) - u)), key, "letters")
        new = text(left, u) + text(right, len(part) - u)
        return "".join(n.upper() if c.isupper() else n for c, n in zip(part, new))

    local, at, domain = value.partition("@")
    runs = re.findall(r"[A-Za-z]{1,20}|[0-9]{1,18}|[^A-Za-z0-9]+", local)
    return "".join(word(r) if r.isalpha() else digits_of(r, key, "digits") if r.isdigit() else r for r in runs) + at + domain


def phone(value, key):
    digits = re.sub("[^0-9]", "", value)
    area, rest = int(digits[1:4]), int(digits[4:11] or 0)
    if re.match(r"\+1[^0-9]", value) and len(digits) == 11 and area >= 200 and rest >= 2_000_000:
        left, right = feistel(area - 200, rest - 2_000_000, (800, 8_000_000), key, "phone")
        return filled(value, f"1{left + 200}{right + 2_000_000}")
    if re.match(r"\+1[^0-9]", value) and len(digits) == 11:
        new = digits_of(digits[2:4] + digits[5:], key, "number")
        return filled(value, digits[:2] + new[:2] + digits[4] + new[2:])
    code = min(len(re.match(r"\+([0-9]+)", value).group(1)), 3, len(digits) - 1)
    return filled(value, digits[:code] + digits_of(digits[code:], key, "number"))


def day(value, form, key):
    numbers = [int(x) for x in re.split(r"[-.]", value)]
    try:
        number = (date(*(numbers if form == "%Y-%m-%d" else numbers[::-1])) - date(1800, 1, 1)).days
    except ValueError:
        return value
    if not 0 <= number < 233 * 627:
        return value
    left, right = feistel(number // 627, number % 627, (233, 627), key, "date")
    new = date(1800, 1, 1) + timedelta(days=left * 627 + right)
    return f"{new.year:04d}-{new.month:02d}-{new.day:02d}" if form == "%Y-%m-%d" else f"{new.day:02d}.{new.month:02d}.{new.year:04d}"


def brute(value, key):
    whole = lambda p: re.fullmatch(p, value)
    if whole(pseudonyms.EMAIL):
        return email(value, key)
    if whole(pseudonyms.PHONE):
        return phone(value, key)
    if whole(pseudonyms.DATE):
        return day(value, "%Y-%m-%d", key)
    if whole(pseudonyms.DAY_FIRST):
        return day(value, "%d.%m.%Y", key)
    if whole(pseudonyms.IP):
        a, b, c, d = map(int, value.split("."))
        if max(a, b, c, d) > 255:
            return value
        left, right = feistel(a * 256 + b, c * 256 + d, (65536, 65536), key, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if whole(pseudonyms.SSN):
        area, group, serial = map(int, value.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return value
        left, right = feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")
        return f"{left + (2 if left >= 665 else 1):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    digits = re.sub("[^0-9]", "", value)
    if luhn(digits) % 10:
        return value
    body = digits[0] + digits_of(digits[1:-1], key, "card")
    return filled(value, body + str(-luhn(body + "0") % 10))


def test_pseudonyms_equal_plain_python(spark, make):
    values = ["John.Smith99@Mail.example.org", "JOHN@x.de", "a.b+c_7@d.co", "Averyveryverylongnamewithmoreletters@x.org", "4111 1111 1111 1111", "4111-1111-1111-1111",
              "378282246310005", "1234567812345678", "+1 202 555 0143", "+1-415-555-2671", "+44 20 7946 0958", "+1 055 155 0143", "+1-234-111-0000", "+49 (30) 1234 5678", "123-45-6789", "666-12-3456",
              "000-12-3456", "899-99-9999", "192.168.0.1", "300.1.1.1", "2024-02-29", "2023-02-29", "1799-12-31", "2199-12-31", "31.12.1999", "31.02.1999", "5500005555555559"]
    rows = [(i, f"see {v} and, again, ({v}).") for i, v in enumerate(values)]
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text RLIKE '[0-9]{3}|@'").limit(150).collect()]
    found = pseudonyms.pseudonymise(make(rows + real), "key").collect()
    for r in found:
        changed = [0]

        def new(m):
            out = brute(m.group(), "key")
            changed[0] += out != m.group()
            return out

        assert r.pseudonymised == re.sub(pseudonyms.ANY, new, r.text), r.text
        assert r.n_pseudonyms == changed[0]
    back = pseudonyms.pseudonymise(make([(r.doc_id, r.pseudonymised) for r in found]), "key", undo=True).collect()
    assert {r.doc_id: r.pseudonymised for r in back} == {r.doc_id: r.text for r in found}
