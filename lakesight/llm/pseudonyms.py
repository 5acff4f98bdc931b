"""Format-preserving pseudonyms for personal numbers and dates (DataFrame functions only, a map over the rows).

Each value found and validated is permuted by a keyed Feistel network within
its own format: a card number becomes another valid card number of the same
length and first digit, a date another date. The permutation depends on the key
and the kind alone, so equal values stay equal in all documents, different
values stay different, and whoever holds the key can undo it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesight.llm.common import own_names

ROUNDS = 10
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9A-Za-z])"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])"
DAY_FIRST = r"(?<![0-9A-Za-z.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ANY = "|".join([EMAIL, PHONE, DATE, DAY_FIRST, IP, SSN, CARD])
_EPOCH, _DAYS = "1800-01-01", (233, 627)  # 400 years are 146,097 = 233 * 627 days
RESULT = ["pseudonymised", "n_pseudonyms"]


def _random(key: str, kind: str, turn: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted(left: Column, right: Column, sizes: tuple[Column, Column], key: str, kind: str, undo: bool = False) -> Column:
    """struct(l, r): a permutation of the pairs with l below the first and r below the second size (both up to 10^17)."""
    sign = -1 if undo else 1

    def turn(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]  # noqa: E741
        even = i % 2 == 0
        l_new = F.when(even, F.pmod(l + sign * F.pmod(_random(key, kind, i, r), sizes[0]), sizes[0])).otherwise(l)
        r_new = F.when(even, r).otherwise(F.pmod(r + sign * F.pmod(_random(key, kind, i, l), sizes[1]), sizes[1]))
        return F.struct(l_new.cast("long").alias("l"), r_new.cast("long").alias("r"))

    turns = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS))])
    return F.aggregate(turns, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sizes(*values: int) -> tuple[Column, Column]:
    return tuple(F.lit(v).cast("long") for v in values)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def _padded(number: Column, width: Column) -> Column:
    return F.concat(F.repeat(F.lit("0"), width - F.length(number.cast("string"))), number.cast("string"))


def permuted_digits(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Another string of as many digits (1 to 20; a single digit is moved by a keyed offset)."""
    size = F.length(digits)
    u = F.floor(size / 2).cast("int")
    v = size - u
    left = F.when(u == 0, 0).otherwise(F.substring(digits, F.lit(1), u).cast("long"))
    pair = permuted(left, F.substring(digits, u + 1, v).cast("long"), (_power(u), _power(v)), key, kind, undo)
    return _let(pair, lambda pair: F.concat(F.when(u == 0, "").otherwise(_padded(pair["l"], u)), _padded(pair["r"], v)))


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in turn."""
    nth = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i + 1)))
    return _let(digits, lambda new: F.array_join(F.transform(
        F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, nth(i), F.lit(1))).otherwise(c)), ""))


def luhn(digits: Column) -> Column:
    """Sum of the check rule for card numbers; valid if divisible by 10."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(value: Column, key: str, undo: bool) -> Column:
    def changed(digits: Column) -> Column:
        inner = permuted_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card", undo)
        check = lambda body: F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        new = _let(F.concat(F.substring(digits, F.lit(1), F.lit(1)), inner), lambda body: F.concat(body, check(body)))
        return F.when(luhn(digits) % 10 == 0, _filled(value, new)).otherwise(value)

    return _let(_digits(value), changed)


def _phone(value: Column, key: str, undo: bool) -> Column:
    digits = _digits(value)
    area, rest = F.substring(digits, 2, 3).cast("long"), F.substring(digits, 5, 7).cast("long")
    american = value.rlike(r"^\+1[^0-9]") & (F.length(digits) == 11) & (area >= 200) & (rest >= 2_000_000)
    pair = permuted(area - 200, rest - 2_000_000, _sizes(800, 8_000_000), key, "phone", undo)
    # an impossible number stays one: the digits that decide keep their places, so that it is undone by the same rule
    inner = F.concat(F.substring(digits, 3, 2), F.substring(digits, 6, 6))
    impossible = _let(permuted_digits(inner, key, "number", undo), lambda new: F.concat(
        F.substring(digits, 1, 2), F.substring(new, 1, 2), F.substring(digits, 5, 1), F.substring(new, 3, 6)))
    domestic = value.rlike(r"^\+1[^0-9]") & (F.length(digits) == 11)
    code = F.least(F.length(F.regexp_extract(value, r"^\+([0-9]+)", 1)), F.lit(3), F.length(digits) - 1)
    other = F.concat(F.substring(digits, F.lit(1), code), permuted_digits(F.substring(digits, code + 1, F.length(digits)), key, "number", undo))
    known = _let(pair, lambda pair: F.concat(F.lit("1"), (pair["l"] + 200).cast("string"), (pair["r"] + 2_000_000).cast("string")))
    return _filled(value, F.when(american, known).when(domestic, impossible).otherwise(other))


def _ssn(value: Column, key: str, undo: bool) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.split(value, "-")[i].cast("long") for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    pair = permuted(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, _sizes(898, 99 * 9999), key, "ssn", undo)
    new = _let(pair, lambda pair: F.format_string(
        "%03d-%02d-%04d", pair["l"] + F.when(pair["l"] >= 665, 2).otherwise(1), F.floor(pair["r"] / 9999) + 1, pair["r"] % 9999 + 1))
    return F.when(valid, new).otherwise(value)


def _ip(value: Column, key: str, undo: bool) -> Column:
    part = [F.split(value, r"\.")[i].cast("long") for i in range(4)]
    valid = F.greatest(*part) < 256
    pair = permuted(part[0] * 256 + part[1], part[2] * 256 + part[3], _sizes(65536, 65536), key, "ip", undo)
    octets = lambda pair: [F.floor(pair[h] / 256) if high else pair[h] % 256 for h in ("l", "r") for high in (True, False)]
    new = _let(pair, lambda pair: F.concat_ws(".", *[x.cast("string") for x in octets(pair)]))
    return F.when(valid, new).otherwise(value)


def _date(value: Column, form: str, key: str, undo: bool) -> Column:
    day = F.datediff(F.try_to_date(value, form), F.lit(_EPOCH).cast("date")).cast("long")
    pair = permuted(F.floor(day / _DAYS[1]), day % _DAYS[1], _sizes(*_DAYS), key, "date", undo)
    new = _let(pair, lambda pair: F.date_format(F.date_add(F.lit(_EPOCH).cast("date"), (pair["l"] * _DAYS[1] + pair["r"]).cast("int")), form))
    return F.when(day.between(0, _DAYS[0] * _DAYS[1] - 1), new).otherwise(value)


def _email(value: Column, key: str, undo: bool) -> Column:
    """Digits and letters before the @ become others, run by run, with their case kept; the domain stays."""
    letters, places = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"

    def run(given: Column) -> Column:
        part = F.lower(given)
        size = F.length(part)
        u = F.floor(size / 2).cast("int")
        power = lambda n: F.pow(F.lit(26.0), n).cast("long")
        number = lambda s: F.coalesce(F.conv(F.translate(s, letters, places), 26, 10).cast("long"), F.lit(0))
        pair = permuted(number(F.substring(part, F.lit(1), u)), number(F.substring(part, u + 1, size)), (power(u), power(size - u)), key, "letters", undo)
        word = lambda n, w: F.when(w > 0, F.translate(F.lpad(F.lower(F.conv(n.cast("string"), 10, 26)), w, "0"), places, letters)).otherwise("")
        named = _let(pair, lambda pair: F.concat(word(pair["l"], u), word(pair["r"], size - u)))
        cased = _let(named, lambda new: F.array_join(F.transform(F.split(given, ""), lambda c, i: F.when(
            c.rlike("[A-Z]"), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), ""))
        return F.when(given.rlike("^[a-z]+$"), named).when(given.rlike("^[A-Za-z]+$"), cased).when(part.rlike("^[0-9]+$"), permuted_digits(part, key, "digits", undo)).otherwise(part)

    at = F.locate("@", value)
    runs = F.regexp_extract_all(F.substring(value, F.lit(1), at - 1), F.lit("([A-Za-z]{1,20}|[0-9]{1,18}|[^A-Za-z0-9]+)"), 1)
    return F.concat(F.array_join(F.transform(runs, run), ""), F.substring(value, at, F.length(value)))


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The value's pseudonym; values that fail their check stay as they are."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    return (
        F.when(whole(EMAIL), _email(value, key, undo)).when(whole(PHONE), _phone(value, key, undo))
        .when(whole(DATE), _date(value, "yyyy-MM-dd", key, undo)).when(whole(DAY_FIRST), _date(value, "dd.MM.yyyy", key, undo))
        .when(whole(IP), _ip(value, key, undo)).when(whole(SSN), _ssn(value, key, undo)).otherwise(_card(value, key, undo))
    )


@own_names(RESULT, "text")
def pseudonymise(docs: DataFrame, key: str, text: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with ``pseudonymised`` (the text with all values replaced) and n_pseudonyms (long, values changed).

    ``undo`` gives back the values. Defined cases: a null text stays null with 0
    values; texts without a value stay as they are; repeated rows and equal
    values get equal results; input columns named like a result are replaced.
    The key is part of the query plan, so
    keep plans and event logs as safe as the key.
    """
    t = F.col(f"`{text}`")
    df = docs.withColumn("_found", F.regexp_extract_all(t, F.lit(f"({ANY})"), 1))
    df = df.withColumn("_new", F.when(F.size("_found") > 0, F.transform("_found", lambda v: pseudonym(v, key, undo))))
    parts = F.zip_with(F.split(t, ANY, -1), F.col("_new"), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    changed = F.size(F.filter(F.arrays_zip("_found", "_new"), lambda x: x["_found"] != x["_new"]))
    return df.withColumn("pseudonymised", F.when(F.size("_found") > 0, F.array_join(parts, "")).otherwise(t)).withColumn(
        "n_pseudonyms", F.when(F.size("_found") > 0, changed).otherwise(0).cast("long")).drop("_found", "_new")
