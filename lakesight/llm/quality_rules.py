"""Quality rules on words and on lines that many documents of a host share (DataFrame functions only).

A document is judged by its own words (too few, or too repetitive) and by the
lines it shares with its host's other documents: lines are normalised and
hashed, the distinct documents (distinct texts) holding each line are counted
per host, lines above the limits are removed, and a document with too few words
left is rejected as depleted.

A line is above the limits if at least ``min_documents`` of its host's documents
hold it and these are more than ``max_share`` of them or, with
``max_documents``, more than that number, which a hot host's boilerplate reaches
long before it has a share. ``copies`` says what counts as a document: "once"
takes all copies of a text for one, "each" takes every row.

Defined cases: a null text has no words; a null host is a host of its own;
copies of one text count once, so a group of copies does not condemn its own
lines; repeated rows each get their row; input columns named like a result
column are replaced. Windows and lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesight.llm.common import SPACE, WORD, own_names, without
from lakesight.session import materialise

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_LINE_DOCUMENTS = 20
MAX_LINE_SHARE = 0.05
MIN_LEFT_SHARE = 0.3
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
VERDICT = ["n_removed_words", "kept"]
_ID, _HOST, _TEXT = "_doc", "_host", "_text_hash"


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows that start at ``positions`` (ascending)."""
    step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
    return F.aggregate(positions, start, step)["total"]


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``BASE``; one map over the rows."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = without(docs, [*BASE, *VERDICT]).withColumn("_words", F.regexp_extract_all(t, F.lit(f"({WORD})"), 1))
    words = F.col("_words")
    df = df.withColumn("_n", F.size(words)).withColumn(
        "_windows",
        F.when(F.col("_n") >= 3, F.transform(
            F.slice(words, 3, F.greatest(F.col("_n") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w))).otherwise(F.array().cast("array<long>")),
    )
    windows = F.col("_windows")
    # only texts with a repeated window pay for the sort that finds the places
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    places = F.col("_sorted")
    twice = F.filter(places, lambda w, j: (w["h"] == F.get(places, j - 1)["h"]) | (w["h"] == F.get(places, j + 1)["h"]))
    df = df.withColumn("_repeated", F.coalesce(F.sort_array(F.transform(twice, lambda w: w["i"])), F.array().cast("array<int>")))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    df = df.withColumn("_lines", lines)
    df = df.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _covered(F.col("_repeated")).cast("long"),
    }).drop("_words", "_n", "_windows", "_sorted", "_repeated", "_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    """Lower case, runs of white space as one blank, digits as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), f"[{SPACE}]+", " "), "[0-9]", "0"))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def shared_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_documents: int = MIN_LINE_DOCUMENTS,
                 max_share: float = MAX_LINE_SHARE, max_documents: int | None = None, copies: str = "once") -> DataFrame:
    """(_row, _doc, _host, _text_hash, _line, n): every line above its host's limit, with its words.

    The counts grow with the lines, never with the texts: a line travels as its hash.
    """
    line = F.explode(F.split("_t", "\n", -1)).alias("line")
    lines = materialise(
        docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id}`").alias(_ID), F.col(f"`{host}`").alias(_HOST),
                    F.col(f"`{text}`").alias("_t"), _text_hash(text).alias(_TEXT))
        .select("_row", _ID, _HOST, _TEXT, line)
        .select("_row", _ID, _HOST, _TEXT, normalised(F.col("line")).alias("line"))
        .where(F.col("line") != "")
        .select("_row", _ID, _HOST, _TEXT, F.xxhash64("line").alias("_line"), F.regexp_count("line", F.lit(WORD)).alias("n"))
    )
    # distinct texts (or rows) first, so that copies and hot lines are merged before they are counted
    counted = {"once": _TEXT, "each": "_row"}[copies]
    documents = lines.select(_HOST, counted).distinct().groupBy(_HOST).agg(F.count("*").alias("of"))
    frequent = (
        lines.select(_HOST, "_line", counted).distinct().groupBy(_HOST, "_line").agg(F.count("*").alias("in"))
        .where(F.col("in") >= min_documents)
    )
    above = frequent.join(documents.withColumnRenamed(_HOST, "_h"), F.col(_HOST).eqNullSafe(F.col("_h"))).where(
        (F.col("in") > max_share * F.col("of")) | (F.lit(max_documents is not None) & (F.col("in") > (max_documents or 0)))).select(F.col(_HOST).alias("_h"), F.col("_line").alias("_l"))
    on = F.col(_HOST).eqNullSafe(F.col("_h")) & (F.col("_line") == F.col("_l"))
    return lines.join(above, on, "left_semi")


def _same(id: str) -> Column:
    return F.col(f"`{id}`").eqNullSafe(F.col("_i")) & F.col(_HOST).eqNullSafe(F.col("_h")) & (F.col(_TEXT) == F.col("_t"))


def _key() -> list[Column]:
    return [F.col(_ID).alias("_i"), F.col(_HOST).alias("_h"), F.col(_TEXT).alias("_t")]


def verdicts(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """A row per row of ``docs``: its id, the counts of ``BASE``, n_removed_words and ``kept``, but no text.

    ``limits`` are those of ``shared_lines``. The counts are written before they
    are joined and filtered, so that they are worked out once. An empty table
    gives no rows.
    """
    base = base_columns(docs.select(F.col(f"`{id}`").alias(_ID), F.col(f"`{text}`").alias("_t"), F.col(f"`{host}`").alias(_HOST)), "_t")
    base = materialise(base.withColumn(_TEXT, _text_hash("_t")).drop("_t"))
    gone = (
        shared_lines(docs, id, text, host, **limits).groupBy("_row", _ID, _HOST, _TEXT).agg(F.sum("n").alias("_gone"))
        .groupBy(_ID, _HOST, _TEXT).agg(F.max("_gone").alias("_gone")).select(*_key(), "_gone")
    )
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        base.join(gone, _same(_ID), "left")
        .withColumn("n_removed_words", F.coalesce("_gone", F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & (left >= MIN_LEFT_SHARE * F.col("n_words")))
        .drop("_i", "_h", "_t", "_gone")
    )


@own_names([*BASE, *VERDICT], "id", "text", "host")
def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """``docs`` with the columns of ``verdicts``."""
    found = verdicts(docs, id, text, host, **limits).dropDuplicates([_ID, _HOST, _TEXT]).select(*_key(), *BASE, *VERDICT)
    joined = keyed(docs, text, host).join(found, _same(id))
    return joined.drop("_i", "_h", "_t", _TEXT, _HOST)


@own_names([], "id", "text", "host")
def kept(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged."""
    good = verdicts(docs, id, text, host, **limits).where("kept").select(*_key()).distinct()
    return keyed(docs, text, host).join(good, _same(id), "left_semi").drop(_TEXT, _HOST)


def keyed(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with the columns that find a document's removed lines."""
    return docs.withColumn(_TEXT, _text_hash(text)).withColumn(_HOST, F.col(f"`{host}`"))


@own_names(["clean_text"], "id", "text", "host")
def without_shared_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """``docs`` with ``clean_text``: the text without the lines above its host's limit."""
    gone = shared_lines(docs, id, text, host, **limits).groupBy(_ID, _HOST, _TEXT).agg(F.collect_set("_line").alias("_gone")).select(*_key(), "_gone")
    stays = lambda line: ~F.array_contains(F.col("_gone"), F.xxhash64(normalised(line)))
    clean = F.array_join(F.filter(F.split(f"`{text}`", "\n", -1), stays), "\n")
    return (
        keyed(docs, text, host).join(gone, _same(id), "left")
        .withColumn("clean_text", F.when(F.col("_gone").isNull(), F.col(f"`{text}`")).otherwise(clean))
        .drop("_i", "_h", "_t", "_gone", _TEXT, _HOST)
    )
