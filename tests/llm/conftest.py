import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, source]) rows over several partitions."""
    def build(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions, "doc_id", "text")
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \n\t\n "), (4, words), (5, "one two three"), (6, "one two three"), (6, "one two three"),
        (None, "a row without an id " * 5), (None, None), (7, "Ünï cödé\n\nline　x\r\nend"), (8, "word"), (9, words, None),
    ]
