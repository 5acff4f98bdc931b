"""Bounded samples that are the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesight.functions.columns import named


MARGIN = 4


def bounded_sample(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest digest of their key: spread over the table, not its first rows.

    In a much larger table only rows with a small digest are compared; if that
    leaves too few (many equal keys), all rows are.
    """
    digest = F.md5(F.concat_ws("|", *[named(k).cast("string") for k in keys]).cast("binary"))
    order = [digest, *[named(k) for k in keys]]
    total = df.count()
    if total > 10 * MARGIN * rows:
        near = df.filter(digest <= f"{int(2**128 * MARGIN * rows / total):032x}")
        if near.count() >= rows:
            return near.orderBy(*order).limit(rows)
    return df.orderBy(*order).limit(rows)
