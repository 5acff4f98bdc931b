"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import inspect
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"\x20\x09-\x0D"  # the six ASCII white space characters
WORD = rf"[^{SPACE}]+"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_package(df: DataFrame) -> DataFrame:
    """``df``, after telling its session's Python workers where this package lies.

    That is enough where workers see the same folders; on a cluster without an
    installed copy, ship the package with ``addPyFile``.
    """
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, known)]))
    return df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that a result replaces, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def own_names(results: list[str], *columns: str) -> Callable:
    """Decorate an operator on a table so that no input column meets a name it uses inside.

    All columns of the first argument get plain names while the operator works,
    and their own again in its result. ``columns`` are the arguments that name
    columns; input columns named like one of ``results`` are replaced by it.
    """
    taken = {r.lower() for r in results}

    def decorated(operator: Callable) -> Callable:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            bound = signature.bind(docs, *args, **kwargs)
            bound.apply_defaults()
            inner = {name: f"__in{i}__" for i, name in enumerate(docs.columns)}
            by_lower = {name.lower(): alias for name, alias in inner.items()}
            bound.arguments[next(iter(signature.parameters))] = docs.toDF(*inner.values())
            for c in columns:
                bound.arguments[c] = inner.get(bound.arguments[c]) or by_lower[bound.arguments[c].lower()]
            found = operator(*bound.args, **bound.kwargs)
            given = {alias: name for name, alias in inner.items()}
            return found.select(*[
                F.col(f"`{c}`").alias(given.get(c, c)) for c in found.columns if c not in given or given[c].lower() not in taken])

        return run

    return decorated


def extended(df: DataFrame, fields: str) -> T.StructType:
    """Schema of ``df`` with further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most about ``limit`` bytes of text (or a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        first = total = 0
        for i, size in enumerate(sizes):
            if i > first and total + size > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        yield batch.slice(first)
