"""Masking of secrets in text, by field name and inside URLs."""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesight.functions.columns import named

# Send these functions to the Python workers by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Mask text, the pattern for user:password in a URL, and sensitive name fragments.
FULL_MASK = "********"
INNER_MASK = "****"
URL_PASSWORD = "://([^:]+):([^@]+)@"
URL_PASSWORD_MASKED = "://$1:****@"
SENSITIVE_NAMES = ("password", "secret", "token", "auth", "key", "credential", "conn_url")


def mask_urls(text: Column) -> Column:
    """Replace the password of every user:password@host in the text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), URL_PASSWORD, URL_PASSWORD_MASKED)


def mask_secret(text: Column, shown: int = 2) -> Column:
    """Keep the first ``shown`` characters and the last one; mask short values whole."""
    kept = F.concat(F.substring(text, 1, shown), F.lit(INNER_MASK), F.right(text, F.lit(1)))
    return F.when(F.length(text) > shown, kept).otherwise(FULL_MASK)


def _is_sensitive(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE_NAMES))


def _masked_json(value, name: str = ""):
    """A parsed JSON value with the texts below sensitive names masked; entries of a list have the list's name."""
    if isinstance(value, dict):
        return {k: _masked_json(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [_masked_json(v, name) for v in value]
    lowered = name.lower()
    if not isinstance(value, str) or not any(part in lowered for part in SENSITIVE_NAMES):
        return value
    return re.sub(URL_PASSWORD, URL_PASSWORD_MASKED.replace("$", "\\"), value) if "url" in lowered else FULL_MASK


def _masked_variant(value: Column, name: Column) -> Column:
    """A variant has no schema to follow, so its JSON form is masked in Python, in Arrow batches.

    One without a secret stays as it was; in others, fractions become doubles.
    """
    def mask(texts: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, names):
            value = None if text is None else json.loads(text)
            masked = _masked_json(value, own)
            out.append(text if masked == value else json.dumps(masked, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return F.parse_json(F.pandas_udf(mask, "string")(F.to_json(value), name))


def _masked(value: Column, dtype: T.DataType, name: Column, in_list: bool = False) -> Column:
    """``value`` with the texts below sensitive names masked, whatever the nesting.

    A text has the name of the nearest field or map key above it: entries of a
    list and keys that are not texts pass on the name from above.
    """
    if isinstance(dtype, T.StructType):
        fields = [_masked(value.getField(f.name), f.dataType, F.lit(f.name), in_list).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType):
        by_key = isinstance(dtype.keyType, T.StringType)
        return F.transform_values(value, lambda k, v: _masked(v, dtype.valueType, k if by_key else name, True))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: _masked(v, dtype.elementType, name, True))
    if isinstance(dtype, T.VariantType):
        if in_list:
            raise ValueError("a variant inside a list or map cannot be masked; make the whole column a variant")
        return _masked_variant(value, name)
    if isinstance(dtype, T.StringType):
        shown = F.when(F.lower(name).contains("url"), mask_urls(value)).otherwise(FULL_MASK)
        return F.when(value.isNotNull() & _is_sensitive(name), shown).otherwise(value)
    return value


def mask_sensitive_fields(df: DataFrame) -> DataFrame:
    """Mask texts whose name looks like a secret: columns, fields of structs, map values, list entries, and all of these in one another."""
    return df.select(*[_masked(named(f.name), f.dataType, F.lit(f.name)).alias(f.name) for f in df.schema.fields])
