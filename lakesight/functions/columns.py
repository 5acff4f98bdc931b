"""Null, NaN and infinity handling, type classes and date coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name fragments and categories that decide how a column is treated.
DATE_NAME_HINTS = ("date", "time", "created_at", "updated_at", "timestamp")
NUMERIC, DATETIME, STRING = "NUMERIC", "DATETIME", "STRING"
#: forms of dates read besides ISO texts, in this order
DATE_FORMATS = ("yyyyMMdd", "MM/dd/yyyy", "dd.MM.yyyy", "MMM d, yyyy")

_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def named(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TEMPORAL)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into NULL (both mean missing)."""
    column = named(name)
    if is_fractional(df.schema[name].dataType):
        return F.when(~F.isnan(column), column)
    return column


def finite(df: DataFrame, name: str) -> Column:
    """The value as double, NULL when missing, NaN or infinite."""
    value = named(name).cast("double")
    if is_fractional(df.schema[name].dataType):
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    return value


def text_time(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """A text as zone-free timestamp: ISO, or the first of ``formats`` that fits; else NULL."""
    others = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(text.try_cast("timestamp_ntz"), *others)


def wall_time(df: DataFrame, name: str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The column as a zone-free timestamp; text that does not parse becomes NULL."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return text_time(named(name), formats)
    if is_temporal(dtype):
        return named(name).cast("timestamp_ntz")
    raise ValueError(f"column {name} of type {dtype.simpleString()} holds no dates")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def number_text(value: Column) -> Column:
    """A double as text without exponent where 4 to 16 digits before or after the point suffice."""
    plain = lambda scale: F.regexp_replace(value.cast(f"decimal(38,{scale})").cast("string"), r"(\.\d+?)0*$", "$1")
    size = F.abs(value)
    return (
        F.when((size >= 1e7) & (size < 1e16), plain(10))
        .when((size >= 1e-4) & (size < 1e-3), plain(20))
        .otherwise(value.cast("string"))
    )


def as_text(df: DataFrame, name: str) -> Column:
    """Text form used for frequencies and string profiles; nested values become JSON."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, _NESTED):
        return F.to_json(named(name))
    if isinstance(dtype, T.BooleanType):
        return F.initcap(named(name).cast("string"))
    if isinstance(dtype, T.BinaryType):
        return F.base64(named(name))
    if is_fractional(dtype):
        return number_text(present(df, name))
    return present(df, name).cast("string")


def type_categories(df: DataFrame) -> dict[str, str]:
    """NUMERIC, DATETIME or STRING per column.

    A text column counts as DATETIME when its name hints at dates and all its
    values parse; one scan of these columns settles them all.
    """
    found = {}
    for name in df.columns:
        dtype = df.schema[name].dataType
        found[name] = NUMERIC if is_numeric(dtype) else DATETIME if is_temporal(dtype) else STRING
    hinted = [n for n in df.columns if isinstance(df.schema[n].dataType, T.StringType) and any(h in n.lower() for h in DATE_NAME_HINTS)]
    if hinted:
        row = df.agg(*[F.count(c) for n in hinted for c in (named(n), wall_time(df, n))]).first()
        found |= {n: DATETIME for i, n in enumerate(hinted) if row[2 * i] > 0 and row[2 * i] == row[2 * i + 1]}
    return found


def type_category(df: DataFrame, name: str) -> str:
    return type_categories(df.select(named(name)))[name]


def stacked(df: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """Several output rows per input row, one per entry of ``rows``."""
    return df.select(F.stack(F.lit(len(rows)), *[c for row in rows for c in row]).alias(*names))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text without zone; fractional seconds only when there are any."""
    ts = ts.cast("timestamp_ntz")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == ".000000", "").otherwise(fraction),
    )


def _sanitised(value: Column, dtype: T.DataType) -> Column:
    if is_fractional(dtype):
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(value)
    if isinstance(dtype, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _sanitised(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: _sanitised(item, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [_sanitised(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def sanitise(df: DataFrame) -> DataFrame:
    """Make every value legal JSON: NaN and infinities to NULL, times to ISO text, at any depth."""
    return df.select(*[_sanitised(named(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
