"""Column classes and per-column value expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import MISSING_FLAG_SUFFIX, WHITESPACE

_FLOATS = (T.FloatType, T.DoubleType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> Column:
    """Column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    """Integers, floats and decimals. Booleans, dates and text are not numeric."""
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (), flags: bool = True) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if is_numeric(f.dataType) and f.name not in exclude and (flags or not f.name.endswith(MISSING_FLAG_SUFFIX))
    ]


def other_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name not in exclude]


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, non-numeric) column names in schema order."""
    return numeric_columns(df), other_columns(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes NULL and -0.0 becomes 0.0 in float columns."""
    if not any(isinstance(f.dataType, _FLOATS) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(f.name)), quoted(f.name) + F.lit(0).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, _FLOATS)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def value_of(df: DataFrame, name: str) -> Column:
    """Numeric column as a double without NaN."""
    dtype = df.schema[name].dataType
    col = quoted(name)
    if isinstance(dtype, _FLOATS):
        return F.when(~F.isnan(col), col.cast("double") + F.lit(0.0))
    return col.cast("double")


def plain_number(col: Column) -> Column:
    """Double as text without exponent, whole numbers with a trailing ``.0``."""
    size = F.abs(col)
    text = col.cast("string")
    whole = F.concat(col.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    digits = F.regexp_replace(col.cast("decimal(38,12)").cast("string"), "0+$", "")
    return (
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e16) | (size < 1e-4), text)
        .when(col == F.floor(col), whole)
        .otherwise(F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits))
    )


def text_of(df: DataFrame, name: str) -> Column:
    """Any column as text, NULL where missing."""
    dtype = df.schema[name].dataType
    col = quoted(name)
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, _FLOATS):
        return plain_number(value_of(df, name))
    if isinstance(dtype, _NESTED):
        return F.to_json(col)
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    return col.cast("string")


def stripped(col: Column) -> Column:
    """Remove leading and trailing whitespace of every Unicode kind."""
    return F.btrim(col, F.lit(WHITESPACE))


#: Longer text travels as its first characters and a digest.
KEY_LENGTH = 256


def key_of(col: Column, longest: int = KEY_LENGTH) -> Column:
    """Text as a grouping key of bounded width.

    Short text is its own key. Longer text keeps its first characters and adds the SHA-256 digest of the
    whole text, so that equal keys mean equal text and no shuffle carries whole documents.
    """
    return F.when(F.length(col) <= longest, col).otherwise(
        F.concat(F.substring(col, 1, longest), F.lit("\u0000"), F.sha2(col, 256))
    )


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a whole row; lengths are written before values, so different rows never join up alike."""
    parts = []
    for name in df.columns:
        text = text_of(df, name)
        parts.append(
            F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))
        )
    return F.unhex(F.sha2(F.concat(*parts), 256))
