"""Median and mode fill values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, key_of, quoted, text_of, value_of
from ..plans.freq import most_frequent, value_counts
from ..plans.quantiles import counts_of, exact_quantiles


def fit_fill(df: DataFrame, numeric: Sequence[str], other: Sequence[str], unknown: str = "Unknown") -> dict[str, object]:
    """{column: fill value}: exact median, or most frequent value (smallest of a tie, ``unknown`` if none)."""
    values = {c: value_of(df, c) for c in numeric}
    counts = counts_of(df, values) if values else {}
    medians = exact_quantiles(df, {c: v for c, v in values.items() if counts[c]}, [0.5], counts)
    fill: dict[str, object] = {c: m[0.5] for c, m in medians.items()}
    if other:
        tops = {r["column"]: r["top_value"] for r in most_frequent(value_counts(df, other)).collect()}
        for c in other:
            fill[c] = _whole_text(df, c, tops[c]) if c in tops else unknown
    return fill


def _whole_text(df: DataFrame, column: str, key: str) -> str:
    """The text behind a bounded key."""
    if "\u0000" not in key:
        return key
    text = text_of(df, column)
    return df.where(key_of(text) == key).select(text.alias("text")).first()["text"]


def apply_fill(df: DataFrame, fill: Mapping[str, object], only: Sequence[str] | None = None) -> DataFrame:
    """Fill missing values; integer columns become doubles, as a median may be fractional."""
    out = []
    for f in df.schema.fields:
        c = f.name
        if c not in fill or (only is not None and c not in only):
            out.append(quoted(c))
        elif is_numeric(f.dataType):
            out.append(F.coalesce(value_of(df, c), F.lit(float(fill[c]))).alias(c))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.coalesce(quoted(c), F.lit(fill[c])).alias(c))
        else:
            out.append(F.coalesce(quoted(c), F.lit(fill[c]).try_cast(f.dataType)).alias(c))
    return df.select(*out)
