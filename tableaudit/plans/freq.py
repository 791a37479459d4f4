"""Value-count tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import KEY_LENGTH, key_of, plain_number, quoted, text_of, value_of


def long_form(df: DataFrame, columns: Mapping[str, Column], name: str = "column") -> DataFrame:
    """``(name, value)`` without missing values; ``columns`` maps a label to an expression."""
    labels = list(columns)
    wide = df.select(*[columns[c].alias(c) for c in labels])
    if len(labels) == 1:
        long = wide.select(F.lit(labels[0]).alias(name), quoted(labels[0]).alias("value"))
    else:
        long = wide.unpivot([], [quoted(c) for c in labels], name, "value")
    return long.where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str], whole: bool = False) -> DataFrame:
    """``(column, value, n)``: occurrences of every non-missing value, as text.

    Partial counts are formed before the shuffle, so a value held by a third of all rows costs one row per
    task. Long text travels as a bounded key unless ``whole`` is set.
    """
    texts, floats = {}, []
    for c in columns:
        dtype = df.schema[c].dataType
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            texts[c] = value_of(df, c).cast("string")
            floats.append(c)
        else:
            long_text = isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType))
            texts[c] = key_of(text_of(df, c)) if long_text and not whole else text_of(df, c)
    counts = long_form(df, texts).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if floats:  # one spelling per number is enough to count by; the readable one is for distinct values only
        readable = F.when(F.col("column").isin(floats), plain_number(F.col("value").try_cast("double")))
        counts = counts.withColumn("value", F.coalesce(readable, F.col("value")))
    return counts


def whole_texts(
    df: DataFrame, found: DataFrame, value: str = "value", column: str = "column", form: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``found`` with the whole text in place of each bounded key in ``value``.

    Only texts longer than a key are read, and one copy of each travels. ``form`` is what was done to the text before
    the key was made.
    """
    kinds = (T.StringType, T.ArrayType, T.MapType, T.StructType)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    if not names:
        return found
    texts = [form(text_of(df, c)) if form else text_of(df, c) for c in names]
    rows = F.array(*[F.struct(F.lit(c).alias(column), t.alias("__whole")) for c, t in zip(names, texts)])
    long = df.select(F.inline(rows)).where(F.length("__whole") > KEY_LENGTH)
    keyed = long.select(column, key_of(F.col("__whole")).alias(value), "__whole")
    wanted = found.where(F.length(value) > KEY_LENGTH).select(column, value).distinct()
    whole = keyed.join(wanted, [column, value], "left_semi").groupBy(column, value).agg(F.max("__whole").alias("__whole"))
    out = found.join(whole, [column, value], "left").withColumn(value, F.coalesce("__whole", value))
    return out.select(*found.columns)


def number_counts(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``(column, value, n)`` of numeric expressions, values as doubles."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """``(column, top_value, top_n, nunique, total)``; ties go to the smallest value."""
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
        F.max("n").alias("top_n"),
        F.count(F.lit(1)).alias("nunique"),
        F.sum("n").alias("total"),
    )


def few_valued(df: DataFrame, columns: Sequence[str], limit: int) -> list[str]:
    """Columns that may have fewer than ``limit`` distinct values (``limit`` well below the bucket count).

    Such a column fills fewer than ``limit`` hash buckets, so nothing is lost; identifiers and free text are
    left out after a shuffle of a few bucket counts per task.
    """
    if not columns:
        return []
    filled = bucket_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["column"]: r["n"] for r in filled.collect()}
    return [c for c in columns if sizes.get(c, 0) < limit]


_BUCKETS = 128


def bucket_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)``: non-missing rows per hash bucket of the value, 128 buckets a column."""
    buckets = {}
    for c in columns:
        value = value_of(df, c) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else quoted(c)
        if isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType)):
            value = text_of(df, c)
        buckets[c] = F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(_BUCKETS)).cast("int"))
    return long_form(df, buckets).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
