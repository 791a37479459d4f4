"""Missing values, duplicates, constants, placeholders, spelling variants and the quality score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import severity
from ..functions.columns import (
    is_numeric,
    key_of,
    other_columns,
    quoted,
    row_digest,
    stripped,
    text_of,
    value_of,
)
from ..functions.constants import SENTINELS
from ..plans.aggregates import per_column, small_table
from ..plans.freq import bucket_counts, most_frequent, value_counts, whole_texts

_FIXED = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_SIMPLE = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _ordered(df: DataFrame, name: str):
    """Expression with a natural order, for smallest and largest value."""
    dtype = df.schema[name].dataType
    if is_numeric(dtype):
        return value_of(df, name) if not isinstance(dtype, (T.LongType, T.DecimalType)) else quoted(name)
    return quoted(name) if isinstance(dtype, _SIMPLE) else text_of(df, name)


def _scan(df: DataFrame, sentinels: bool = True) -> DataFrame:
    """Every per-column fact that one scan can give."""
    stats = {}
    for name in df.columns:
        value = _ordered(df, name)
        numeric = is_numeric(df.schema[name].dataType)
        facts = {
            "total_rows": F.count(F.lit(1)),
            "present": F.count(value),
            "is_constant": F.coalesce(F.min(value) == F.max(value), F.lit(False)),
            "has_negative": F.coalesce(F.min(value) < 0, F.lit(False)) if numeric else F.lit(False),
        }
        if sentinels:
            facts["sentinels"] = _sentinels(df, name)
        stats[name] = facts
    return per_column(df, stats)


def missing_values(df: DataFrame, labels: str = "evidence") -> DataFrame:
    """``(position, column, total_rows, null_count, missing_pct, severity)`` for every column.

    ``labels="legacy"`` uses the older three-step wording and two decimals.
    """
    legacy = labels == "legacy"
    counts = per_column(
        df,
        {
            c: {"total_rows": F.count(F.lit(1)), "present": F.count(_ordered(df, c))}
            for c in df.columns
        },
    )
    return _missing(counts, legacy)


def _missing(counts: DataFrame, legacy: bool = False, *extra: str) -> DataFrame:
    nulls = F.col("total_rows") - F.col("present")
    pct = F.coalesce(F.round(F.try_divide(nulls * 100.0, F.col("total_rows")), 2 if legacy else 4), F.lit(0.0))
    level = severity.missing_level if legacy else severity.missing_severity
    out = counts.select("position", "column", "total_rows", nulls.alias("null_count"), pct.alias("missing_pct"), *extra)
    return out.withColumn("severity", level(F.col("missing_pct")))


def column_quality(df: DataFrame, quasi_share: float = 95.0, by: Sequence[str] | None = None) -> DataFrame:
    """One row per column: missing values, constant and near-constant values, negatives, placeholders.

    Near-constant columns need exact value counts. A value that covers 95 % of the rows makes its hash
    bucket cover 95 %, so only columns with such a bucket are counted by value; identifiers, measurements
    and free text never reach that shuffle. With ``by``, one row per segment and column.
    """
    if by:
        from .segments import column_quality_by

        return column_quality_by(df, by, quasi_share)
    facts = _scan(df).collect()
    spark = df.sparkSession
    rows = [tuple(r) for r in facts]
    table = small_table(
        spark,
        rows,
        "position int, column string, total_rows bigint, present bigint, is_constant boolean, "
        "has_negative boolean, sentinels array<string>",
    )
    varied = {r["column"]: r["present"] for r in facts if r["present"] > 0 and not r["is_constant"]}
    candidates = []
    if varied:
        largest = bucket_counts(df, list(varied)).groupBy("column").agg(F.max("n").alias("n")).collect()
        candidates = [r["column"] for r in largest if r["n"] * 100.0 >= quasi_share * varied[r["column"]]]
    if candidates:
        share = F.col("top_n") * 100.0 / F.col("total")
        top = (
            most_frequent(value_counts(df, candidates))
            .where((share >= quasi_share) & (F.col("nunique") > 1))
            .select(
                F.col("column"),
                F.col("top_value"),
                F.round(share, 2).alias("top_pct"),
            )
        )
        table = table.join(whole_texts(df, top, "top_value"), "column", "left")
    else:
        table = table.withColumns({"top_value": F.lit(None).cast("string"), "top_pct": F.lit(None).cast("double")})
    table = table.withColumn("is_quasi_constant", F.col("top_pct").isNotNull())
    return _missing(
        table, False, "is_constant", "is_quasi_constant", "top_value", "top_pct", "has_negative", "sentinels"
    )


def row_counts(df: DataFrame) -> DataFrame:
    """Distinct rows with their multiplicity ``n``, missing values equal.

    Long text is compared by a bounded key. Tables of more than 32 columns are grouped by a digest of the
    row, which keeps the shuffle at 32 bytes a row.
    """
    if len(df.columns) > 32:
        keyed = df.select(row_digest(df).alias("c0"))
    else:
        keyed = df.select(*[_row_key(df, f).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))


def _row_key(df: DataFrame, field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return value_of(df, field.name)
    if is_numeric(field.dataType) or isinstance(field.dataType, _FIXED):
        return quoted(field.name)
    return key_of(text_of(df, field.name))


def duplicates(df: DataFrame) -> DataFrame:
    """``(total_rows, duplicate_rows, duplicate_pct, duplicate_severity)``: rows after the first of a kind."""
    counted = row_counts(df).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    pct = F.coalesce(F.round(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("total_rows")), 4), F.lit(0.0))
    return counted.withColumn("duplicate_pct", pct).withColumn(
        "duplicate_severity", severity.duplicate_severity(F.col("duplicate_pct"))
    )


def sentinel_values(df: DataFrame) -> DataFrame:
    """``(position, column, sentinels)`` for columns that hold placeholder values, compared as text."""
    return per_column(df, {c: {"sentinels": _sentinels(df, c)} for c in df.columns}).where(F.size("sentinels") > 0)


def _sentinels(df: DataFrame, name: str) -> Column:
    """Sorted placeholder texts of one column. Only text and whole numbers can equal one."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        numbers = [int(s) for s in SENTINELS if s.lstrip("-").isdigit()]
        seen = F.when(quoted(name).cast("bigint").isin(numbers), quoted(name).cast("string"))
    elif isinstance(dtype, T.StringType):
        # longer texts can only match after removal of outer whitespace
        text = stripped(quoted(name))
        seen = F.when(text.isin(SENTINELS), text)
    else:
        seen = F.lit(None).cast("string")
    return F.sort_array(F.collect_set(seen))


def _normal_keys(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, norm, form)``: bounded keys of the normalised and of the raw text."""
    rows = F.array(
        *[
            F.when(
                quoted(n).isNotNull(),
                F.struct(
                    F.lit(n).alias("column"),
                    key_of(F.lower(stripped(text_of(df, n)))).alias("norm"),
                    key_of(text_of(df, n)).alias("form"),
                ),
            )
            for n in names
        ]
    )
    return df.select(F.inline(F.array_compact(rows)))


def variant_groups(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(column, norm)`` whose raw values differ only by case or outer whitespace."""
    names = list(names) if names is not None else _text_columns(df)
    if not names:
        return small_table(df.sparkSession, [], "column string, norm string")
    return (
        _normal_keys(df, names)
        .groupBy("column", "norm")
        .agg(F.min("form").alias("low"), F.max("form").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("column", "norm")
    )


def _text_columns(df: DataFrame) -> list[str]:
    """Non-numeric columns whose values can differ by case or whitespace."""
    return [c for c in other_columns(df) if not isinstance(df.schema[c].dataType, _FIXED)]


def category_variants(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(column, normalised, variant, n)``: every raw form in a group of spelling variants."""
    names = list(names) if names is not None else _text_columns(df)
    if not names:
        return small_table(df.sparkSession, [], "column string, normalised string, variant string, n bigint")
    forms = _normal_keys(df, names).groupBy("column", "norm", "form").agg(F.count(F.lit(1)).alias("n"))
    found = forms.join(variant_groups(df, names), ["column", "norm"], "left_semi")
    found = whole_texts(df, whole_texts(df, found, "form"), "norm", form=lambda text: F.lower(stripped(text)))
    return found.select("column", F.col("norm").alias("normalised"), F.col("form").alias("variant"), "n")


def table_quality(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """One row: missing cells, duplicates, score parts, overall score, grade and dimensionality.

    With ``by``, one row per segment.
    """
    if by:
        from .segments import table_quality_by

        return table_quality_by(df, by)
    width = len(df.columns)
    cells = per_column(
        df,
        {
            c: {
                "rows": F.count(F.lit(1)),
                "nulls": F.count(F.lit(1)) - F.count(_ordered(df, c)),
                "negative": F.coalesce(F.min(value_of(df, c)) < 0, F.lit(False)).cast("int")
                if is_numeric(df.schema[c].dataType)
                else F.lit(0),
            }
            for c in df.columns
        },
    ).agg(
        F.max("rows").alias("total_rows"),
        F.sum("nulls").alias("total_nulls"),
        F.sum("negative").alias("negative_columns"),
    )
    copies = row_counts(df).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    variants = variant_groups(df).agg(F.count_distinct("column").alias("variant_columns"))
    parts = [cells, copies, variants]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = one.agg(*[F.max(c).alias(c) for c in one.columns])
    return scored(one, width)


def scored(one: DataFrame, width: int, *keys: str) -> DataFrame:
    """Score parts, overall score and grade from the counts of a table (or of each segment) with ``width`` columns."""
    total = F.greatest(F.col("total_rows") * width, F.lit(1))
    none_if_empty = F.nullif(F.col("total_rows"), F.lit(0))

    def share(part: Column) -> Column:
        return F.greatest(F.lit(0.0), 100.0 * (1.0 - F.coalesce(part, F.lit(0.0))))

    parts = one.select(
        "*",
        share(F.col("total_nulls") / total).alias("__complete"),
        share(F.col("duplicate_rows") / none_if_empty).alias("__unique"),
        share(F.col("negative_columns") / F.lit(float(max(width, 1)))).alias("__valid"),
        share(F.col("variant_columns") / F.lit(float(max(width, 1)))).alias("__consistent"),
    )
    score = F.round(
        0.40 * F.col("__complete") + 0.20 * F.col("__unique") + 0.20 * F.col("__valid") + 0.20 * F.col("__consistent"), 1
    )
    dup_pct = F.coalesce(F.round(F.col("duplicate_rows") * 100.0 / none_if_empty, 4), F.lit(0.0))
    ratio = F.coalesce(F.round(F.lit(float(width)) / none_if_empty, 4), F.lit(0.0))
    return parts.select(
        *keys,
        "total_rows",
        F.lit(width).alias("total_cols"),
        "total_nulls",
        F.round(F.col("total_nulls") * 100.0 / total, 2).alias("overall_missing_pct"),
        "duplicate_rows",
        dup_pct.alias("duplicate_pct"),
        severity.duplicate_severity(dup_pct).alias("duplicate_severity"),
        "negative_columns",
        "variant_columns",
        F.round("__complete", 1).alias("completeness"),
        F.round("__unique", 1).alias("uniqueness"),
        F.round("__valid", 1).alias("validity"),
        F.round("__consistent", 1).alias("consistency"),
        score.alias("overall_score"),
        severity.grade(score).alias("grade"),
        ratio.alias("dimensionality_ratio"),
        (ratio > 0.1).alias("is_high_dimensional"),
    )
