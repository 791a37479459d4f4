"""Interaction terms, log transforms and date parts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns, other_columns, quoted, stripped
from ..plans.aggregates import small_table
from ..plans.pairs import pair_moments
from .distribution import moments, numeric_values

# Date layouts tried after ISO dates and timestamps.
DATE_LAYOUTS = ["yyyy/MM/dd", "MM/dd/yyyy", "MM-dd-yyyy", "dd-MMM-yyyy", "MMM d, yyyy", "yyyyMMdd"]


@dataclass
class Engineered:
    data: DataFrame
    report: DataFrame  # (kind, feature, source, before, after)


def parsed_time(df: DataFrame, column: str) -> Column:
    """Timestamp of a column, NULL where it cannot be read as one."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return quoted(column).cast("timestamp")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp")
    text = stripped(quoted(column))
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}(-\d{1,2}([T ].*)?)?$"), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(p)) for p in DATE_LAYOUTS])


def detect_datetime(df: DataFrame, share: float = 0.5, exclude: Sequence[str] = ()) -> list[str]:
    """Non-numeric columns of which more than ``share`` of all rows parse as a time, in schema order."""
    maybe = [
        c
        for c in other_columns(df, exclude)
        if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType))
    ]
    if not maybe:
        return []
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(parsed_time(df, c)).alias(f"c{i}") for i, c in enumerate(maybe)]
    ).first()
    return [c for i, c in enumerate(maybe) if row["n"] and row[f"c{i}"] / row["n"] > share]


def date_parts(df: DataFrame, columns: Sequence[str] | None = None, keep: bool = False) -> DataFrame:
    """``<c>_year, _month, _dayofweek`` (Monday 0) and ``_is_weekend`` (0/1, 0 if missing); ``<c>`` is dropped."""
    names = list(columns) if columns is not None else detect_datetime(df)
    parts = {}
    for c in names:
        ts = parsed_time(df, c)
        parts[f"{c}_year"] = F.year(ts)
        parts[f"{c}_month"] = F.month(ts)
        parts[f"{c}_dayofweek"] = F.weekday(ts)
        parts[f"{c}_is_weekend"] = F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0))
    kept = [quoted(c) for c in df.columns if keep or c not in names]
    return df.select(*kept, *[expr.alias(name) for name, expr in parts.items()])


def interaction_pairs(
    df: DataFrame, columns: Sequence[str], lo: float = 0.2, hi: float = 0.85, top: int | None = None
) -> list[tuple[str, str, float]]:
    """(a, b, |r|) of the pairs with ``lo < |r| < hi``, strongest first; ``top`` keeps the first ones."""
    values = numeric_values(df, columns)
    if len(values) < 2:
        return []
    size = F.abs("r")
    best = pair_moments(df, values).where((size > lo) & (size < hi)).orderBy(F.desc(size), "pair")
    best = best if top is None else best.limit(top)
    return [tuple(r) for r in best.select("col1", "col2", size.alias("size")).collect()]


def interactions(
    df: DataFrame, columns: Sequence[str] | None = None, lo: float = 0.2, hi: float = 0.85, top: int | None = None
) -> DataFrame:
    """Add ``a_x_b`` = (a - mean a) * (b - mean b) for moderately correlated pairs.

    Means are rounded to 12 significant digits: the order in which tasks add up does not show.
    """
    names = list(columns) if columns is not None else numeric_columns(df, flags=False)
    pairs = interaction_pairs(df, names, lo, hi, top)
    return _add_interactions(df, pairs)


def _add_interactions(df: DataFrame, pairs: Sequence[tuple[str, str, float]]) -> DataFrame:
    if not pairs:
        return df
    used = list(dict.fromkeys(c for a, b, _ in pairs for c in (a, b)))
    values = numeric_values(df, used)
    means = df.agg(*[F.avg(values[c]).alias(f"m{i}") for i, c in enumerate(used)]).first()
    centred = {c: values[c] - F.lit(float(f"{means[i]:.12g}")) for i, c in enumerate(used)}
    return df.withColumns({f"{a}_x_{b}": centred[a] * centred[b] for a, b, _ in pairs})


def log_shift(low: float) -> float:
    """Added before the logarithm so that its argument is at least 1."""
    return abs(low) + 1.0 if low <= 0 else 0.0


def log_skewed(df: DataFrame, columns: Sequence[str] | None = None, skew: float = 1.0) -> DataFrame:
    """Add ``<c>_log1p`` for columns with absolute skewness above ``skew``."""
    names = list(columns) if columns is not None else numeric_columns(df, flags=False)
    return _add_logs(df, _skewed(df, names, skew))


def _skewed(df: DataFrame, names: Sequence[str], skew: float) -> list[tuple[str, float, float]]:
    values = numeric_values(df, names)
    if not values:
        return []
    found = moments(df, values).where((F.col("n") > 2) & (F.abs("skewness") > skew)).orderBy("position").collect()
    return [(r["column"], r["skewness"], r["low"]) for r in found]


def _add_logs(df: DataFrame, skewed: Sequence[tuple[str, float, float]]) -> DataFrame:
    values = numeric_values(df, [c for c, _, _ in skewed])
    logs = {f"{c}_log1p": F.log1p(values[c] + F.lit(log_shift(low))) for c, _, low in skewed}
    return df.withColumns(logs) if logs else df


def engineer(df: DataFrame, target: str | None = None) -> Engineered:
    """Interactions, log transforms and date parts, with a report of what was added."""
    skip = [target] if target else []
    numeric = numeric_columns(df, exclude=skip, flags=False)
    dates = detect_datetime(df, exclude=skip)
    pairs = interaction_pairs(df, numeric)
    skewed = _skewed(df, numeric, 1.0)
    out = _add_logs(_add_interactions(df, pairs), skewed)
    after = {}
    if skewed:
        logs = numeric_values(out, [f"{c}_log1p" for c, _, _ in skewed])
        after = {r["column"]: r["skewness"] for r in moments(out, logs).collect()}
    rows = [("interaction", f"{a}_x_{b}", f"{a}, {b}", r, None) for a, b, r in pairs]
    rows += [("log1p", f"{c}_log1p", c, s, after[f"{c}_log1p"]) for c, s, _ in skewed]
    rows += [
        ("date_part", f"{c}_{part}", c, None, None)
        for c in dates
        for part in ("year", "month", "dayofweek", "is_weekend")
    ]
    report = small_table(
        df.sparkSession, rows, "kind string, feature string, source string, before double, after double"
    )
    return Engineered(date_parts(out, dates), report)


# --- older optional forms -------------------------------------------------------------------------------
def squared_skewed(df: DataFrame, columns: Sequence[str] | None = None, skew: float = 1.0) -> DataFrame:
    """Add ``<c>_sq`` for columns with absolute skewness above ``skew``."""
    names = list(columns) if columns is not None else numeric_columns(df, flags=False)
    values = numeric_values(df, names)
    added = {f"{c}_sq": values[c] * values[c] for c, _, _ in _skewed(df, names, skew)}
    return df.withColumns(added) if added else df


def raw_interactions(
    df: DataFrame, columns: Sequence[str] | None = None, lo: float = 0.3, top: int | None = None
) -> DataFrame:
    """Add plain products of the pairs with ``|r| > lo``, strongest first."""
    names = list(columns) if columns is not None else numeric_columns(df, flags=False)
    values = numeric_values(df, names)
    pairs = interaction_pairs(df, names, lo, float("inf"), top)
    added = {f"{a}_x_{b}": values[a] * values[b] for a, b, _ in pairs}
    return df.withColumns(added) if added else df
