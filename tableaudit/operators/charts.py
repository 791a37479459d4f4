"""Chart-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, other_columns, quoted, value_of
from ..plans.aggregates import per_column, small_table
from ..plans.freq import value_counts, whole_texts
from ..plans.quantiles import exact_quantiles
from ..sources.sampling import sample_rows
from .distribution import numeric_values
from .features import detect_datetime, parsed_time
from .relations import pearson_matrix

CHART_ROWS = 10_000


def corr_heatmap(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(x, y, r)`` for every ordered pair, the diagonal included."""
    names = list(columns) if columns is not None else numeric_columns(df, flags=False)
    if len(names) < 2:
        return small_table(df.sparkSession, [], "x string, y string, r double")
    pairs = pearson_matrix(df, names)
    cell = lambda x, y, r: F.struct(x.alias("x"), y.alias("y"), r.alias("r"))
    a, b, r = F.col("col1"), F.col("col2"), F.col("r")
    sides = pairs.select(F.inline(F.array(cell(a, b, r), cell(b, a, r))))
    spread = per_column(df, {c: {"v": F.var_pop(v)} for c, v in numeric_values(df, names).items()})
    diagonal = spread.select(F.col("column").alias("x"), F.col("column").alias("y"), F.when(F.col("v") > 0, 1.0).alias("r"))
    return sides.unionByName(diagonal)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``(bin, low, high, n)`` with ``bins`` equal-width bins over all rows; the maximum falls in the last bin."""
    v = value_of(df, column)
    schema = "bin int, low double, high double"
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        return small_table(df.sparkSession, [], schema + ", n bigint")
    count = bins if high > low else 1
    width = (high - low) / count if high > low else 1.0
    at = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(count - 1)).cast("int")
    counted = df.where(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = small_table(df.sparkSession, [(i, low + i * width, low + (i + 1) * width) for i in range(count)], schema)
    return edges.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def box_stats(df: DataFrame, columns: Sequence[str] | None = None, fence: float = 1.5) -> DataFrame:
    """Quartiles, whiskers inside the fences and points outside, for every numeric column."""
    names = list(columns) if columns is not None else numeric_columns(df, flags=False)
    values = numeric_values(df, names)
    quarts = exact_quantiles(df, values, [0.25, 0.5, 0.75])
    stats = {}
    for c, q in quarts.items():
        v, iqr = values[c], q[0.75] - q[0.25]
        inside = v.between(q[0.25] - fence * iqr, q[0.75] + fence * iqr)
        stats[c] = {
            "q25": F.max(F.lit(q[0.25])),
            "median": F.max(F.lit(q[0.5])),
            "q75": F.max(F.lit(q[0.75])),
            "whisker_low": F.min(F.when(inside, v)),
            "whisker_high": F.max(F.when(inside, v)),
            "n_outside": F.count_if(~inside),
        }
    if not stats:
        return small_table(
            df.sparkSession,
            [],
            "position int, column string, q25 double, median double, q75 double, whisker_low double, "
            "whisker_high double, n_outside bigint",
        )
    return per_column(df, stats)


def top_pair(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col1, col2, r)`` of the pair with the largest absolute correlation, the first of a tie."""
    names = list(columns) if columns is not None else numeric_columns(df, flags=False)
    best = F.min_by(F.struct("col1", "col2", "r"), F.struct(-F.coalesce(F.abs("r"), F.lit(-1.0)), F.col("pair")))
    return pearson_matrix(df, names).agg(best.alias("best")).select("best.*")


def top_pair_scatter(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    rows: int = CHART_ROWS,
    seed: int = 42,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """``(x, y)`` sample points of the most correlated pair; the columns are named in ``x_name, y_name``."""
    pair = top_pair(df, columns).first()
    if pair is None or pair["col1"] is None:
        return small_table(df.sparkSession, [], "x_name string, y_name string, x double, y double")
    a, b = pair["col1"], pair["col2"]
    return sample_rows(df, rows, seed, keys).select(
        F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), value_of(df, a).alias("x"), value_of(df, b).alias("y")
    )


def trend(
    df: DataFrame,
    ts: str,
    value: str,
    rows: int = CHART_ROWS,
    seed: int = 42,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """``(ts, value)`` of a fixed-size sample in time order."""
    drawn = sample_rows(df, rows, seed, keys)
    return drawn.select(parsed_time(df, ts).alias("ts"), value_of(df, value).alias("value")).orderBy(
        F.col("ts").asc_nulls_last()
    )


def trend_means(df: DataFrame, ts: str, value: str, unit: str = "day") -> DataFrame:
    """``(ts, n, mean)`` of all rows by calendar unit, in time order; rows without a time come last."""
    rows = df.select(F.date_trunc(unit, parsed_time(df, ts)).alias("ts"), value_of(df, value).alias("value"))
    means = rows.groupBy("ts").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return means.orderBy(F.col("ts").asc_nulls_last())


def frequency(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` of one column, most frequent first."""
    return whole_texts(df, value_counts(df, [column])).select("value", "n").orderBy(F.desc("n"), "value")


def missing_matrix(df: DataFrame) -> DataFrame:
    """0/1 table of missing cells."""
    return df.select(
        *[
            (value_of(df, c) if c in numeric_columns(df) else quoted(c)).isNull().cast("int").alias(c)
            for c in df.columns
        ]
    )


def chart_tables(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """The tables behind the five standard charts."""
    numeric, other = numeric_columns(df, flags=False), other_columns(df)
    out = {}
    if len(numeric) >= 2:
        out["correlation_heatmap"] = corr_heatmap(df, numeric)
        out["scatter"] = top_pair_scatter(df, numeric)
    main = target if target in df.columns else (numeric + other + [None])[0]
    if main is not None:
        out["distribution"] = histogram(df, main) if main in numeric else frequency(df, main)
    if numeric:
        out["box"] = box_stats(df)
    dates = detect_datetime(df)
    if dates and numeric:
        out["trend"] = trend(df, dates[0], numeric[0])
    elif other:
        out["frequency"] = frequency(df, other[0])
    return out
