"""Moments, exact quantiles, outliers, normality and categorical summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import severity
from ..functions.columns import numeric_columns, other_columns, value_of
from ..functions.moments import omnibus, sample_kurtosis, sample_skewness
from ..functions.shapiro import francia_p, score_sums, shapiro_wilk
from ..plans.aggregates import per_column, small_table
from ..plans.freq import long_form, number_counts, value_counts, whole_texts
from ..plans.prefix import bucket_limits, running_totals
from ..plans.quantiles import DIRECT_ROWS, exact_quantiles
from ..plans.spreads import counted_spreads

if TYPE_CHECKING:
    from .facts import Facts

SHAPIRO_ROWS = 5000


def numeric_values(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Column]:
    names = list(columns) if columns is not None else numeric_columns(df)
    return {c: value_of(df, c) for c in names}


def moments(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """``(position, column, n, mean, std, variance, low, high, g1, g2, skewness, kurtosis)``, unrounded.

    ``g1`` and ``g2`` are the biased moments, ``skewness`` and ``kurtosis`` the bias-corrected ones.
    """
    raw = per_column(
        df,
        {
            c: {
                "n": F.count(v),
                "mean": F.avg(v),
                "variance": F.var_samp(v),
                "low": F.min(v),
                "high": F.max(v),
                "g1": F.skewness(v),
                "g2": F.kurtosis(v),
            }
            for c, v in values.items()
        },
    )
    n = F.col("n").cast("double")
    return raw.select(
        "position",
        "column",
        "n",
        "mean",
        F.when(n > 1, F.sqrt("variance")).otherwise(0.0).alias("std"),
        F.when(n > 1, F.col("variance")).otherwise(0.0).alias("variance"),
        "low",
        "high",
        "g1",
        "g2",
        sample_skewness(n, F.col("g1")).alias("skewness"),
        sample_kurtosis(n, F.col("g2")).alias("kurtosis"),
    )


def _shapiro_rows(groups: pd.DataFrame) -> pd.DataFrame:
    w, p = shapiro_wilk(groups["value"].to_numpy())
    return pd.DataFrame({"column": [groups["column"].iloc[0]], "w": [w], "p": [p]})


def normality_from(df: DataFrame, values: Mapping[str, Column], found: Sequence[Row]) -> DataFrame:
    """Normality gate for expressions whose moments are already known.

    Fewer than 8 values: not tested. Up to 5000: Shapiro-Wilk, each sample in one group, which the rule
    itself keeps small. Above: the omnibus test, from the moments alone.
    """
    small = [r["column"] for r in found if 8 <= r["n"] <= SHAPIRO_ROWS]
    tested = None
    if small:
        tested = (
            long_form(df, {c: values[c] for c in small})
            .groupBy("column")
            .applyInPandas(_shapiro_rows, "column string, w double, p double")
        )
    return normality_gate(df.sparkSession, found, tested)


def normality_gate(
    spark: SparkSession, found: Sequence[Mapping], tested: DataFrame | None, method: str = "auto"
) -> DataFrame:
    """The gate from moments (column, n, g1, g2, skewness) and the results ``(column, w, p)`` of a test of the values."""
    table = small_table(
        spark,
        [(r["column"], r["n"], r["g1"], r["g2"], r["skewness"]) for r in found],
        "column string, n bigint, g1 double, g2 double, skewness double",
    )
    if tested is not None:
        table = table.join(tested, "column", "left")
    else:
        table = table.withColumns({"w": F.lit(None).cast("double"), "p": F.lit(None).cast("double")})
    n = F.col("n")
    k2, tail = omnibus(n, F.col("g1"), F.col("g2"))
    few = n < 8
    big = {"auto": n > SHAPIRO_ROWS, "omnibus": F.lit(True), "francia": F.lit(False)}[method]
    stat = F.coalesce(F.when(few, 0.0).when(big, k2).otherwise(F.col("w")), F.lit(0.0))
    p = F.coalesce(F.when(few, 0.0).when(big, tail).otherwise(F.col("p")), F.lit(0.0))
    other = K.FRANCIA if method == "francia" else K.SHAPIRO
    return table.select(
        "column",
        "n",
        F.when(few, K.SAMPLE_CHECK).when(big, K.DAGOSTINO).otherwise(other).alias("test_used"),
        F.round(stat, 4).alias("statistic"),
        F.round(p, 4).alias("p_value"),
        F.round("skewness", 4).alias("skewness"),
        (~few & (p > 0.05) & (F.abs("skewness") < 0.5)).alias("is_normal"),
    )


def normality(df: DataFrame, columns: Sequence[str] | None = None, method: str = "auto") -> DataFrame:
    """``(column, n, test_used, statistic, p_value, skewness, is_normal)`` per numeric column.

    ``auto`` is the published rule: Shapiro-Wilk up to 5000 values, the omnibus test above. ``omnibus`` and ``francia``
    (Shapiro-Francia, from ranks and normal scores) hold for any number of values from 8 on, so that one row more never
    changes the test.
    """
    values = numeric_values(df, columns)
    if not values:
        return _no_normality(df)
    found = moments(df, values).collect()
    if method == "auto":
        return normality_from(df, values, found)
    if method not in ("omnibus", "francia"):
        raise ValueError(f"unknown method: {method}")
    tested = _francia(df, values, found) if method == "francia" else None
    return normality_gate(df.sparkSession, found, tested, method)


def _score_rows(before: pd.Series, n: pd.Series, total: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([score_sums(int(a), int(b), int(c)) for a, b, c in zip(before, n, total)], columns=["sum", "squares"])


def _francia(df: DataFrame, values: Mapping[str, Column], found: Sequence[Row]) -> DataFrame:
    """``(column, w, p)``: the squared correlation of the values with their normal scores.

    Works on value counts and running totals, so a column is spread over many tasks and equal values are one row.
    """
    sizes = {r["column"]: r["n"] for r in found if r["n"] >= 8}
    if not sizes:
        return small_table(df.sparkSession, [], "column string, w double, p double")
    used = {c: values[c] for c in sizes}
    ranked = running_totals(number_counts(df, used), ["n"], bucket_limits(df, used, sizes))
    table = small_table(
        df.sparkSession,
        [(r["column"], r["n"], (r["variance"] or 0.0) * (r["n"] - 1), r["mean"]) for r in found if r["n"] >= 8],
        "column string, total bigint, ss double, mean double",
    )
    scores = F.pandas_udf(_score_rows, "sum double, squares double")
    rows = ranked.join(F.broadcast(table), "column").withColumn("m", scores("n_before", "n", "total"))
    sums = rows.groupBy("column", "total", "ss").agg(
        F.sum(F.col("m.sum") * (F.col("value") - F.col("mean"))).alias("cross"), F.sum("m.squares").alias("squares")
    )
    out = []
    for r in sums.collect():  # one row per column
        whole = r["ss"] * r["squares"]
        w = min(1.0, r["cross"] ** 2 / whole) if whole and whole == whole and whole != float("inf") else None
        out.append((r["column"], w, None if w is None else francia_p(w, r["total"])))
    return small_table(df.sparkSession, out, "column string, w double, p double")


def _no_normality(df: DataFrame) -> DataFrame:
    return small_table(
        df.sparkSession,
        [],
        "column string, n bigint, test_used string, statistic double, p_value double, skewness double, is_normal boolean",
    )


def spread(
    df: DataFrame, values: Mapping[str, Column], counts: Mapping[str, int]
) -> dict[str, dict[str, float]]:
    """Exact median, quartiles and median absolute deviation of each expression."""
    values = {c: v for c, v in values.items() if counts[c] > 0}
    quarts = exact_quantiles(df, values, [0.25, 0.5, 0.75], {c: counts[c] for c in values})
    away = {c: F.abs(v - F.lit(quarts[c][0.5])) for c, v in values.items()}
    mads = exact_quantiles(df, away, [0.5], {c: counts[c] for c in values})
    return {
        c: {"q25": quarts[c][0.25], "median": quarts[c][0.5], "q75": quarts[c][0.75], "mad": mads[c][0.5]}
        for c in values
    }


def spread_table(
    df: DataFrame, values: Mapping[str, Column], counts: Mapping[str, int], mad_limit: float = 3.5, fence: float = 1.5
) -> DataFrame:
    """``(column, n, q25, median, q75, mad, mad_count, iqr_count, total_outliers)`` of each expression with values.

    Columns of up to ``DIRECT_ROWS`` values take everything from one table of value counts; larger ones bracket their
    quantiles and count outliers in a scan.
    """
    small = {c: v for c, v in values.items() if 0 < counts[c] <= DIRECT_ROWS}
    large = {c: v for c, v in values.items() if counts[c] > DIRECT_ROWS}
    parts = []
    if small:
        parts.append(counted_spreads(long_form(df, small), ["column"], mad_limit, fence))
    if large:
        found = spread(df, large, counts)
        rows = [(c, s["q25"], s["median"], s["q75"], s["mad"]) for c, s in found.items()]
        table = small_table(df.sparkSession, rows, "column string, q25 double, median double, q75 double, mad double")
        parts.append(table.join(count_outliers(df, large, found, mad_limit, fence).drop("position"), "column"))
    return reduce(DataFrame.unionByName, parts)


def sketched_spread(df: DataFrame, values: Mapping[str, Column]) -> dict[str, dict[str, float]]:
    """Quartiles, median and median absolute deviation from quantile sketches."""
    row = df.agg(*[F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000) for v in values.values()]).first()
    quarts = dict(zip(values, row))
    row = df.agg(
        *[F.percentile_approx(F.abs(v - F.lit(quarts[c][1])), 0.5, 10_000) for c, v in values.items()]
    ).first()
    return {
        c: {"q25": quarts[c][0], "median": quarts[c][1], "q75": quarts[c][2], "mad": mad}
        for c, mad in zip(values, row)
    }


def outlier_rules(
    value: Column, s: Mapping[str, float], mad_limit: float = 3.5, fence: float = 1.5
) -> tuple[Column, Column]:
    """(modified z score beyond ``mad_limit``, outside the quartile fences) for one expression."""
    iqr = s["q75"] - s["q25"]
    far = (0.6745 * F.abs(value - F.lit(s["median"])) / F.lit(s["mad"]) > mad_limit) if s["mad"] > 0 else F.lit(False)
    out = (value < s["q25"] - fence * iqr) | (value > s["q75"] + fence * iqr)
    return far, out


def count_outliers(
    df: DataFrame,
    values: Mapping[str, Column],
    spreads: Mapping[str, Mapping[str, float]],
    mad_limit: float = 3.5,
    fence: float = 1.5,
) -> DataFrame:
    """``(position, column, n, mad_count, iqr_count, total_outliers)`` in one scan."""
    stats = {}
    for c, v in values.items():
        if c not in spreads:
            continue
        far, out = outlier_rules(v, spreads[c], mad_limit, fence)
        stats[c] = {
            "n": F.count(v),
            "mad_count": F.count_if(far & v.isNotNull()),
            "iqr_count": F.count_if(out),
            "total_outliers": F.count_if((far & v.isNotNull()) | out),
        }
    return per_column(df, stats)


def outliers(
    df: DataFrame, columns: Sequence[str] | None = None, mad_limit: float = 3.5, fence: float = 1.5
) -> DataFrame:
    """Outlier counts, share and severity per numeric column."""
    values = numeric_values(df, columns)
    counts = {r["column"]: r["n"] for r in moments(df, values).select("column", "n").collect()} if values else {}
    if not any(counts.values()):
        return _no_outliers(df)
    places = small_table(df.sparkSession, [(i, c) for i, c in enumerate(c for c in values if counts[c] > 0)], "position int, column string")
    counted = places.join(spread_table(df, values, counts, mad_limit, fence), "column")
    return _outlier_share(counted.select("position", "column", "n", "mad_count", "iqr_count", "total_outliers"))


def _no_outliers(df: DataFrame) -> DataFrame:
    return small_table(
        df.sparkSession,
        [],
        "position int, column string, n bigint, mad_count bigint, iqr_count bigint, total_outliers bigint, "
        "outlier_pct double, outlier_severity string",
    )


def _outlier_share(counted: DataFrame) -> DataFrame:
    pct = F.coalesce(F.round(F.try_divide(F.col("total_outliers") * 100.0, F.col("n")), 2), F.lit(0.0))
    return counted.withColumn("outlier_pct", pct).withColumn(
        "outlier_severity", severity.outlier_severity(F.col("outlier_pct"))
    )


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = True,
    facts: Facts | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Every distribution statistic of each numeric column that has values, rounded to 4 decimals.

    ``exact=False`` takes quartiles and median deviations from sketches: two scans less per quantile. With ``by``, one row
    per segment and column.
    """
    if by:
        from .segments import numeric_profile_by

        return numeric_profile_by(df, by, columns)
    from .facts import Facts

    facts = facts or Facts(df, columns)
    found = [r for r in facts.moments if r["n"] > 0]
    if not found:
        return _no_profile(df)
    values = {r["column"]: facts.values[r["column"]] for r in found}
    counts = {r["column"]: r["n"] for r in found}
    rows = [
        (r["position"], r["column"], r["mean"], r["std"], r["variance"], r["low"], r["high"], r["kurtosis"]) for r in found
    ]
    table = small_table(
        df.sparkSession,
        rows,
        "position int, column string, mean double, std double, variance double, min double, max double, kurtosis double",
    )
    if exact:
        spreads = spread_table(df, values, counts)
    else:
        sketched = sketched_spread(df, values)
        rows = [(c, s["q25"], s["median"], s["q75"], s["mad"]) for c, s in sketched.items()]
        spreads = small_table(df.sparkSession, rows, "column string, q25 double, median double, q75 double, mad double")
        spreads = spreads.join(count_outliers(df, values, sketched).drop("position"), "column")
    flagged = _outlier_share(spreads).drop("n")
    tested = small_table(
        df.sparkSession,
        [tuple(r) for r in facts.normality],
        "column string, n bigint, test_used string, normality_statistic double, normality_p double, "
        "skewness double, is_normal boolean",
    )
    joined = table.join(tested, "column").join(flagged, "column")
    r4 = lambda c: F.round(c, 4)
    return joined.select(
        "position",
        "column",
        "n",
        *[r4(c).alias(c) for c in ("mean", "std", "variance", "min", "max", "q25", "median", "q75")],
        r4(F.col("q75") - F.col("q25")).alias("iqr"),
        r4("mad").alias("mad"),
        "skewness",
        r4("kurtosis").alias("kurtosis"),
        severity.skew_severity(F.col("skewness")).alias("skewness_severity"),
        "test_used",
        "normality_statistic",
        "normality_p",
        "is_normal",
        "mad_count",
        "iqr_count",
        "total_outliers",
        "outlier_pct",
        "outlier_severity",
    )


def _no_profile(df: DataFrame) -> DataFrame:
    doubles = "mean std variance min max q25 median q75 iqr mad skewness kurtosis".split()
    return small_table(
        df.sparkSession,
        [],
        "position int, column string, n bigint, "
        + ", ".join(f"{c} double" for c in doubles)
        + ", skewness_severity string, test_used string, normality_statistic double, normality_p double, "
        "is_normal boolean, mad_count bigint, iqr_count bigint, total_outliers bigint, outlier_pct double, "
        "outlier_severity string",
    )


def categorical_profile(
    df: DataFrame, top: int = 5, columns: Sequence[str] | None = None, by: Sequence[str] | None = None
) -> DataFrame:
    """``(position, column, nunique, unique_ratio, place, value, n, pct)``: the most frequent values.

    Ties go to the smallest value. The top-``top`` filter runs inside every task before the final shuffle. With ``by``,
    the most frequent values of every segment.
    """
    if by:
        from .segments import categorical_profile_by

        return categorical_profile_by(df, by, top, columns)
    names = list(columns) if columns is not None else other_columns(df)
    schema = (
        "position int, column string, nunique bigint, unique_ratio double, place int, value string, n bigint, pct double"
    )
    if not names:
        return small_table(df.sparkSession, [], schema)
    counts = value_counts(df, names)
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("nunique"), F.sum("n").alias("total"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    best = whole_texts(df, counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top))
    every = small_table(df.sparkSession, [(i, c) for i, c in enumerate(names)], "position int, column string")
    return (
        every.join(totals, "column", "left")
        .join(best, "column", "left")
        .select(
            "position",
            "column",
            F.coalesce("nunique", F.lit(0)).alias("nunique"),
            F.coalesce(F.round(F.col("nunique") / F.col("total"), 4), F.lit(0.0)).alias("unique_ratio"),
            "place",
            "value",
            "n",
            F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"),
        )
    )
