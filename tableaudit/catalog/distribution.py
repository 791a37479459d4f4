"""Moments, quantiles, outliers, normality and categorical summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import FRANCIA, SHAPIRO
from ..operators.distribution import categorical_profile, moments, normality, numeric_profile, numeric_values, outliers
from .common import (
    GAPPY_LINEITEM,
    francia_sql,
    gappy_lineitem,
    omnibus_sql,
    shapiro_sql,
    steady,
    steady_sql,
    table,
    union_all,
)

_PROFILE = ["mean", "std", "variance", "min", "max", "q25", "median", "q75", "iqr", "mad", "skewness", "kurtosis"]


def _profile(df):
    out = numeric_profile(df)
    big = [c for c in _PROFILE if c not in ("skewness", "kurtosis")]
    return out.select(
        "column",
        "n",
        *[steady(F.col(c)).alias(c) for c in big],
        "skewness",
        "kurtosis",
        "skewness_severity",
        "test_used",
        F.round("normality_statistic", 1).alias("normality_statistic"),
        "normality_p",
        "is_normal",
        "mad_count",
        "iqr_count",
        "total_outliers",
        "outlier_pct",
        "outlier_severity",
    )


def profile_sql(source: str, columns: list[str]) -> str:
    """The whole profile of columns with more than 5000 values."""
    parts = []
    for c in columns:
        v = f"SELECT CAST({c} AS DOUBLE) AS v FROM ({source}) WHERE {c} IS NOT NULL"
        base = (
            "SELECT count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, var_samp(v) AS variance, min(v) AS mn, max(v) AS mx, "
            "quantile_cont(v, 0.25) AS q25, median(v) AS med, quantile_cont(v, 0.75) AS q75, skewness(v) AS skew, "
            f"kurtosis(v) AS kurt FROM ({v})"
        )
        out = "(v < b.q25 - 1.5 * (b.q75 - b.q25) OR v > b.q75 + 1.5 * (b.q75 - b.q25))"
        far = "(s.mad > 0 AND 0.6745 * abs(v - b.med) / s.mad > 3.5)"
        g1 = "(skew * (n - 2) / sqrt(n * (n - 1.0)))"
        g2 = "((kurt * (n - 2.0) * (n - 3.0) / (n - 1.0) - 6.0) / (n + 1.0))"
        pct = "round(both_count * 100.0 / n, 2)"
        st = steady_sql
        parts.append(
            f"SELECT '{c}' AS \"column\", n, {st('mean')} AS mean, {st('std')} AS std, {st('variance')} AS variance, "
            f"{st('mn')} AS min, {st('mx')} AS max, {st('q25')} AS q25, {st('med')} AS median, {st('q75')} AS q75, "
            f"{st('(q75 - q25)')} AS iqr, {st('mad')} AS mad, round(skew, 4) AS skewness, round(kurt, 4) AS kurtosis, "
            "CASE WHEN abs(round(skew, 4)) > 1 THEN 'strongly_skewed' WHEN abs(round(skew, 4)) > 0.5 THEN 'moderately_skewed' ELSE 'symmetric' END AS skewness_severity, "
            f"'D''Agostino K^2' AS test_used, round(k2, 1) AS normality_statistic, round(exp(-k2 / 2), 4) AS normality_p, "
            "exp(-k2 / 2) > 0.05 AND abs(round(skew, 4)) < 0.5 AS is_normal, far_count AS mad_count, out_count AS iqr_count, "
            f"both_count AS total_outliers, {pct} AS outlier_pct, "
            f"CASE WHEN {pct} >= 10 THEN 'critical' WHEN {pct} >= 5 THEN 'high' WHEN {pct} >= 1 THEN 'moderate' ELSE 'low' END AS outlier_severity "
            f"FROM (SELECT b.*, s.mad, {omnibus_sql('n', g1, g2)} AS k2, "
            f"(SELECT count(*) FROM ({v}) WHERE {far}) AS far_count, (SELECT count(*) FROM ({v}) WHERE {out}) AS out_count, "
            f"(SELECT count(*) FROM ({v}) WHERE {far} OR {out}) AS both_count "
            f"FROM ({base}) b, (SELECT mad(v) AS mad FROM ({v})) s)"
        )
    return union_all(parts)


_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def lineitem_profile(spark, sf_dir):
    return _profile(table(spark, sf_dir, "lineitem"))


def events_profile(spark, sf_dir):
    return _profile(table(spark, sf_dir, "events").select("value", "user_id", F.length("props").alias("props_length")))


def lineitem_moments(spark, sf_dir):
    """Moments of columns with gaps."""
    df = gappy_lineitem(spark, sf_dir)
    found = moments(df, numeric_values(df))
    return found.select(
        "column", "n", *[steady(F.col(c), 6).alias(c) for c in ("mean", "std", "variance", "low", "high", "skewness", "kurtosis")]
    )


def _moments_sql() -> str:
    return union_all(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS n, {steady_sql(f'avg({c})', 6)} AS mean, {steady_sql(f'stddev_samp({c})', 6)} AS std, "
            f"{steady_sql(f'var_samp({c})', 6)} AS variance, {steady_sql(f'min({c})', 6)} AS low, {steady_sql(f'max({c})', 6)} AS high, "
            f"round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM ({GAPPY_LINEITEM})"
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ]
    )


def event_outliers(spark, sf_dir):
    return outliers(table(spark, sf_dir, "events"), ["value"])


def _outliers_sql() -> str:
    full = profile_sql("events", ["value"])
    return f"SELECT 0 AS position, \"column\", n, mad_count, iqr_count, total_outliers, outlier_pct, outlier_severity FROM ({full})"


def event_normality(spark, sf_dir):
    """The omnibus test of event values as they are and after a logarithm and a cube root."""
    events = table(spark, sf_dir, "events")
    df = events.select(
        "value", F.log1p("value").alias("log_value"), F.cbrt("value").alias("cbrt_value")
    )
    return normality(df).select(
        "column", "n", "test_used", F.round("statistic", 2).alias("statistic"), "p_value", "skewness", "is_normal"
    )


def _normality_sql() -> str:
    parts = []
    for c, e in (("value", "value"), ("log_value", "ln(1 + value)"), ("cbrt_value", "cbrt(value)")):
        g1 = "(skew * (n - 2) / sqrt(n * (n - 1.0)))"
        g2 = "((kurt * (n - 2.0) * (n - 3.0) / (n - 1.0) - 6.0) / (n + 1.0))"
        parts.append(
            f"SELECT '{c}' AS \"column\", n, 'D''Agostino K^2' AS test_used, round(k2, 2) AS statistic, round(exp(-k2 / 2), 4) AS p_value, "
            f"round(skew, 4) AS skewness, exp(-k2 / 2) > 0.05 AND abs(skew) < 0.5 AS is_normal FROM (SELECT *, {omnibus_sql('n', g1, g2)} AS k2 FROM "
            f"(SELECT count(v) AS n, skewness(v) AS skew, kurtosis(v) AS kurt FROM (SELECT {e} AS v FROM events)))"
        )
    return union_all(parts)


def event_francia(spark, sf_dir):
    """The same columns, and their first 4000 rows, by one test whatever their size."""
    events = table(spark, sf_dir, "events")
    head = F.col("event_id") < 4000
    df = events.select(
        "value",
        F.cbrt("value").alias("cbrt_value"),
        F.when(head, F.col("value")).alias("head_value"),
        F.when(head, F.cbrt("value")).alias("head_cbrt"),
    )
    return normality(df, method="francia")


_FRANCIA = (
    "SELECT unnest(['value', 'cbrt_value', 'head_value', 'head_cbrt']) AS label, unnest([value, cbrt(value), "
    "CASE WHEN event_id < 4000 THEN value END, CASE WHEN event_id < 4000 THEN cbrt(value) END]) AS x FROM events"
)


def _francia_sql() -> str:
    return (
        f"SELECT label AS \"column\", n, '{FRANCIA}' AS test_used, round(w, 4) AS statistic, round(p, 4) AS p_value, "
        f"round(skew, 4) AS skewness, p > 0.05 AND abs(skew) < 0.5 AS is_normal FROM ({francia_sql(_FRANCIA)})"
    )


def embedding_omnibus(spark, sf_dir):
    """All embedding dimensions by the omnibus test, whatever their number of rows."""
    df = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(64)])
    found = normality(df, method="omnibus")
    return found.withColumn("statistic", F.round("statistic", 2))


def _omnibus_dims_sql() -> str:
    g1 = "(skew * (n - 2) / sqrt(n * (n - 1.0)))"
    g2 = "((kurt * (n - 2.0) * (n - 3.0) / (n - 1.0) - 6.0) / (n + 1.0))"
    source = "SELECT 'd' || unnest(range(64)) AS label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
    return (
        f"SELECT label AS \"column\", n, 'D''Agostino K^2' AS test_used, round(round(k2, 4), 2) AS statistic, round(exp(-k2 / 2), 4) AS p_value, "
        f"round(skew, 4) AS skewness, exp(-k2 / 2) > 0.05 AND abs(skew) < 0.5 AS is_normal FROM (SELECT *, {omnibus_sql('n', g1, g2)} AS k2 "
        f"FROM (SELECT label, count(x) AS n, skewness(x) AS skew, kurtosis(x) AS kurt FROM ({source}) GROUP BY label))"
    )


def embedding_normality(spark, sf_dir):
    """Normality of all embedding dimensions: Shapiro-Wilk for small tables."""
    df = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(64)])
    return normality(df)


def _embedding_sql() -> str:
    source = "SELECT 'd' || unnest(range(64)) AS label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
    return (
        f"SELECT label AS \"column\", n, '{SHAPIRO}' AS test_used, round(w, 4) AS statistic, round(p, 4) AS p_value, "
        f"round(skew, 4) AS skewness, p > 0.05 AND abs(skew) < 0.5 AS is_normal FROM ({shapiro_sql(source)})"
    )


def order_categories(spark, sf_dir):
    return categorical_profile(
        table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    )


def document_categories(spark, sf_dir):
    """Whole texts are counted and shown; ties go by the first 256 characters and a digest."""
    return categorical_profile(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def _categories_sql(source: str, columns: dict[str, str], top: int = 5) -> str:
    parts = []
    for i, (c, e) in enumerate(columns.items()):
        key = f"CASE WHEN length({e}) <= 256 THEN {e} ELSE substr({e}, 1, 256) || chr(0) || sha256({e}) END"
        counts = f"SELECT {key} AS k, min({e}) AS whole, count(*) AS n FROM {source} WHERE {e} IS NOT NULL GROUP BY 1"
        parts.append(
            f"(SELECT {i} AS position, '{c}' AS \"column\", t.nunique, round(t.nunique * 1.0 / t.total, 4) AS unique_ratio, "
            f"CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER) AS place, whole AS value, n, round(n * 100.0 / t.total, 2) AS pct "
            f"FROM ({counts}) c, (SELECT count(*) AS nunique, CAST(sum(n) AS BIGINT) AS total FROM ({counts})) t QUALIFY place <= {top})"
        )
    return union_all(parts)


QUERIES = {
    "lineitem_profile": (lineitem_profile, profile_sql("lineitem", _LINE_COLUMNS)),
    "events_profile": (
        events_profile,
        profile_sql("SELECT value, user_id, length(props) AS props_length FROM events", ["value", "user_id", "props_length"]),
    ),
    "lineitem_moments": (lineitem_moments, _moments_sql()),
    "event_outliers": (event_outliers, _outliers_sql()),
    "event_normality": (event_normality, _normality_sql()),
    "event_francia": (event_francia, _francia_sql()),
    "embedding_omnibus": (embedding_omnibus, _omnibus_dims_sql()),
    "embedding_normality": (embedding_normality, _embedding_sql()),
    "order_categories": (
        order_categories,
        _categories_sql(
            "orders",
            {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "day": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"},
        ),
    ),
    "document_categories": (
        document_categories,
        _categories_sql("documents", {"lang": "lang", "source": "source", "text": "text"}),
    ),
}
