"""Inputs shared by the registered queries, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the labels that some of them have."""
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select("doc_id", "lang", "source", "n_chars", "quality", "toxic")
    )


DOCS_LABELS = (
    "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items where zero discount and zero tax count as not recorded, and flag N as unknown."""
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
        "l_linestatus",
    )


GAPPY_LINEITEM = (
    "SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax, "
    "nullif(l_returnflag, 'N') AS l_returnflag, l_linestatus FROM lineitem"
)


def priced_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with derived money columns that depend on each other."""
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
        "l_linestatus",
        "l_returnflag",
    )


PRICED_LINEITEM = (
    "SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS revenue, "
    "l_extendedprice / l_quantity AS unit_price, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, "
    "l_linestatus, l_returnflag FROM lineitem"
)


def steady(col: Column, digits: int = 4) -> Column:
    """Rounding that keeps about nine digits of large numbers, which differ in the last bits by sum order."""
    size = F.abs(col)
    return (
        F.when(size >= 1e9, F.round(col, -2))
        .when(size >= 1e6, F.round(col, 0))
        .when(size >= 1e4, F.round(col, min(digits, 2)))
        .otherwise(F.round(col, digits))
    )


def steady_sql(expr: str, digits: int = 4) -> str:
    return (
        f"CASE WHEN abs({expr}) >= 1e9 THEN round({expr}, -2) WHEN abs({expr}) >= 1e6 THEN round({expr}, 0) "
        f"WHEN abs({expr}) >= 1e4 THEN round({expr}, {min(digits, 2)}) ELSE round({expr}, {digits}) END"
    )


def union_all(parts: Sequence[str]) -> str:
    return " UNION ALL ".join(parts)


# --- tail probabilities in SQL, by Simpson's rule ----------------------------------------------------------
def _simpson(f: str, top: str, steps: int = 2000) -> str:
    """Integral of ``f`` (an expression of x) from 0 to ``top``."""
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    body = f.replace("{x}", f"(i * ({top}) / {steps}.0)")
    return f"(({top}) / {steps}.0 / 3.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i : {weight} * ({body}))))"


def normal_p_sql(z: str) -> str:
    top = f"least(abs({z}), 12.0)"
    return f"greatest(0.0, 1.0 - 2.0 / sqrt(2.0 * pi()) * {_simpson('exp(-{x} * {x} / 2.0)', top)})"


def student_p_sql(t: str, dof: str) -> str:
    top = f"least(abs({t}), 60.0)"
    density = f"pow(1.0 + {{x}} * {{x}} / ({dof}), -(({dof}) + 1.0) / 2.0)"
    scale = f"exp(lgamma((({dof}) + 1.0) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(({dof}) * pi())"
    return f"greatest(0.0, 1.0 - 2.0 * {scale} * {_simpson(density, top)})"


def chi_square_p_sql(x: str, dof: str) -> str:
    top = f"least(sqrt({x}), 60.0)"
    density = f"2.0 * (CASE WHEN ({dof}) = 1 THEN 1.0 ELSE pow({{x}}, ({dof}) - 1.0) END) * exp(-{{x}} * {{x}} / 2.0)"
    return f"greatest(0.0, 1.0 - {_simpson(density, top)} / exp(({dof}) / 2.0 * ln(2.0) + lgamma(({dof}) / 2.0)))"


# --- other statistics in SQL --------------------------------------------------------------------------------
def spearman_sql(source: str, a: str, b: str) -> str:
    """Subquery with one row (n_eff, r): rank correlation over the rows where both columns are present."""
    ranked = (
        f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
        f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
        f"FROM ({source}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    )
    return f"SELECT count(*) AS n_eff, corr(ra, rb) AS r FROM ({ranked})"


def adjusted_sql(tests: str, order: str = "position") -> str:
    """Benjamini-Hochberg over a subquery with raw_p and ``order``; adds p_adj."""
    return (
        f"SELECT *, round(least(1.0, min(q) OVER (ORDER BY raw_p DESC, {order} DESC "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS p_adj FROM "
        f"(SELECT *, raw_p * count(*) OVER () / row_number() OVER (ORDER BY raw_p, {order}) AS q FROM ({tests}))"
    )


def omnibus_sql(n: str, g1: str, g2: str) -> str:
    """K squared of the D'Agostino-Pearson test from n and the biased skewness and excess kurtosis."""
    y = f"(({g1}) * sqrt((({n}) + 1.0) * (({n}) + 3.0) / (6.0 * (({n}) - 2.0))))"
    b2 = f"(3.0 * (({n}) * ({n}) + 27.0 * ({n}) - 70.0) * (({n}) + 1.0) * (({n}) + 3.0) / ((({n}) - 2.0) * (({n}) + 5.0) * (({n}) + 7.0) * (({n}) + 9.0)))"
    w2 = f"(sqrt(2.0 * ({b2} - 1.0)) - 1.0)"
    z1 = f"(asinh((CASE WHEN {y} = 0 THEN 1.0 ELSE {y} END) / sqrt(2.0 / ({w2} - 1.0))) / sqrt(0.5 * ln({w2})))"
    mean = f"(3.0 * (({n}) - 1.0) / (({n}) + 1.0))"
    var = f"(24.0 * ({n}) * (({n}) - 2.0) * (({n}) - 3.0) / (pow(({n}) + 1.0, 2) * (({n}) + 3.0) * (({n}) + 5.0)))"
    x = f"((({g2}) + 3.0 - {mean}) / sqrt({var}))"
    rb = f"(6.0 * (({n}) * ({n}) - 5.0 * ({n}) + 2.0) / ((({n}) + 7.0) * (({n}) + 9.0)) * sqrt(6.0 * (({n}) + 3.0) * (({n}) + 5.0) / (({n}) * (({n}) - 2.0) * (({n}) - 3.0))))"
    a = f"(6.0 + 8.0 / {rb} * (2.0 / {rb} + sqrt(1.0 + 4.0 / pow({rb}, 2))))"
    d = f"(1.0 + {x} * sqrt(2.0 / ({a} - 4.0)))"
    z2 = f"((1.0 - 2.0 / (9.0 * {a}) - sign({d}) * cbrt((1.0 - 2.0 / {a}) / abs({d}))) / sqrt(2.0 / (9.0 * {a})))"
    return f"(pow({z1}, 2) + pow({z2}, 2))"


def _scores_sql(source: str) -> str:
    """From (label, x) to (label, x, i, n, m): rank, number of values and normal score.

    The normal scores start from a rational approximation and take two Newton steps on the integrated density.
    """
    dens = "exp(-{z} * {z} / 2.0) / sqrt(2.0 * pi())"

    def newton(z: str) -> str:
        below = f"(0.5 + {_simpson('exp(-{x} * {x} / 2.0)', z, 200)} / sqrt(2.0 * pi()))"
        return f"{z} - ({below} - q) / ({dens.replace('{z}', z)})"

    t = "sqrt(-2.0 * ln(1.0 - q))"
    start = (
        f"{t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / "
        f"(1.0 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t})"
    )
    placed = (
        "SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY x) AS i, count(*) OVER (PARTITION BY label) AS n "
        f"FROM ({source}) WHERE x IS NOT NULL"
    )
    # scores are found for the upper half and mirrored
    upper = f"SELECT *, greatest((i - 0.375) / (n + 0.25), 1.0 - (i - 0.375) / (n + 0.25)) AS q FROM ({placed})"
    zero = f"SELECT *, {start} AS z0 FROM ({upper})"
    one = f"SELECT *, {newton('z0')} AS z1 FROM ({zero})"
    return f"SELECT *, (CASE WHEN i - 0.375 < (n + 0.25) / 2.0 THEN -1.0 ELSE 1.0 END) * ({newton('z1')}) AS m FROM ({one})"


def francia_sql(source: str) -> str:
    """From (label, x) to (label, n, skew, w, p) by the Shapiro-Francia test."""
    stat = (
        "SELECT label, count(*) AS n, skewness(x) AS skew, pow(sum(m * x), 2) / (sum(m * m) * var_pop(x) * count(*)) AS w "
        f"FROM ({_scores_sql(source)}) GROUP BY label"
    )
    mean, sd = "(-1.2725 + 1.0521 * (ln(ln(n)) - ln(n)))", "(1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n)))"
    half = normal_p_sql("z") + " / 2.0"
    return (
        f"SELECT label, n, skew, w, CASE WHEN z > 0 THEN {half} ELSE 1.0 - {half} END AS p "
        f"FROM (SELECT *, (ln(1.0 - w) - {mean}) / {sd} AS z FROM ({stat}))"
    )


def shapiro_sql(source: str) -> str:
    """From (label, x) to (label, n, skew, w, p) for samples of 12 to 5000 values."""
    two = _scores_sql(source)
    sums = (
        "SELECT *, sum(m * m) OVER w AS ss, max(m) OVER w AS top, max(m) FILTER (WHERE i = n - 1) OVER w AS nxt, "
        f"1.0 / sqrt(n) AS u FROM ({two}) WINDOW w AS (PARTITION BY label)"
    )

    def poly(x: str, *c: float) -> str:
        return "(" + " + ".join(f"{k!r} * pow({x}, {i})" for i, k in enumerate(c)) + ")"

    last = f"(top / sqrt(ss) + {poly('u', 0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)})"
    second = f"(nxt / sqrt(ss) + {poly('u', 0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)})"
    scale = f"((ss - 2 * top * top - 2 * nxt * nxt) / (1 - 2 * {last} * {last} - 2 * {second} * {second}))"
    weight = (
        f"(CASE WHEN i = n THEN {last} WHEN i = 1 THEN -{last} WHEN i = n - 1 THEN {second} WHEN i = 2 THEN -{second} "
        f"ELSE m / sqrt({scale}) END)"
    )
    stat = (
        f"SELECT label, count(*) AS n, skewness(x) AS skew, pow(sum({weight} * x), 2) / (var_pop(x) * count(*)) AS w "
        f"FROM ({sums}) GROUP BY label"
    )
    mean = poly("ln(n)", -1.5861, -0.31082, -0.083751, 0.0038915)
    sd = f"exp({poly('ln(n)', -0.4803, -0.082676, 0.0030302)})"
    half = normal_p_sql("z") + " / 2.0"
    return (
        f"SELECT label, n, skew, w, CASE WHEN z > 0 THEN {half} ELSE 1.0 - {half} END AS p "
        f"FROM (SELECT *, (ln(1.0 - w) - {mean}) / {sd} AS z FROM ({stat}))"
    )
