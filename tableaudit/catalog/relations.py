"""Correlations, sign reversals, group and contingency tests, false-discovery control, insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.relations import (
    association_tests,
    bh_adjust,
    contingency_table,
    contingency_tests,
    correlations,
    group_tests,
    levene,
    pearson_matrix,
    rank_insights,
    redundant_pairs,
    simpsons,
    vif_scores,
)
from ..plans.pairs import all_pairs
from .common import (
    GAPPY_LINEITEM,
    PRICED_LINEITEM,
    adjusted_sql,
    chi_square_p_sql,
    gappy_lineitem,
    normal_p_sql,
    priced_lineitem,
    shapiro_sql,
    spearman_sql,
    steady,
    steady_sql,
    student_p_sql,
    table,
    union_all,
)

_GAPPY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PRICED = ["l_quantity", "l_extendedprice", "revenue", "unit_price", "charge"]


# --- Pearson ------------------------------------------------------------------------------------------------
def pearson_pairs(spark, sf_dir):
    found = pearson_matrix(gappy_lineitem(spark, sf_dir))
    rounded = [steady(F.col(c), 6).alias(c) for c in ("cov", "var1", "var2")]
    return found.select("pair", "col1", "col2", "n_eff", *rounded, F.round("r", 6).alias("r"))


def wide_pearson_pairs(spark, sf_dir):
    """All pairs of the 64 embedding dimensions, accumulated as matrix products."""
    df = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(64)])
    return pearson_matrix(df).select("pair", "col1", "col2", "n_eff", F.round("r", 6).alias("r"))


def _pearson_sql(source: str, columns: list[str]) -> str:
    return union_all(
        [
            f"SELECT {i} AS pair, '{a}' AS col1, '{b}' AS col2, regr_count({a}, {b}) AS n_eff, "
            f"{steady_sql(f'covar_pop({a}, {b})', 6)} AS cov, {steady_sql(f'var_pop({a}) FILTER ({b} IS NOT NULL)', 6)} AS var1, "
            f"{steady_sql(f'var_pop({b}) FILTER ({a} IS NOT NULL)', 6)} AS var2, round(corr({a}, {b}), 6) AS r FROM ({source})"
            for i, (a, b) in enumerate(all_pairs(columns))
        ]
    )


_WIDE_PEARSON = (
    "WITH e AS (SELECT row_number() OVER () AS k, embedding FROM embeddings), "
    "long AS (SELECT k, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM e) "
    "SELECT CAST(a.i * (127 - a.i) // 2 + b.i - a.i - 1 AS INTEGER) AS pair, 'd' || a.i AS col1, 'd' || b.i AS col2, "
    "regr_count(a.x, b.x) AS n_eff, round(corr(a.x, b.x), 6) AS r FROM long a JOIN long b ON a.k = b.k AND a.i < b.i GROUP BY a.i, b.i"
)


# --- correlation family --------------------------------------------------------------------------------------
def _family_sql(tests: str) -> str:
    """From (position, col1, col2, n_eff, r) with the method to the reported family."""
    p = student_p_sql("abs(r) * sqrt((n_eff - 2) / (1.0 - r * r))", "n_eff - 2")
    raw = f"CASE WHEN r IS NULL THEN 1.0 WHEN abs(r) >= 1 THEN 0.0 ELSE {p} END"
    adjusted = adjusted_sql(f"SELECT *, {raw} AS raw_p FROM ({tests})")
    return (
        "SELECT position, col1 || ' & ' || col2 AS pair, col1, col2, method, round(coalesce(r, 0.0), 4) AS corr, "
        "round(raw_p, 4) AS raw_p_value, n_eff, CASE WHEN abs(coalesce(r, 0)) >= 0.7 THEN 'strong' WHEN abs(coalesce(r, 0)) >= 0.3 "
        f"THEN 'moderate' ELSE 'weak' END AS strength, p_adj, p_adj < 0.05 AS is_significant FROM ({adjusted})"
    )


def _spearman_tests(source: str, columns: list[str]) -> str:
    return union_all(
        [
            f"SELECT {i} AS position, '{a}' AS col1, '{b}' AS col2, '{K.SPEARMAN}' AS method, n_eff, r FROM ({spearman_sql(source, a, b)})"
            for i, (a, b) in enumerate(all_pairs(columns))
        ]
    )


def _pearson_tests(source: str, columns: list[str]) -> str:
    return union_all(
        [
            f"SELECT {i} AS position, '{a}' AS col1, '{b}' AS col2, '{K.PEARSON}' AS method, regr_count({a}, {b}) AS n_eff, corr({a}, {b}) AS r FROM ({source})"
            for i, (a, b) in enumerate(all_pairs(columns))
        ]
    )


def gappy_correlations(spark, sf_dir):
    """Rank correlations of columns that are missing on different rows."""
    return correlations(gappy_lineitem(spark, sf_dir))


def priced_correlations(spark, sf_dir):
    """Rank correlations of complete, strongly dependent columns."""
    return correlations(priced_lineitem(spark, sf_dir))


def pearson_family(spark, sf_dir):
    return correlations(gappy_lineitem(spark, sf_dir), method="pearson")


def redundant(spark, sf_dir):
    return redundant_pairs(priced_lineitem(spark, sf_dir))


def vif(spark, sf_dir):
    return vif_scores(priced_lineitem(spark, sf_dir)).select("column", F.round("max_r2", 6).alias("max_r2"), "vif")


def _vif_sql() -> str:
    ends = union_all(
        [f"SELECT col1 AS c, r FROM ({{p}})", f"SELECT col2, r FROM ({{p}})"]
    ).replace("{p}", _pearson_tests(PRICED_LINEITEM, _PRICED))
    return (
        'SELECT c AS "column", round(max(r * r), 6) AS max_r2, round(CASE WHEN max(r * r) < 0.9999 THEN 1 / (1 - max(r * r)) '
        f"ELSE 999.0 END, 2) AS vif FROM ({ends}) GROUP BY c"
    )


# --- sign reversals -------------------------------------------------------------------------------------------
def _reversing(spark, sf_dir):
    """Line items with a price level per status, so that a falling trend inside rises overall."""
    shift = F.when(F.col("l_linestatus") == "O", 100.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") + shift).alias("level"),
        (F.lit(60.0) - F.col("l_quantity") + shift * 2 + F.col("l_discount") * 100).alias("rate"),
        "l_tax",
        "l_linestatus",
        "l_returnflag",
    )


_REVERSING = (
    "SELECT l_quantity + s AS level, 60.0 - l_quantity + s * 2 + l_discount * 100 AS rate, l_tax, l_linestatus, l_returnflag "
    "FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 100.0::DOUBLE ELSE 0.0 END AS s FROM lineitem)"
)


def sign_reversals(spark, sf_dir):
    return simpsons(_reversing(spark, sf_dir))


def weak_reversals(spark, sf_dir):
    """With open thresholds every sign change counts, and no limit on findings."""
    return simpsons(gappy_lineitem(spark, sf_dir), limit=None, min_r=0.0, min_group_r=0.0)


def _simpson_sql(source: str, columns: list[str], groups: list[str], limit: int | None, min_r: float, min_group_r: float) -> str:
    parts = []
    for i, (a, b) in enumerate(all_pairs(columns)):
        for j, z in enumerate(groups):
            parts.append(
                f"SELECT {i} AS p, {j} AS z, '{a}' AS feature_x, '{b}' AS feature_y, '{z}' AS group_var, o.r AS overall, "
                f"g.category, g.r AS inner_r, g.n_eff FROM (SELECT corr({a}, {b}) AS r, regr_count({a}, {b}) AS n FROM ({source})) o, "
                f"(SELECT CAST({z} AS VARCHAR) AS category, corr({a}, {b}) AS r, regr_count({a}, {b}) AS n_eff FROM ({source}) WHERE {z} IS NOT NULL GROUP BY {z}) g "
                f"WHERE o.n >= 15 AND abs(o.r) >= {min_r} AND g.n_eff >= 6 AND abs(g.r) > {min_group_r} AND sign(g.r) <> sign(o.r) "
                f"AND (SELECT count(DISTINCT {z}) FROM ({source})) BETWEEN 2 AND 5"
            )
    where = f"WHERE finding <= {limit}" if limit else ""
    return (
        "SELECT CAST(finding AS INTEGER) AS finding, feature_x, feature_y, group_var, round(overall, 4) AS overall_corr, category, "
        f"round(inner_r, 4) AS subgroup_corr, n_eff FROM (SELECT *, dense_rank() OVER (ORDER BY p, z) AS finding FROM ({union_all(parts)})) {where}"
    )


# --- two-group tests ------------------------------------------------------------------------------------------
def _mann_whitney_sql(source: str, num: str, cat: str, position: int) -> str:
    """One row (position, num, cat, v1, v2, u, z, d, n_eff); group 1 is the smaller value."""
    pairs = f"SELECT {num} AS x, CAST({cat} AS VARCHAR) AS g FROM ({source}) WHERE {num} IS NOT NULL AND {cat} IS NOT NULL"
    ranked = (
        "SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r, "
        f"min(g) OVER () AS v1, max(g) OVER () AS v2 FROM ({pairs})"
    )
    ties = f"SELECT sum(k * k * k - k) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM ({pairs}) GROUP BY x)"
    sums = (
        "SELECT min(v1) AS v1, max(v2) AS v2, count(*) FILTER (WHERE g = v1) AS n1, count(*) FILTER (WHERE g = v2) AS n2, "
        "sum(r) FILTER (WHERE g = v1) AS r1, avg(x) FILTER (WHERE g = v1) AS m1, avg(x) FILTER (WHERE g = v2) AS m2, "
        f"var_samp(x) FILTER (WHERE g = v1) AS s1, var_samp(x) FILTER (WHERE g = v2) AS s2 FROM ({ranked})"
    )
    u = "(r1 - n1 * (n1 + 1.0) / 2.0)"
    var = "(n1 * 1.0 * n2 / 12.0 * (n1 + n2 + 1.0 - t / ((n1 + n2) * (n1 + n2 - 1.0))))"
    return (
        f"SELECT {position} AS position, '{num}' AS num_col, '{cat}' AS cat_col, v1, v2, {u} AS u, "
        f"(greatest({u}, n1 * 1.0 * n2 - {u}) - n1 * 1.0 * n2 / 2.0 - 0.5) / sqrt({var}) AS z, "
        "(m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)) AS d, n1 + n2 AS n_eff "
        f"FROM ({sums}), ({ties})"
    )


_VARIABLES = "'''' || num_col || ''' by ''' || cat_col || ''' (' || v1 || ' vs ' || v2 || ')'"


def _ranked_p(tests: str) -> str:
    return f"SELECT *, least(1.0, {normal_p_sql('greatest(z, 0.0)')}) AS raw_p FROM ({tests})"


def _group_family(tests: str) -> str:
    return (
        f"SELECT position, '{K.MANN_WHITNEY}' AS test_name, {_VARIABLES} AS variables, num_col, cat_col, "
        "round(u, 4) AS statistic, round(raw_p, 4) AS raw_p_value, round(d, 4) AS effect_size, 'Cohen''s d' AS effect_size_type, "
        f"n_eff, p_adj, p_adj < 0.05 AS is_significant FROM ({adjusted_sql(_ranked_p(tests))})"
    )


def status_group_tests(spark, sf_dir):
    """Every numeric column of the reversing table by line status: large effects."""
    return group_tests(_reversing(spark, sf_dir))


def all_group_tests(spark, sf_dir):
    """Columns with gaps by both two-valued flags, the whole family."""
    return group_tests(gappy_lineitem(spark, sf_dir), limit=None)


_ALL_TESTS = [
    _mann_whitney_sql(GAPPY_LINEITEM, num, cat, i * 4 + j)
    for i, cat in enumerate(("l_returnflag", "l_linestatus"))
    for j, num in enumerate(_GAPPY)
]
_STATUS_GROUPS = union_all(
    [_mann_whitney_sql(_REVERSING, num, "l_linestatus", j) for j, num in enumerate(("level", "rate", "l_tax"))]
)


def embedding_group_tests(spark, sf_dir):
    """All 64 embedding dimensions by lower and upper labels: t tests where both groups are normal."""
    df = table(spark, sf_dir, "embeddings").select(
        F.when(F.col("label") < 5, "lower").otherwise("upper").alias("half"),
        *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(64)],
    )
    return group_tests(df, limit=None)


def _embedding_tests_sql() -> str:
    """Normality of both groups, then Levene's test, then a t test; Mann-Whitney if a group is not normal."""
    values = (
        "SELECT i, half, x FROM (SELECT CASE WHEN label < 5 THEN 'lower' ELSE 'upper' END AS half, unnest(range(64)) AS i, "
        "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
    )
    away = f"SELECT *, abs(x - median(x) OVER (PARTITION BY i, half)) AS z FROM ({values})"
    groups = (
        "SELECT i, half, count(*) AS n, avg(x) AS m, var_samp(x) AS v, avg(z) AS zm, var_samp(z) AS zv "
        f"FROM ({away}) GROUP BY i, half"
    )
    pairs = (
        "SELECT a.i, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS s1, b.v AS s2, (a.n + b.n - 2) * (a.n * a.zm * a.zm + "
        "b.n * b.zm * b.zm - pow(a.n * a.zm + b.n * b.zm, 2) / (a.n + b.n)) / ((a.n - 1) * a.zv + (b.n - 1) * b.zv) AS f "
        f"FROM ({groups}) a JOIN ({groups}) b ON a.i = b.i AND a.half = 'lower' AND b.half = 'upper'"
    )
    ranked = f"SELECT *, rank() OVER (PARTITION BY i ORDER BY x) + (count(*) OVER (PARTITION BY i, x) - 1) / 2.0 AS r FROM ({values})"
    sums = f"SELECT i, sum(r) FILTER (WHERE half = 'lower') AS r1 FROM ({ranked}) GROUP BY i"
    ties = f"SELECT i, sum(k * k * k - k) AS ties FROM (SELECT i, CAST(count(*) AS DOUBLE) AS k FROM ({values}) GROUP BY i, x) GROUP BY i"
    tested = shapiro_sql(f"SELECT i || ':' || half AS label, x FROM ({values})")
    normal = (
        "SELECT CAST(split_part(label, ':', 1) AS BIGINT) AS i, bool_and(p > 0.05 AND abs(skew) < 0.5) AS normal "
        f"FROM ({tested}) GROUP BY 1"
    )
    u = "(r1 - n1 * (n1 + 1.0) / 2.0)"
    var = "(n1 * 1.0 * n2 / 12.0 * (n1 + n2 + 1.0 - ties / ((n1 + n2) * (n1 + n2 - 1.0))))"
    parts = [
        f"SELECT CAST(i AS INTEGER) AS position, 'd' || i AS num_col, 'half' AS cat_col, 'lower' AS v1, 'upper' AS v2, {u} AS u, "
        f"(greatest({u}, n1 * 1.0 * n2 - {u}) - n1 * 1.0 * n2 / 2.0 - 0.5) / sqrt({var}) AS z, "
        "(m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)) AS d, n1 + n2 AS n_eff, normal, "
        f"{student_p_sql('sqrt(f)', 'n1 + n2 - 2.0')} > 0.05 AS equal_var, n1, n2, m1, m2, s1, s2 "
        f"FROM ({pairs}) JOIN ({sums}) USING (i) JOIN ({ties}) USING (i) JOIN ({normal}) USING (i)"
    ]
    pooled = "(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2.0))"
    staged = (
        f"SELECT *, CASE WHEN equal_var THEN (m1 - m2) / sqrt({pooled} * (1.0 / n1 + 1.0 / n2)) "
        "ELSE (m1 - m2) / sqrt(s1 / n1 + s2 / n2) END AS t, CASE WHEN equal_var THEN n1 + n2 - 2.0 ELSE "
        "pow(s1 / n1 + s2 / n2, 2) / (pow(s1 / n1, 2) / (n1 - 1) + pow(s2 / n2, 2) / (n2 - 1)) END AS dof "
        f"FROM ({union_all(parts)})"
    )
    raw = (
        f"SELECT *, CASE WHEN normal THEN {student_p_sql('t', 'dof')} ELSE least(1.0, {normal_p_sql('greatest(z, 0.0)')}) END "
        f"AS raw_p FROM ({staged})"
    )
    welch = K.WELCH_T.replace("'", "''")
    return (
        f"SELECT position, CASE WHEN NOT normal THEN '{K.MANN_WHITNEY}' WHEN equal_var THEN '{K.STUDENT_T}' ELSE '{welch}' END "
        f"AS test_name, {_VARIABLES} AS variables, num_col, cat_col, round(CASE WHEN normal THEN t ELSE u END, 4) AS statistic, "
        "round(raw_p, 4) AS raw_p_value, round(d, 4) AS effect_size, 'Cohen''s d' AS effect_size_type, n_eff, p_adj, "
        f"p_adj < 0.05 AS is_significant FROM ({adjusted_sql(raw)})"
    )


def levene_statistics(spark, sf_dir):
    """Spread of event values by kind of event, against errors."""
    events = table(spark, sf_dir, "events")
    side = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    found = levene(events, {k: (side("error"), side(k)) for k in ("click", "purchase", "signup", "view")})
    return found.select("test", F.round("statistic", 4).alias("statistic"), F.round("p_value", 4).alias("p_value"))


def _levene_sql() -> str:
    parts = []
    for k in ("click", "purchase", "signup", "view"):
        away = (
            "SELECT event_type AS g, abs(value - median(value) OVER (PARTITION BY event_type)) AS z FROM events "
            f"WHERE event_type IN ('error', '{k}')"
        )
        groups = f"SELECT g, count(*) AS n, avg(z) AS m, var_samp(z) AS s FROM ({away}) GROUP BY g"
        f_stat = (
            "(sum(n) - 2) * (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / sum((n - 1) * s)"
        )
        parts.append(f"SELECT '{k}' AS test, {f_stat} AS f, sum(n) - 2.0 AS dof FROM ({groups})")
    return f"SELECT test, round(f, 4) AS statistic, round({student_p_sql('sqrt(f)', 'dof')}, 4) AS p_value FROM ({union_all(parts)})"


# --- contingency ------------------------------------------------------------------------------------------------
def flag_crosstab(spark, sf_dir):
    return contingency_table(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


def _order_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderstatus",
        "o_orderpriority",
        F.when(F.col("o_totalprice") > 250000, "large").otherwise("small").alias("size_class"),
        F.when(F.col("o_totalprice") * F.length("o_orderpriority") > 2500000, "heavy").otherwise("light").alias("weight_class"),
        F.when(F.col("o_totalprice") > 499900, "top").otherwise("rest").alias("tier"),
        F.when(F.col("o_totalprice") < 1100, "tiny").otherwise("rest").alias("floor_tier"),
    )


_ORDER_FLAGS = (
    "SELECT o_orderstatus, o_orderpriority, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS size_class, "
    "CASE WHEN o_totalprice * length(o_orderpriority) > 2500000 THEN 'heavy' ELSE 'light' END AS weight_class, "
    "CASE WHEN o_totalprice > 499900 THEN 'top' ELSE 'rest' END AS tier, "
    "CASE WHEN o_totalprice < 1100 THEN 'tiny' ELSE 'rest' END AS floor_tier FROM orders"
)
_FLAGS = ["o_orderstatus", "o_orderpriority", "size_class", "weight_class", "tier", "floor_tier"]


def order_associations(spark, sf_dir):
    """Chi-square and, for sparse 2x2 tables, Fisher tests of all pairs of order classes."""
    return contingency_tests(_order_flags(spark, sf_dir), limit=None)


def _raw_contingency(source: str, columns: list[str]) -> str:
    parts = []
    for i, (x, y) in enumerate(all_pairs(columns)):
        cells = f"SELECT CAST({x} AS VARCHAR) AS a, CAST({y} AS VARCHAR) AS b, count(*) AS o FROM ({source}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL"
        full = (
            f"SELECT ra.a, cb.b, coalesce(c.o, 0) AS o, ra.n * cb.n * 1.0 / t.n AS e, ra.n AS rn, cb.n AS cn, t.n AS n, "
            "min(ra.a) OVER () AS a1, min(cb.b) OVER () AS b1 FROM "
            f"(SELECT a, CAST(sum(o) AS DOUBLE) AS n FROM ({cells}) GROUP BY a) ra CROSS JOIN (SELECT b, CAST(sum(o) AS DOUBLE) AS n FROM ({cells}) GROUP BY b) cb "
            f"CROSS JOIN (SELECT CAST(sum(o) AS DOUBLE) AS n FROM ({cells})) t LEFT JOIN ({cells}) c ON c.a = ra.a AND c.b = cb.b"
        )
        stats = (
            "SELECT count(DISTINCT a) AS r, count(DISTINCT b) AS k, max(n) AS n, min(e) AS min_e, avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) AS small, "
            "sum(pow(o - e, 2) / e) AS plain, sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS yates, "
            "sum(o) FILTER (WHERE a = a1 AND b = b1) AS c11, sum(o) FILTER (WHERE a = a1 AND b <> b1) AS c12, "
            f"sum(o) FILTER (WHERE a <> a1 AND b = b1) AS c21, sum(o) FILTER (WHERE a <> a1 AND b <> b1) AS c22 FROM ({full})"
        )
        parts.append(f"SELECT {i} AS pair, '{x}' AS col1, '{y}' AS col2, * FROM ({stats})")
    lg = "(lgamma(c11 + c12 + 1) + lgamma(n - c11 - c12 + 1) + lgamma(c11 + c21 + 1) + lgamma(n - c11 - c21 + 1) - lgamma(n + 1))"
    prob = (
        f"exp({lg} - lgamma(j + 1) - lgamma(c11 + c12 - j + 1) - lgamma(c11 + c21 - j + 1) - lgamma(n - c11 - c12 - c11 - c21 + j + 1))"
    )
    observed = prob.replace("lgamma(j + 1)", "lgamma(c11 + 1)").replace("- j + 1", "- c11 + 1").replace("+ j + 1", "+ c11 + 1")
    spread = (
        "range(CAST(greatest(0, c11 + c12 + c11 + c21 - n) AS BIGINT), CAST(least(c11 + c12, c11 + c21) AS BIGINT) + 1)"
    )
    fisher = f"least(1.0, list_sum(list_transform({spread}, lambda j : CASE WHEN {prob} <= {observed} * (1 + 1e-7) THEN {prob} ELSE 0.0 END)))"
    ok = "(min_e >= 1 AND small <= 0.2)"
    exact = f"(r = 2 AND k = 2 AND NOT {ok})"
    chi = "(CASE WHEN r = 2 AND k = 2 THEN yates ELSE plain END)"
    odds = "(CASE WHEN c12 * c21 <> 0 THEN c11 * c22 * 1.0 / (c12 * c21) ELSE 'inf'::DOUBLE END)"
    return (
        f"SELECT CAST(row_number() OVER (ORDER BY pair) - 1 AS INTEGER) AS position, *, {chi} AS chi2, {exact} AS exact, {ok} AS ok, {odds} AS odds, "
        f"CASE WHEN {exact} THEN {fisher} ELSE {chi_square_p_sql(chi, '((r - 1) * (k - 1))')} END AS raw_p "
        f"FROM ({union_all(parts)}) WHERE r > 1 AND k > 1"
    )


def _contingency_sql(source: str, columns: list[str]) -> str:
    raw = _raw_contingency(source, columns)
    return (
        f"SELECT position, CASE WHEN exact THEN '{K.FISHER.replace(chr(39), chr(39) * 2)}' WHEN ok THEN '{K.CHI_SQUARE}' ELSE '{K.CHI_SQUARE_WARNING}' END AS test_name, "
        "'Categorical: ''' || col1 || ''' & ''' || col2 || '''' AS variables, col1, col2, "
        f"round(CASE WHEN exact THEN odds ELSE chi2 END, 4) AS statistic, round(raw_p, 4) AS raw_p_value, "
        "round(sqrt(chi2 / n / (least(r, k) - 1)), 4) AS effect_size, 'Cramer''s V' AS effect_size_type, CAST(n AS BIGINT) AS n_eff, "
        f"p_adj, p_adj < 0.05 AS is_significant FROM ({adjusted_sql(raw)})"
    )


def _line_associations_sql() -> str:
    """All group tests, then the one pair of flags, adjusted together."""
    tests = _ranked_p(union_all(_ALL_TESTS))
    flags = _raw_contingency(GAPPY_LINEITEM, ["l_returnflag", "l_linestatus"])
    both = (
        f"SELECT position, '{K.MANN_WHITNEY}' AS test_name, {_VARIABLES} AS variables, round(u, 4) AS statistic, raw_p, d AS effect, "
        f"'Cohen''s d' AS effect_size_type, n_eff FROM ({tests}) UNION ALL "
        f"SELECT {len(_ALL_TESTS)}, CASE WHEN ok THEN '{K.CHI_SQUARE}' ELSE '{K.CHI_SQUARE_WARNING}' END, "
        "'Categorical: ''' || col1 || ''' & ''' || col2 || '''', round(CASE WHEN exact THEN odds ELSE chi2 END, 4), raw_p, "
        f"sqrt(chi2 / n / (least(r, k) - 1)), 'Cramer''s V', CAST(n AS BIGINT) FROM ({flags})"
    )
    return (
        "SELECT position, test_name, variables, statistic, round(raw_p, 4) AS raw_p_value, round(effect, 4) AS effect_size, "
        f"effect_size_type, n_eff, p_adj, p_adj < 0.05 AS is_significant FROM ({adjusted_sql(both)})"
    )


def line_associations(spark, sf_dir):
    """Group tests and contingency tests of the same table as one adjusted family."""
    return association_tests(gappy_lineitem(spark, sf_dir))


# --- false-discovery control and ranking ---------------------------------------------------------------------------
def line_p_values(spark, sf_dir):
    """One p value per line item, how unusual its price is, adjusted within each return flag."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        F.exp(-F.col("l_extendedprice") / 10000.0).alias("p"),
    )
    return bh_adjust(lines, "p", "l_returnflag").drop("p")


_LINE_P = (
    "SELECT l_returnflag, l_orderkey, l_linenumber, family_size_m, p_adj, p_adj < 0.05 AS is_significant FROM ("
    "SELECT *, round(least(1.0, min(q) OVER (PARTITION BY l_returnflag ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS p_adj FROM ("
    "SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS family_size_m, p * count(*) OVER (PARTITION BY l_returnflag) / "
    "(count(*) OVER (PARTITION BY l_returnflag ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM "
    "(SELECT l_orderkey, l_linenumber, l_returnflag, exp(-l_extendedprice / 10000.0) AS p FROM lineitem)))"
)


def insights(spark, sf_dir):
    """The strongest findings of the reversing table."""
    df = _reversing(spark, sf_dir)
    return rank_insights(group_tests(df), correlations(df))


def _insight_sql() -> str:
    pairs = _family_sql(_spearman_tests(_REVERSING, ["level", "rate", "l_tax"]))
    tests = _group_family(_STATUS_GROUPS)
    both = (
        "SELECT 0 AS kind, position, 'Group Difference Test' AS type, test_name || ' on ' || variables AS headline, variables, "
        f"effect_size * effect_size / (effect_size * effect_size + 4.0) AS magnitude, p_adj, n_eff FROM ({tests}) WHERE is_significant "
        "UNION ALL SELECT 1, position, 'Pairwise Correlation', method || ': ' || pair || ' (r=' || corr || ')', pair, corr * corr, p_adj, n_eff "
        f"FROM ({pairs}) WHERE is_significant"
    )
    return (
        "SELECT CAST(row_number() OVER (ORDER BY l DESC, kind, position) AS INTEGER) AS place, type, headline, variables, round(magnitude, 4) AS normalized_magnitude, "
        f"round(l, 4) AS l_ci, p_adj, n_eff FROM (SELECT *, greatest(0.0, magnitude - 1.96 / sqrt(greatest(n_eff, 4))) AS l FROM ({both})) "
        "QUALIFY place <= 5"
    )


QUERIES = {
    "pearson_pairs": (pearson_pairs, _pearson_sql(GAPPY_LINEITEM, _GAPPY)),
    "wide_pearson_pairs": (wide_pearson_pairs, _WIDE_PEARSON),
    "gappy_correlations": (gappy_correlations, _family_sql(_spearman_tests(GAPPY_LINEITEM, _GAPPY))),
    "priced_correlations": (priced_correlations, _family_sql(_spearman_tests(PRICED_LINEITEM, _PRICED))),
    "pearson_family": (pearson_family, _family_sql(_pearson_tests(GAPPY_LINEITEM, _GAPPY))),
    "redundant_pairs": (
        redundant,
        f"SELECT position AS pair, col1, col2, round(abs(r), 4) AS corr FROM ({_pearson_tests(PRICED_LINEITEM, _PRICED)}) WHERE abs(r) > 0.9",
    ),
    "vif": (vif, _vif_sql()),
    "sign_reversals": (
        sign_reversals,
        _simpson_sql(_REVERSING, ["level", "rate", "l_tax"], ["l_linestatus", "l_returnflag"], None, 0.2, 0.15),
    ),
    "weak_reversals": (
        weak_reversals,
        _simpson_sql(GAPPY_LINEITEM, _GAPPY, ["l_returnflag", "l_linestatus"], None, 0.0, 0.0),
    ),
    "status_group_tests": (status_group_tests, _group_family(_STATUS_GROUPS)),
    "all_group_tests": (all_group_tests, _group_family(union_all(_ALL_TESTS))),
    "embedding_group_tests": (embedding_group_tests, _embedding_tests_sql()),
    "levene": (levene_statistics, _levene_sql()),
    "flag_crosstab": (
        flag_crosstab,
        "SELECT l_returnflag AS value1, l_linestatus AS value2, count(*) AS n FROM lineitem GROUP BY ALL",
    ),
    "order_associations": (order_associations, _contingency_sql(_ORDER_FLAGS, _FLAGS)),
    "line_associations": (line_associations, _line_associations_sql()),
    "line_p_values": (line_p_values, _LINE_P),
    "insights": (insights, _insight_sql()),
}
