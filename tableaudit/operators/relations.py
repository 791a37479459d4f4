"""Correlations, sign reversals, group and contingency tests, and false-discovery control."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import numeric_columns, other_columns, plain_number, quoted, text_of
from ..functions.severity import correlation_strength
from ..functions.shapiro import shapiro_wilk
from ..functions.tails import chi_square_p, exact_u_p, f_p, fisher_p, normal_p, student_p
from ..plans.aggregates import small_table
from ..plans.freq import few_valued, value_counts
from ..plans.joins import lookup_join
from ..plans.materialise import materialise
from ..plans.pairs import all_pairs, pair_moments
from ..plans.prefix import bucket_limits, bucket_of, running_totals
from ..plans.quantiles import counts_of, exact_quantiles
from ..plans.ranks import rank_correlations
from ..plans.tiles import is_wide, tiled_best, tiled_pairs
from .distribution import SHAPIRO_ROWS, moments, normality_gate, numeric_values
from .facts import Facts


# --- choosing columns -------------------------------------------------------------------------------
def category_values(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = 20, order_col: str | None = None
) -> dict[str, list[str]]:
    """Values, as text, of the non-numeric columns with fewer than ``limit`` distinct values.

    Values are in ascending order, or in order of first appearance when ``order_col`` gives a row order.
    """
    names = few_valued(df, list(columns) if columns is not None else other_columns(df), limit)
    if not names:
        return {}
    if order_col is None:
        found = value_counts(df, names, whole=True).select("column", "value", F.col("value").alias("at"))
    else:
        items = F.array(*[F.struct(F.lit(c).alias("column"), text_of(df, c).alias("value")) for c in names])
        found = (
            df.select(F.inline(items), quoted(order_col).alias("order"))
            if order_col not in names
            else df.select(quoted(order_col).alias("order"), F.inline(items))
        )
        found = found.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.min("order").alias("at"))
    out: dict[str, list[str]] = {}
    for r in found.orderBy("column", "at").select("column", "value").collect():
        out.setdefault(r["column"], []).append(r["value"])
    return {c: out[c] for c in names if c in out and len(out[c]) < limit}


# --- false-discovery control ------------------------------------------------------------------------
def adjust_family(tests: DataFrame, p: str = "raw_p_value", order: str = "position") -> DataFrame:
    """Benjamini-Hochberg for one family of tests: adds ``p_adj`` (4 decimals) and ``is_significant``.

    The rows are tests, at most one per pair of columns, so one task orders them.
    """
    m = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(p, order))
    raised = tests.withColumn("__q", F.col(p) * m / rank)
    later = Window.partitionBy().orderBy(F.desc(p), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    p_adj = F.round(F.least(F.lit(1.0), F.min("__q").over(later)), 4)
    return (
        raised.withColumn("p_adj", p_adj).drop("__q").withColumn("is_significant", F.col("p_adj") < 0.05)
    )


def adjust_large_family(tests: DataFrame, p: str = "raw_p_value", rows_per_bucket: int = 2_000_000) -> DataFrame:
    """``adjust_family`` for any number of tests: no task orders all of them."""
    kept = materialise(tests.withColumn("__family", F.lit(0)))
    return bh_adjust(kept, p, "__family", rows_per_bucket).drop("__family", "family_size_m")


def bh_adjust(
    df: DataFrame, p: str, family: str, rows_per_bucket: int = 2_000_000
) -> DataFrame:
    """Benjamini-Hochberg over a table of p values of any size: adds ``family_size_m``, ``p_adj``, ``is_significant``.

    Works on distinct p values per family with their counts, cut into value buckets: totals per bucket give
    the ranks, minima per bucket give the running minimum from above.
    """
    value = quoted(p).cast("double")
    n = counts_of(df, {"p": value})["p"]
    limits = bucket_limits(df, {"p": value}, {"p": n}, rows_per_bucket)
    counts = (
        df.select(quoted(family).alias("family"), value.alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("family", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", bucket_of(F.lit("p"), F.col("value"), limits))
    )
    blocks = counts.groupBy("family", "bucket").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("family").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "family",
        "bucket",
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"),
        F.sum("total").over(Window.partitionBy("family")).alias("m"),
    )
    inside = Window.partitionBy("family", "bucket").orderBy("value")
    raised = counts.join(blocks, ["family", "bucket"]).withColumn(
        "q",
        F.col("value")
        * F.col("m")
        / (F.col("start") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))),
    )
    later = Window.partitionBy("family").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    above = (
        raised.groupBy("family", "bucket")
        .agg(F.min("q").alias("low"))
        .select("family", "bucket", F.min("low").over(later).alias("above"))
    )
    down = Window.partitionBy("family", "bucket").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = raised.join(above, ["family", "bucket"]).select(
        F.col("family").alias(family),
        F.col("value").alias("__p"),
        "n",
        F.col("m").alias("family_size_m"),
        F.round(F.least(F.lit(1.0), F.min("q").over(down), F.col("above")), 4).alias("p_adj"),
    )
    out = lookup_join(df.withColumn("__p", value), adjusted, [family, "__p"], n).drop("__p")
    return out.withColumn("is_significant", F.col("p_adj") < 0.05)


# --- correlations -----------------------------------------------------------------------------------
def pearson_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, facts: Facts | None = None
) -> DataFrame:
    """``(pair, col1, col2, n_eff, cov, var1, var2, r)`` of every column pair, pairwise complete."""
    values = numeric_values(df, columns)
    if is_wide(values):
        return tiled_pairs(df, values)
    if facts is not None or len(values) < 2:
        return (facts or Facts(df, columns)).pair_table()
    return pair_moments(df, values)


_CORRELATION = (
    "position int, col1 string, col2 string, method string, r double, n_eff bigint"
)


def correlations(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "auto",
    min_n: int = 8,
    facts: Facts | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Correlation family: coefficient, p value, adjusted p value and strength of every column pair.

    ``auto`` takes Pearson when both columns pass the normality gate and Spearman otherwise. With ``by``, one family per
    segment. Pearson families of wide tables are worked out in tiles and adjusted without gathering them.
    """
    if by:
        from .segments import correlations_by

        return correlations_by(df, by, columns, method, min_n)
    values = numeric_values(df, columns)
    wide = is_wide(values) and method == "pearson"
    if wide:
        found = tiled_pairs(df, values).where(F.col("n_eff") >= min_n)
        table = found.select(F.col("pair").alias("position"), "col1", "col2", F.lit(K.PEARSON).alias("method"), "r", "n_eff")
    else:
        rows = _coefficients(df, facts or Facts(df, columns), method, min_n)
        table = small_table(df.sparkSession, rows, _CORRELATION)
    n, r = F.col("n_eff"), F.coalesce(F.col("r"), F.lit(0.0))
    t = F.abs("r") * F.sqrt(F.try_divide(n - 2, 1 - F.col("r") * F.col("r")))
    perfect = F.abs("r") >= 1.0
    raw = F.when(F.col("r").isNull(), 1.0).when(perfect, 0.0).otherwise(student_p(F.when(~perfect, t), n - 2))
    tested = table.withColumn("raw_p_value", F.coalesce(raw, F.lit(1.0)))
    tested = adjust_large_family(tested) if wide else adjust_family(tested)
    return tested.select(
        "position",
        F.concat_ws(" & ", "col1", "col2").alias("pair"),
        "col1",
        "col2",
        "method",
        F.round(r, 4).alias("corr"),
        F.round("raw_p_value", 4).alias("raw_p_value"),
        "n_eff",
        correlation_strength(r).alias("strength"),
        "p_adj",
        "is_significant",
    )


def _coefficients(df: DataFrame, facts: Facts, method: str, min_n: int) -> list[tuple]:
    values = facts.values
    kept = [r for r in facts.pairs if r["n_eff"] >= min_n]
    pairs = [(r["col1"], r["col2"]) for r in kept]
    if method == "auto":
        normal = {r["column"] for r in facts.normality if r["is_normal"]}
    else:
        normal = set(values) if method == "pearson" else set()
    ranked = [p for p in pairs if not (p[0] in normal and p[1] in normal)]
    rho = {}
    if ranked:
        used = list(dict.fromkeys(c for p in ranked for c in p))
        sizes = df.agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count(values[c]).alias(f"n{i}") for i, c in enumerate(used)],
            *[F.approx_count_distinct(values[c]).alias(f"d{i}") for i, c in enumerate(used)],
        ).first()
        counts, distinct = ({c: sizes[f"{x}{i}"] for i, c in enumerate(used)} for x in "nd")
        rho = rank_correlations(
            df,
            {c: values[c] for c in used},
            ranked,
            {(r["col1"], r["col2"]): r["n_eff"] for r in kept},
            counts,
            distinct,
            sizes["total"],
        )
    rows = []
    for r in kept:
        pair = (r["col1"], r["col2"])
        use_rank = pair in rho
        rows.append(
            (len(rows), *pair, K.SPEARMAN if use_rank else K.PEARSON, rho[pair] if use_rank else r["r"], r["n_eff"])
        )
    return rows


def redundant_pairs(
    df: DataFrame, limit: float = 0.90, columns: Sequence[str] | None = None, facts: Facts | None = None
) -> DataFrame:
    """``(pair, col1, col2, corr)`` with an absolute Pearson correlation above ``limit``."""
    size = F.abs("r")
    values = numeric_values(df, columns)
    pairs = tiled_pairs(df, values, limit) if is_wide(values) else pearson_matrix(df, columns, facts)
    return pairs.where(size > limit).select("pair", "col1", "col2", F.round(size, 4).alias("corr"))


def vif_scores(df: DataFrame, columns: Sequence[str] | None = None, facts: Facts | None = None) -> DataFrame:
    """``(column, max_r2, vif)``: 1 / (1 - largest squared pairwise correlation), 999 near collinearity."""
    values = numeric_values(df, columns)
    if is_wide(values):
        best = tiled_best(df, values)
    else:
        ends = F.array(F.col("col1"), F.col("col2"))
        pairs = pearson_matrix(df, columns, facts)
        r2 = pairs.select(F.explode(ends).alias("column"), (F.col("r") * F.col("r")).alias("r2"))
        best = r2.groupBy("column").agg(F.coalesce(F.max("r2"), F.lit(0.0)).alias("max_r2"))
    vif = F.when(F.col("max_r2") < 0.9999, F.try_divide(F.lit(1.0), 1.0 - F.col("max_r2"))).otherwise(999.0)
    return best.select("column", "max_r2", F.round(vif, 2).alias("vif"))


# --- sign reversals ---------------------------------------------------------------------------------
def simpsons(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    groups: Sequence[str] | None = None,
    limit: int | None = None,
    min_n: int = 15,
    min_r: float = 0.20,
    min_group: int = 6,
    min_group_r: float = 0.15,
    facts: Facts | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Pairs whose correlation changes sign inside subgroups: one row per reversing subgroup.

    Only pairs that pass the overall rule are computed per subgroup. ``limit`` keeps the first findings. With ``by``, the
    rule is applied inside every segment, whole.
    """
    if by:
        from .segments import simpsons_by

        return simpsons_by(df, by, columns, groups, min_n, min_r, min_group, min_group_r)
    values = numeric_values(df, columns)
    schema = (
        "finding int, feature_x string, feature_y string, group_var string, overall_corr double, "
        "category string, subgroup_corr double, n_eff bigint"
    )
    spark = df.sparkSession
    known = facts.levels if facts is not None and groups is None else category_values(df, groups)
    levels = {c: v for c, v in known.items() if 2 <= len(v) <= 5}
    overall = []
    if levels:
        # of a wide table only the pairs that pass the rule leave their tiles
        pairs = tiled_pairs(df, values, min_r).collect() if is_wide(values) else (facts or Facts(df, columns)).pairs
        overall = [
            (r["pair"], r["col1"], r["col2"], r["r"])
            for r in sorted(pairs, key=lambda r: r["pair"])
            if r["n_eff"] >= min_n and r["r"] is not None and abs(r["r"]) >= min_r
        ]
    if not overall:
        return small_table(spark, [], schema)
    names = list(levels)
    level = F.array(*[F.struct(F.lit(i).alias("z"), text_of(df, c).alias("category")) for i, c in enumerate(names)])
    used = list(dict.fromkeys(c for _, a, b, _ in overall for c in (a, b)))
    slots = {c: f"v{i}" for i, c in enumerate(used)}
    long = df.select(*[values[c].alias(slots[c]) for c in used], F.inline(level)).where(F.col("category").isNotNull())
    inner = pair_moments(
        long, {c: F.col(slots[c]) for c in used}, [(a, b) for _, a, b, _ in overall], keys=["z", "category"]
    )
    whole = small_table(spark, overall, "number int, col1 string, col2 string, overall_r double")
    found = (
        inner.drop("pair")
        .join(whole, ["col1", "col2"])
        .where(
            (F.col("n_eff") >= min_group)
            & (F.abs("r") > min_group_r)
            & (F.signum("r") != F.signum("overall_r"))
        )
    )
    # one row per reversing subgroup: (pairs x grouping columns x 5) rows at most
    found = found.withColumn("finding", F.dense_rank().over(Window.partitionBy().orderBy("number", "z")))
    if limit is not None:
        found = found.where(F.col("finding") <= limit)
    return found.select(
        "finding",
        F.col("col1").alias("feature_x"),
        F.col("col2").alias("feature_y"),
        F.get(F.array(*[F.lit(c) for c in names]), F.col("z")).alias("group_var"),
        F.round("overall_r", 4).alias("overall_corr"),
        "category",
        F.round("r", 4).alias("subgroup_corr"),
        "n_eff",
    )


# --- two-group tests ----------------------------------------------------------------------------------
#: categoricals whose counts are summed side by side
_CATEGORIES_A_PASS = 8


def _cells(df: DataFrame, values: Mapping[str, Column], levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(column, value, a0, b0, a1, b1, ...)``: rows of each numeric value with the first and second value of each categorical.

    One row per distinct value, whatever the number of categoricals; partial counts are formed before the shuffle. U, ties,
    moments, medians and distances from them all follow from this table.
    """
    codes = []
    for i, (cat, (v1, v2)) in enumerate(levels.items()):
        text = text_of(df, cat)
        codes.append(F.when(text == v1, 1).when(text == v2, 2).alias(f"s{i}"))
    wide = df.select(*codes, *[v.alias(f"v{j}") for j, v in enumerate(values.values())])
    cells = [x for j, c in enumerate(values) for x in (F.lit(c), F.col(f"v{j}"))]
    names = [f"s{i}" for i in range(len(levels))]
    long = wide.select(*names, F.stack(F.lit(len(values)), *cells).alias("column", "value")).where(F.col("value").isNotNull())
    counts = [F.count_if(F.col(s) == g + 1).alias(f"{side}{i}") for i, s in enumerate(names) for g, side in enumerate("ab")]
    return long.groupBy("column", "value").agg(*counts)


def _cell_moments(cells: DataFrame, categories: int) -> dict[tuple[str, int, int], dict]:
    """{(column, categorical, side): n, mean, variance, g1, g2, skewness} in two passes over the cells."""
    out: dict[tuple[str, int, int], dict] = {}
    v = F.col("value")
    for start in range(0, categories, _CATEGORIES_A_PASS):
        sides = [f"{g}{i}" for i in range(start, min(start + _CATEGORIES_A_PASS, categories)) for g in "ab"]
        sums = [x for s in sides for x in (F.sum(s).alias(f"n_{s}"), (F.sum(F.col(s) * v) / F.nullif(F.sum(s), F.lit(0))).alias(f"m_{s}"))]
        means = cells.groupBy("column").agg(*sums)
        central = [F.sum(F.col(s) * F.pow(v - F.col(f"m_{s}"), k)).alias(f"p{k}_{s}") for s in sides for k in (2, 3, 4)]
        # one row per column
        rows = cells.join(F.broadcast(means), "column").groupBy("column").agg(
            *central, *[F.first(f"{x}_{s}").alias(f"{x}_{s}") for s in sides for x in "nm"]
        )
        for r in rows.collect():
            for s in sides:
                n, mean = r[f"n_{s}"], r[f"m_{s}"]
                if not n:
                    out[r["column"], int(s[1:]), "ab".index(s[0])] = {"n": 0}
                    continue
                m2, m3, m4 = (r[f"p{k}_{s}"] / n for k in (2, 3, 4))
                if m2 <= (abs(mean) * 1e-13) ** 2:  # rounding of the mean of equal values
                    m2 = 0.0
                g1, g2 = (m3 / m2**1.5, m4 / m2**2 - 3) if m2 else (None, None)
                out[r["column"], int(s[1:]), "ab".index(s[0])] = {
                    "n": n,
                    "mean": mean,
                    "variance": m2 * n / (n - 1) if n > 1 else 0.0,
                    "g1": g1,
                    "g2": g2,
                    "skewness": (g1 or 0.0) * (n * (n - 1.0)) ** 0.5 / (n - 2.0) if n > 2 else 0.0,
                }
    return out


def _shapiro_cells(groups: pd.DataFrame) -> pd.DataFrame:
    w, p = shapiro_wilk(np.repeat(groups["value"].to_numpy(), groups["n"].to_numpy()))
    return pd.DataFrame({"column": [groups["key"].iloc[0]], "w": [w], "p": [p]})


def _rank_statistics(cells: DataFrame, limits: Mapping[str, Sequence[float]], used: Sequence[int]) -> dict:
    """{(column, categorical): (rank sum of the first group, sum of tie terms)}."""
    both = cells.select("column", "value", *[f"a{i}" for i in used], *[(F.col(f"a{i}") + F.col(f"b{i}")).alias(f"t{i}") for i in used])
    ranked = running_totals(both, [f"t{i}" for i in used], limits)
    aggs = []
    for i in used:
        size = F.col(f"t{i}").cast("double")
        rank = F.col(f"t{i}_before") + (size + 1) / 2.0
        aggs += [F.sum(F.col(f"a{i}") * rank).alias(f"r{i}"), F.sum(size * size * size - size).alias(f"k{i}")]
    rows = ranked.groupBy("column").agg(*aggs).collect()
    return {(r["column"], i): (r[f"r{i}"], r[f"k{i}"]) for r in rows for i in used}


def _u_statistic(r1: float, ties: float, n1: int, n2: int) -> tuple[float, float | None, bool]:
    """(U of the first group, normal score, whether no values tie)."""
    total = n1 + n2
    u1 = r1 - n1 * (n1 + 1) / 2.0
    var = n1 * n2 / 12.0 * ((total + 1) - ties / (total * (total - 1.0)))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / var**0.5 if var > 0 else None
    return u1, z, ties == 0


def _levene_cells(cells: DataFrame, limits: Mapping[str, Sequence[float]], stats: Mapping, used: Sequence[int]) -> dict:
    """{(column, categorical): (statistic, degrees of freedom)} of distances from the group medians."""
    sides = [f"{g}{i}" for i in used for g in "ab"]
    at = lambda s: (int(s[1:]), "ab".index(s[0]))
    totals = running_totals(cells.select("column", "value", *sides), sides, limits)
    columns = list(dict.fromkeys(c for c, _, _ in stats))
    rows = [(c, *[stats.get((c, *at(s)), {"n": 0})["n"] for s in sides]) for c in columns]
    counts = small_table(cells.sparkSession, rows, "column string, " + ", ".join(f"n_{s} bigint" for s in sides))
    spot = lambda s, rank: F.max(
        F.when((F.col(s) > 0) & (F.col(f"{s}_before") <= rank(F.col(f"n_{s}"))), F.col("value"))
    )
    low, high = lambda n: F.floor((n - 1) / 2), lambda n: F.ceil((n - 1) / 2)
    mids = totals.join(F.broadcast(counts), "column").groupBy("column").agg(
        *[((spot(s, low) + spot(s, high)) / 2).alias(f"m_{s}") for s in sides]
    )
    away = lambda s: F.abs(F.col("value") - F.col(f"m_{s}"))
    sums = cells.join(F.broadcast(mids), "column").groupBy("column").agg(
        *[x for s in sides for x in (F.sum(F.col(s) * away(s)).alias(f"z_{s}"), F.sum(F.col(s) * away(s) * away(s)).alias(f"y_{s}"))]
    )
    out = {}
    for r in sums.collect():
        for i in used:
            n1, n2 = (stats[r["column"], i, g]["n"] for g in (0, 1))
            if min(n1, n2) < 2:
                continue
            (m1, m2), (y1, y2) = ([r[f"{k}_{g}{i}"] for g in "ab"] for k in "zy")
            m1, m2 = m1 / n1, m2 / n2
            grand = (n1 * m1 + n2 * m2) / (n1 + n2)
            between = n1 * (m1 - grand) ** 2 + n2 * (m2 - grand) ** 2
            within = (y1 - n1 * m1 * m1) + (y2 - n2 * m2 * m2)
            out[r["column"], i] = ((n1 + n2 - 2) * between / within if within > 0 else None, float(n1 + n2 - 2))
    return out


def group_tests(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    groups: Sequence[str] | None = None,
    limit: int | None = None,
    min_n: int = 8,
    order_col: str | None = None,
    rows_per_bucket: int = 2_000_000,
    facts: Facts | None = None,
) -> DataFrame:
    """Two-group tests of every numeric column by every two-valued categorical, in column order.

    Both groups normal: Student's t, or Welch's when Levene's test rejects equal variances. Otherwise
    Mann-Whitney. ``limit`` keeps the first tests of the family; None runs all of them.
    """
    return _adjusted(_raw_group_tests(df, columns, groups, limit, min_n, order_col, rows_per_bucket, facts))


def _adjusted(tests: DataFrame) -> DataFrame:
    return adjust_family(tests).withColumn("raw_p_value", F.round("raw_p_value", 4))


def _raw_group_tests(df, columns, groups, limit, min_n, order_col, rows_per_bucket, facts=None) -> DataFrame:
    values = numeric_values(df, columns)
    shared = facts is not None and groups is None and order_col == facts.order_col
    levels = facts.levels if shared else category_values(df, groups, order_col=order_col)
    levels = {c: v for c, v in levels.items() if len(v) == 2}
    rows = _run_group_tests(df, values, levels, limit, min_n, rows_per_bucket) if levels and values else []
    table = small_table(df.sparkSession, rows, _GROUP_TEST)
    # each family member carries the statistic its p value is read from
    raw = (
        F.when(F.col("exact_p").isNotNull(), F.col("exact_p"))
        .when(F.col("test_name") == K.MANN_WHITNEY, F.least(F.lit(1.0), normal_p(F.greatest("z", F.lit(0.0)))))
        .otherwise(student_p(F.col("statistic"), F.col("dof")))
    )
    return table.select(
        "position",
        "test_name",
        F.format_string("'%s' by '%s' (%s vs %s)", "num_col", "cat_col", "value1", "value2").alias("variables"),
        "num_col",
        "cat_col",
        F.round(F.coalesce("statistic", F.lit(0.0)), 4).alias("statistic"),
        F.coalesce(raw, F.lit(1.0)).alias("raw_p_value"),
        F.round("effect_size", 4).alias("effect_size"),
        F.lit("Cohen's d").alias("effect_size_type"),
        "n_eff",
    )


_GROUP_TEST = (
    "position int, test_name string, num_col string, cat_col string, value1 string, value2 string, "
    "statistic double, dof double, z double, exact_p double, effect_size double, n_eff bigint"
)


def cohens_d(a, b) -> float:
    """Difference of means over the pooled standard deviation, from two moment rows."""
    n1, n2 = a["n"], b["n"]
    if n1 < 2 or n2 < 2:
        return 0.0
    pooled = (((n1 - 1) * a["variance"] + (n2 - 1) * b["variance"]) / (n1 + n2 - 2)) ** 0.5
    return (a["mean"] - b["mean"]) / pooled if pooled else 0.0


def _run_group_tests(df, values, levels, limit, min_n, rows_per_bucket) -> list[tuple]:
    spark, names = df.sparkSession, list(levels)
    cells = materialise(_cells(df, values, levels))
    stats = _cell_moments(cells, len(names))
    size = lambda c, i: tuple(stats.get((c, i, g), {"n": 0})["n"] for g in (0, 1))
    tests = [(c, i) for i in range(len(names)) for c in values if min(size(c, i)) >= min_n][:limit]
    if not tests:
        return []
    sides = [(c, i, g) for c, i in tests for g in (0, 1)]
    keyed = {side: f"{k}" for k, side in enumerate(sides)}
    small = [(c, i, g, keyed[c, i, g]) for c, i, g in sides if 8 <= stats[c, i, g]["n"] <= SHAPIRO_ROWS]
    tested = None
    if small:
        used = sorted({i for _, i, _, _ in small})
        each = F.array(
            *[F.struct(F.lit(i).alias("cat"), F.lit(g).alias("side"), F.col(f"{'ab'[g]}{i}").alias("n")) for i in used for g in (0, 1)]
        )
        wanted = small_table(spark, small, "column string, cat int, side int, key string")
        rows = cells.select("column", "value", F.inline(each)).where("n > 0").join(F.broadcast(wanted), ["column", "cat", "side"])
        tested = rows.select("key", "value", "n").groupBy("key").applyInPandas(_shapiro_cells, "column string, w double, p double")
    found = [{"column": keyed[side], **stats[side]} for side in sides]
    passed = {r["column"] for r in normality_gate(spark, found, tested).where("is_normal").select("column").collect()}
    normal = [t for t in tests if all(keyed[(*t, g)] in passed for g in (0, 1))]
    ranked = [t for t in tests if t not in set(normal)]
    totals = {c: max(sum(size(c, i)) for i in range(len(names))) for c in values}
    limits = bucket_limits(df, values, totals, rows_per_bucket)
    equal, ranks = {}, {}
    if normal:
        levenes = _levene_cells(cells, limits, stats, sorted({i for _, i in normal}))
        table = small_table(
            spark, [(k, *levenes[t]) for k, t in enumerate(normal) if t in levenes], "test int, statistic double, dof double"
        )
        p = f_p(F.col("statistic"), F.lit(1.0), F.col("dof"))
        equal = {normal[r["test"]]: r["p"] is not None and r["p"] > 0.05 for r in table.select("test", p.alias("p")).collect()}
    if ranked:
        ranks = _rank_statistics(cells, limits, sorted({i for _, i in ranked}))
    rows = []
    for position, t in enumerate(tests):
        (c, i), (a, b) = t, (stats[(*t, g)] for g in (0, 1))
        n1, n2 = a["n"], b["n"]
        stat = dof = z = exact = None
        if t in equal or t in set(normal):
            test, stat, dof = student_or_welch(a, b, equal.get(t, False))
        else:
            test = K.MANN_WHITNEY
            stat, z, untied = _u_statistic(*ranks[t], n1, n2)
            if untied and min(n1, n2) <= 8:
                exact = exact_u_p(stat, n1, n2)
        rows.append((position, test, c, names[i], *levels[names[i]], stat, dof, z, exact, cohens_d(a, b), n1 + n2))
    return rows


def student_or_welch(a, b, equal_variance: bool) -> tuple[str, float | None, float | None]:
    """(test, t, degrees of freedom) from two moment rows."""
    n1, n2, v1, v2 = a["n"], b["n"], a["variance"], b["variance"]
    gap = a["mean"] - b["mean"]
    if equal_variance:
        dof = n1 + n2 - 2.0
        error = (((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1.0 / n1 + 1.0 / n2)) ** 0.5
        return K.STUDENT_T, gap / error if error else None, dof
    s1, s2 = v1 / n1, v2 / n2
    error = (s1 + s2) ** 0.5
    dof = (s1 + s2) ** 2 / (s1**2 / (n1 - 1) + s2**2 / (n2 - 1)) if error else None
    return K.WELCH_T, gap / error if error else None, dof


def levene(df: DataFrame, sides: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``(test, statistic, p_value)``: Brown-Forsythe form, distances from the group medians."""
    flat = {f"{t}:{g}": side for t, pair in sides.items() for g, side in enumerate(pair)}
    counts = counts_of(df, flat)
    mids = exact_quantiles(df, flat, [0.5], counts)
    away = {k: F.abs(v - F.lit(mids[k][0.5])) for k, v in flat.items() if k in mids}
    spread = {r["column"]: r for r in moments(df, away).collect()}
    rows = []
    for t in sides:
        a, b = spread.get(f"{t}:0"), spread.get(f"{t}:1")
        if a is None or b is None:
            continue
        n1, n2 = a["n"], b["n"]
        grand = (n1 * a["mean"] + n2 * b["mean"]) / (n1 + n2)
        between = n1 * (a["mean"] - grand) ** 2 + n2 * (b["mean"] - grand) ** 2
        within = (n1 - 1) * a["variance"] + (n2 - 1) * b["variance"]
        rows.append((t, (n1 + n2 - 2) * between / within if within else None, float(n1 + n2 - 2)))
    table = small_table(df.sparkSession, rows, "test string, statistic double, dof double")
    return table.select("test", "statistic", f_p(F.col("statistic"), F.lit(1.0), F.col("dof")).alias("p_value"))


# --- contingency tests ----------------------------------------------------------------------------------
def contingency_table(df: DataFrame, col1: str, col2: str) -> DataFrame:
    """``(value1, value2, n)`` without missing values."""
    pairs = df.select(text_of(df, col1).alias("value1"), text_of(df, col2).alias("value2")).dropna()
    return pairs.groupBy("value1", "value2").agg(F.count(F.lit(1)).alias("n"))


#: combined categories up to this many are counted before pairs are formed
_JOINT_CELLS = 1_000_000


def _pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]], joint_cells: float) -> DataFrame:
    """``(pair, value1, value2, o)``; rows are first reduced to distinct combinations when those are few."""
    names = list(dict.fromkeys(c for p in pairs for c in p))
    rows = df.select(*[text_of(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    if joint_cells <= _JOINT_CELLS:
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("w"))
    else:
        rows = rows.withColumn("w", F.lit(1))
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"),
                F.col(f"c{names.index(a)}").alias("value1"),
                F.col(f"c{names.index(b)}").alias("value2"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return rows.select("w", F.inline(items)).dropna().groupBy("pair", "value1", "value2").agg(F.sum("w").alias("o"))


def contingency_statistics(
    df: DataFrame, pairs: Sequence[tuple[str, str]], joint_cells: float = float("inf")
) -> DataFrame:
    """``(pair, n_eff, r, c, chi2, dof, min_expected, small_share, cochran_ok, a, b, c_, d)`` per column pair.

    Both columns of a pair have fewer than 20 values, so a pair has at most 361 cells.
    """
    cells = _pair_cells(df, pairs, joint_cells)
    by = Window.partitionBy
    cells = cells.select(
        "*",
        F.sum("o").over(by("pair", "value1")).cast("double").alias("row"),
        F.sum("o").over(by("pair", "value2")).cast("double").alias("col"),
        F.sum("o").over(by("pair")).cast("double").alias("n"),
        F.min("value1").over(by("pair")).alias("v1"),
        F.min("value2").over(by("pair")).alias("v2"),
    ).withColumn("e", F.col("row") * F.col("col") / F.col("n"))
    top, left = F.col("value1") == F.col("v1"), F.col("value2") == F.col("v2")

    def cell(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("o"))), F.lit(0))

    sums = cells.groupBy("pair").agg(
        F.first("n").alias("n"),
        F.count(F.lit(1)).alias("filled"),
        F.collect_set(F.struct("value1", "row")).alias("rows"),
        F.collect_set(F.struct("value2", "col")).alias("cols"),
        F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("fit"),
        F.sum("e").alias("e_filled"),
        cell(top & left).alias("a"),
        cell(top & ~left).alias("b"),
        cell(~top & left).alias("c"),
        cell(~top & ~left).alias("d"),
    )
    r, c = F.size("rows"), F.size("cols")
    every = F.flatten(
        F.transform("rows", lambda x: F.transform("cols", lambda y: x["row"] * y["col"] / F.col("n")))
    )
    plain = F.col("fit") + F.when(F.col("filled") < r * c, F.col("n") - F.col("e_filled")).otherwise(0.0)
    # in a 2x2 table every cell is off by the same amount
    gap = F.abs(F.col("a").cast("double") * F.col("d") - F.col("b").cast("double") * F.col("c")) / F.col("n")
    inverse = lambda col, field: F.aggregate(
        col, F.lit(0.0), lambda acc, x: acc + 1.0 / x[field]
    )
    yates = F.pow(gap - F.least(gap, F.lit(0.5)), 2) * F.col("n") * inverse("rows", "row") * inverse("cols", "col")
    return (
        sums.select(
            "*",
            r.alias("r"),
            c.alias("k"),
            F.when((r == 2) & (c == 2), yates).otherwise(plain).alias("chi2"),
            ((r - 1) * (c - 1)).alias("dof"),
            F.array_min(every).alias("min_expected"),
            (F.size(F.filter(every, lambda x: x < 5)) / F.size(every)).alias("small_share"),
        )
        .withColumn("cochran_ok", (F.col("min_expected") >= 1.0) & (F.col("small_share") <= 0.20))
        .withColumn(
            "cramers_v", F.sqrt(F.try_divide(F.col("chi2") / F.col("n"), F.least(F.col("r"), F.col("k")) - F.lit(1)))
        )
    )


_CELL_STATS = [
    ("pair", "int"), ("n", "double"), ("r", "int"), ("k", "int"), ("chi2", "double"), ("dof", "int"),
    ("cochran_ok", "boolean"), ("cramers_v", "double"), ("a", "bigint"), ("b", "bigint"), ("c", "bigint"), ("d", "bigint"),
]

_CONTINGENCY = (
    "position int, test_name string, variables string, col1 string, col2 string, statistic double, "
    "raw_p_value double, effect_size double, effect_size_type string, n_eff bigint"
)


def contingency_tests(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Association tests of low-cardinality column pairs: chi-square, or Fisher's exact test on a sparse 2x2.

    ``limit`` keeps the first tests of the family; None runs all of them.
    """
    return _adjusted(_raw_contingency_tests(df, columns, limit))


def _raw_contingency_tests(df: DataFrame, columns: Sequence[str] | None, limit: int | None) -> DataFrame:
    levels = {c: v for c, v in category_values(df, columns).items() if len(v) > 1}
    pairs = all_pairs(list(levels))
    found: list[tuple] = []
    # a limited family stops early: later pairs are not counted
    step = len(pairs) if limit is None else 2 * limit
    for part in (pairs[i : i + step] for i in range(0, len(pairs), max(step, 1))):
        joint = math.prod(len(levels[c]) + 1 for c in {c for pair in part for c in pair})
        usable = contingency_statistics(df, part, joint).where((F.col("r") > 1) & (F.col("k") > 1))
        rows = usable.select(*[name for name, _ in _CELL_STATS]).orderBy("pair").collect()
        found += [(len(found) + i, part[r["pair"]][0], part[r["pair"]][1], *r[1:]) for i, r in enumerate(rows)]
        if limit is not None and len(found) >= limit:
            found = found[:limit]
            break
    if not found:
        return small_table(df.sparkSession, [], _CONTINGENCY)
    schema = "position int, col1 string, col2 string, " + ", ".join(f"{n} {t}" for n, t in _CELL_STATS[1:])
    stats = small_table(df.sparkSession, found, schema)
    exact = (F.col("r") == 2) & (F.col("k") == 2) & ~F.col("cochran_ok")
    cross = F.col("b").cast("double") * F.col("c")
    odds = F.when(cross != 0, F.col("a").cast("double") * F.col("d") / cross).otherwise(float("inf"))
    only = lambda c: F.when(exact, F.col(c))
    p = F.coalesce(
        fisher_p(only("a"), only("b"), only("c"), only("d")), chi_square_p(F.when(~exact, F.col("chi2")), F.col("dof"))
    )
    name = F.when(exact, K.FISHER).when(F.col("cochran_ok"), K.CHI_SQUARE).otherwise(K.CHI_SQUARE_WARNING)
    return stats.select(
        "position",
        name.alias("test_name"),
        F.format_string("Categorical: '%s' & '%s'", "col1", "col2").alias("variables"),
        "col1",
        "col2",
        F.round(F.when(exact, odds).otherwise(F.col("chi2")), 4).alias("statistic"),
        F.coalesce(p, F.lit(1.0)).alias("raw_p_value"),
        F.round(F.coalesce("cramers_v", F.lit(0.0)), 4).alias("effect_size"),
        F.lit("Cramer's V").alias("effect_size_type"),
        F.col("n").cast("long").alias("n_eff"),
    )


def association_tests(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    group_limit: int | None = None,
    limit: int | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """Two-group tests followed by contingency tests, adjusted together as one family.

    ``group_limit`` keeps the first group tests, ``limit`` the first tests of the family.
   """
    numeric = [c for c in (columns or df.columns) if c in numeric_columns(df, flags=False)]
    other = [c for c in (columns or df.columns) if c in other_columns(df)]
    common = ["position", "test_name", "variables", "statistic", "raw_p_value", "effect_size", "effect_size_type", "n_eff"]
    first = _raw_group_tests(df, numeric, other, group_limit, 8, order_col, 2_000_000).select(*common)
    second = _raw_contingency_tests(df, other, limit).select(*common).withColumn("position", F.col("position") + 1000000)
    both = first.unionByName(second)
    both = both.withColumn("position", (F.row_number().over(Window.partitionBy().orderBy("position")) - 1).cast("int"))
    return _adjusted(both if limit is None else both.where(F.col("position") < limit))


# --- ranking ------------------------------------------------------------------------------------------
def rank_insights(tests: DataFrame, pairs: DataFrame, top: int = 5) -> DataFrame:
    """Significant findings by the lower 95 % limit of their effect, best first, one per variable set.

    ``tests`` needs position, test_name, variables, effect_size, effect_size_type, n_eff, p_adj and
    is_significant; ``pairs`` is a correlation family.
    """
    d = F.abs("effect_size")
    group = tests.where("is_significant").select(
        F.lit(0).alias("kind"),
        "position",
        F.lit("Group Difference Test").alias("type"),
        F.concat_ws(" on ", "test_name", "variables").alias("headline"),
        "variables",
        F.when(F.col("effect_size_type") == "Cramer's V", d * d).otherwise(d * d / (d * d + 4.0)).alias("magnitude"),
        "n_eff",
        "p_adj",
    )
    corr = pairs.where("is_significant").select(
        F.lit(1).alias("kind"),
        "position",
        F.lit("Pairwise Correlation").alias("type"),
        F.concat(F.col("method"), F.lit(": "), F.col("pair"), F.lit(" (r="), plain_number(F.col("corr")), F.lit(")")).alias(
            "headline"
        ),
        F.col("pair").alias("variables"),
        (F.col("corr") * F.col("corr")).alias("magnitude"),
        "n_eff",
        "p_adj",
    )
    error = F.lit(1.96) / F.sqrt(F.greatest(F.col("n_eff"), F.lit(4)))
    both = group.unionByName(corr).withColumn(
        "l_ci", F.greatest(F.lit(0.0), F.col("magnitude") - error)
    )
    best = Window.partitionBy("variables").orderBy(F.desc("l_ci"), "kind", "position")
    order = Window.partitionBy().orderBy(F.desc("l_ci"), "kind", "position")  # of the few rows that are left
    return (
        both.withColumn("__n", F.row_number().over(best))
        .where("__n = 1")
        .orderBy(F.desc("l_ci"), "kind", "position")
        .limit(top)
        .withColumn("place", F.row_number().over(order))
        .select(
            "place",
            "type",
            "headline",
            "variables",
            F.round("magnitude", 4).alias("normalized_magnitude"),
            F.round("l_ci", 4).alias("l_ci"),
            "p_adj",
            "n_eff",
        )
    )
