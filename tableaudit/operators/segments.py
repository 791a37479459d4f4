"""Evidence by segment: one row per segment and column, for any number of segments.

A segment is one combination of values of the ``by`` columns, missing values included. Segments are keys of aggregates,
never filters in a loop: the table is read as often as without segments, partial results of a hot segment are formed
before every shuffle, and no step gathers a segment in one task. Only where a rule itself is about few rows (samples of
at most 5000 values, values of a low-cardinality column) does one task see a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import severity
from ..functions.columns import (
    KEY_LENGTH,
    is_numeric,
    key_of,
    numeric_columns,
    other_columns,
    quoted,
    stripped,
    text_of,
    value_of,
)
from ..functions.moments import omnibus, safe_corr, sample_kurtosis, sample_skewness
from ..functions.shapiro import shapiro_wilk
from ..functions.severity import correlation_strength
from ..functions.tails import student_p
from ..plans.aggregates import per_column, small_table
from ..plans.materialise import materialise
from ..plans.pairs import all_pairs, pair_moments
from ..plans.quantiles import DIRECT_ROWS
from ..plans.ranks import keyed_rank_correlations
from ..plans.spreads import attach, spreads

SEGMENT = "__segment"
SHAPIRO_ROWS = 5000
#: segments of up to this many rows are ranked by windows, larger ones by value counts
WINDOW_ROWS = 5_000_000


def _split(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The table with its segment as one column, whose missing parts compare as equal, and the other columns."""
    if not by:
        raise ValueError("name at least one segment column")
    rest = [c for c in df.columns if c not in by]
    segment = F.struct(*[quoted(c).alias(f"by{i}") for i, c in enumerate(by)]).alias(SEGMENT)
    return df.select(segment, *[quoted(c) for c in rest]), rest


def _named(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Segment columns under their own names, in front."""
    return found.select(
        *[F.col(f"{SEGMENT}.by{i}").alias(c) for i, c in enumerate(by)], *[c for c in found.columns if c != SEGMENT]
    )


def _long(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(segment, column, value)`` without missing values."""
    slots = {f"v{i}": v for i, v in enumerate(values.values())}
    wide = df.select(SEGMENT, *[v.alias(s) for s, v in slots.items()])
    cells = [x for s, c in zip(slots, values) for x in (F.lit(c), F.col(s))]
    return wide.select(SEGMENT, F.stack(F.lit(len(slots)), *cells).alias("column", "value")).where(
        F.col("value").isNotNull()
    )


# --- quality --------------------------------------------------------------------------------------------
def column_quality_by(df: DataFrame, by: Sequence[str], quasi_share: float = 95.0) -> DataFrame:
    """``column_quality`` for every segment.

    Near-constant columns need exact value counts; 128 hash buckets of each segment and column show which can be near
    constant, and only those are counted by value.
    """
    from .quality import _missing, _ordered, _sentinels

    rows, names = _split(df, by)
    stats = {}
    for c in names:
        value, numeric = _ordered(df, c), is_numeric(df.schema[c].dataType)
        stats[c] = {
            "total_rows": F.count(F.lit(1)),
            "present": F.count(value),
            "is_constant": F.coalesce(F.min(value) == F.max(value), F.lit(False)),
            "has_negative": F.coalesce(F.min(value) < 0, F.lit(False)) if numeric else F.lit(False),
            "sentinels": _sentinels(df, c),
        }
    facts = materialise(per_column(rows, stats, keys=[SEGMENT]))
    at = [SEGMENT, "column"]
    varied = facts.where((F.col("present") > 0) & ~F.col("is_constant")).select(*at, "present")
    keys = {c: key_of(text_of(df, c)) for c in names}
    long = _long(rows, keys)
    bucket = F.pmod(F.xxhash64("value"), F.lit(128))
    largest = long.groupBy(*at, bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).groupBy(*at).agg(F.max("n").alias("n"))
    likely = materialise(
        largest.join(varied, at).where(F.col("n") * 100.0 >= quasi_share * F.col("present")).select(*at)
    )
    counts = attach(long, likely, at).groupBy(*at, "value").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("top_n") * 100.0 / F.col("total")
    top = (
        counts.groupBy(*at)
        .agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
            F.max("n").alias("top_n"),
            F.count(F.lit(1)).alias("nunique"),
            F.sum("n").alias("total"),
        )
        .where((share >= quasi_share) & (F.col("nunique") > 1))
        .select(*at, "top_value", F.round(share, 2).alias("top_pct"))
    )
    table = facts.join(_whole(rows, df, names, top), at, "left").withColumn("is_quasi_constant", F.col("top_pct").isNotNull())
    kept = ("is_constant", "is_quasi_constant", "top_value", "top_pct", "has_negative", "sentinels")
    return _named(_missing(table, False, SEGMENT, *kept), by)


def _whole(rows: DataFrame, df: DataFrame, names: Sequence[str], found: DataFrame) -> DataFrame:
    """``found`` with whole texts in place of bounded keys in ``top_value``."""
    long = _long(rows, {c: text_of(df, c) for c in names}).where(F.length("value") > KEY_LENGTH)
    keyed = long.select("column", key_of(F.col("value")).alias("top_value"), F.col("value").alias("__whole"))
    wanted = found.where(F.length("top_value") > KEY_LENGTH).select("column", "top_value").distinct()
    whole = keyed.join(wanted, ["column", "top_value"], "left_semi").groupBy("column", "top_value").agg(F.max("__whole").alias("__whole"))
    out = found.join(whole, ["column", "top_value"], "left")
    return out.withColumn("top_value", F.coalesce("__whole", "top_value")).select(*found.columns)


def table_quality_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``table_quality`` for every segment; the ``by`` columns are not judged. Duplicates are equal rows of a segment."""
    from .quality import _ordered, _row_key, _text_columns, scored

    rows, names = _split(df, by)
    stats = {
        c: {
            "rows": F.count(F.lit(1)),
            "nulls": F.count(F.lit(1)) - F.count(_ordered(df, c)),
            "negative": F.coalesce(F.min(value_of(df, c)) < 0, F.lit(False)).cast("int")
            if is_numeric(df.schema[c].dataType)
            else F.lit(0),
        }
        for c in names
    }
    cells = per_column(rows, stats, keys=[SEGMENT])
    cells = cells.groupBy(SEGMENT).agg(
        F.max("rows").alias("total_rows"), F.sum("nulls").alias("total_nulls"), F.sum("negative").alias("negative_columns")
    )
    fields = [f for f in df.schema.fields if f.name in names]
    keyed = rows.select(SEGMENT, *[_row_key(df, f).alias(f"c{i}") for i, f in enumerate(fields)])
    if len(names) > 32:  # as without segments: wide rows travel as digests
        parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in
                 (f"c{i}" for i in range(len(names)))]
        keyed = keyed.select(SEGMENT, F.unhex(F.sha2(F.concat(*parts), 256)).alias("c0"))
    counted = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
    copies = counted.groupBy(SEGMENT).agg(F.sum(F.col("n") - 1).alias("duplicate_rows"))
    parts = [cells, copies]
    texts = [c for c in _text_columns(df) if c in names]
    if texts:
        forms = _long(rows, {c: text_of(df, c) for c in texts}).select(
            SEGMENT, "column", key_of(F.lower(stripped(F.col("value")))).alias("norm"), key_of(F.col("value")).alias("form")
        )
        groups = forms.groupBy(SEGMENT, "column", "norm").agg(F.min("form").alias("low"), F.max("form").alias("high"))
        parts.append(
            groups.where("low != high").groupBy(SEGMENT).agg(F.count_distinct("column").alias("variant_columns"))
        )
    one = reduce(lambda a, b: a.join(b, SEGMENT, "left"), parts)
    if not texts:
        one = one.withColumn("variant_columns", F.lit(0).cast("bigint"))
    one = one.withColumn("variant_columns", F.coalesce("variant_columns", F.lit(0)))
    return _named(scored(one, len(names), SEGMENT), by)


# --- distributions --------------------------------------------------------------------------------------
def _moments_by(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    stats = {
        c: {
            "n": F.count(v), "mean": F.avg(v), "variance": F.var_samp(v), "low": F.min(v), "high": F.max(v),
            "g1": F.skewness(v), "g2": F.kurtosis(v),
        }
        for c, v in values.items()
    }
    raw = per_column(rows, stats, keys=[SEGMENT])
    n = F.col("n").cast("double")
    return raw.withColumns(
        {
            "std": F.when(n > 1, F.sqrt("variance")).otherwise(0.0),
            "variance": F.when(n > 1, F.col("variance")).otherwise(0.0),
            "skewness": sample_skewness(n, F.col("g1")),
            "kurtosis": sample_kurtosis(n, F.col("g2")),
        }
    ).where("n > 0")


def _shapiro_groups(groups: pd.DataFrame) -> pd.DataFrame:
    w, p = shapiro_wilk(groups["value"].to_numpy())
    return pd.DataFrame({"group": [groups["group"].iloc[0]], "w": [w], "p": [p]})


def _normality_by(long: DataFrame, found: DataFrame) -> DataFrame:
    """The normality gate from moments; groups of 8 to 5000 values are tested one by one, each in one task."""
    at = [SEGMENT, "column"]
    numbered = materialise(found.select(*at, "n", "g1", "g2", "skewness"))
    few, big = F.col("n") < 8, F.col("n") > SHAPIRO_ROWS
    small = numbered.where(~few & ~big).select(*at, F.xxhash64(F.to_json(F.struct(*at))).alias("group"))
    if small.isEmpty():  # no scan for them
        tested = small.select(*at, F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("p"))
    else:
        tested = attach(long, small, at).select("group", "value").groupBy("group").applyInPandas(
            _shapiro_groups, "group bigint, w double, p double"
        )
        tested = small.join(tested, "group").select(*at, "w", "p")
    k2, tail = omnibus(F.col("n"), F.col("g1"), F.col("g2"))
    stat = F.coalesce(F.when(few, 0.0).when(big, k2).otherwise(F.col("w")), F.lit(0.0))
    p = F.coalesce(F.when(few, 0.0).when(big, tail).otherwise(F.col("p")), F.lit(0.0))
    return numbered.join(tested, at, "left").select(
        *at,
        F.when(few, K.SAMPLE_CHECK).when(big, K.DAGOSTINO).otherwise(K.SHAPIRO).alias("test_used"),
        F.round(stat, 4).alias("normality_statistic"),
        F.round(p, 4).alias("normality_p"),
        (~few & (p > 0.05) & (F.abs(F.round("skewness", 4)) < 0.5)).alias("is_normal"),
    )


def numeric_profile_by(
    df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None, direct: int = DIRECT_ROWS
) -> DataFrame:
    """``numeric_profile`` for every segment; a segment without values of a column has no row for it."""
    rows, _ = _split(df, by)
    names = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    if not names:
        raise ValueError("no numeric columns beside the segment columns")
    values = {c: value_of(df, c) for c in names}
    found = materialise(_moments_by(rows, values))
    long = _long(rows, values)
    at = [SEGMENT, "column"]
    spread = spreads(long, at, found.select(*at, "n"), direct=direct)
    pct = F.round(F.col("total_outliers") * 100.0 / F.col("n"), 2)
    r4 = lambda c: F.round(c, 4).alias(c)
    joined = found.join(spread.drop("n"), at).join(_normality_by(long, found), at)
    joined = joined.withColumnsRenamed({"low": "min", "high": "max"}).withColumns(
        {"iqr": F.col("q75") - F.col("q25"), "skewness": F.round("skewness", 4), "outlier_pct": pct}
    )
    out = joined.select(
        SEGMENT,
        "position",
        "column",
        "n",
        *[r4(c) for c in ("mean", "std", "variance", "min", "max", "q25", "median", "q75", "iqr", "mad")],
        "skewness",
        r4("kurtosis"),
        severity.skew_severity(F.col("skewness")).alias("skewness_severity"),
        "test_used",
        "normality_statistic",
        "normality_p",
        "is_normal",
        "mad_count",
        "iqr_count",
        "total_outliers",
        "outlier_pct",
        severity.outlier_severity(F.col("outlier_pct")).alias("outlier_severity"),
    )
    return _named(out, by)


def categorical_profile_by(
    df: DataFrame, by: Sequence[str], top: int = 5, columns: Sequence[str] | None = None
) -> DataFrame:
    """``categorical_profile`` for every segment; ties go to the smallest value."""
    rows, _ = _split(df, by)
    names = list(columns) if columns is not None else other_columns(df, exclude=by)
    at = [SEGMENT, "column"]
    counts = _long(rows, {c: key_of(text_of(df, c)) for c in names}).groupBy(*at, "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*at).agg(F.count(F.lit(1)).alias("nunique"), F.sum("n").alias("total"))
    order = Window.partitionBy(*at).orderBy(F.desc("n"), F.asc("value"))
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    best = _whole(rows, df, names, best.withColumnRenamed("value", "top_value")).withColumnRenamed("top_value", "value")
    every = small_table(df.sparkSession, [(i, c) for i, c in enumerate(names)], "position int, column string")
    out = best.join(totals, at).join(F.broadcast(every), "column").select(
        SEGMENT,
        "position",
        "column",
        "nunique",
        F.round(F.col("nunique") / F.col("total"), 4).alias("unique_ratio"),
        "place",
        "value",
        "n",
        F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"),
    )
    return _named(out, by)


# --- relationships ----------------------------------------------------------------------------------------
def _ranked_by(rows: DataFrame, values: dict[str, Column], pairs: Sequence[tuple[str, str]], large: DataFrame) -> DataFrame:
    """``(segment, col1, col2, rho)``: rank correlation of each pair over its complete rows in every small segment.

    Columns without gaps are ranked once. A pair with gaps is ranked over its own rows: windows that also part rows by
    completeness.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    slot = {c: f"x{i}" for i, c in enumerate(names)}
    flat = rows.join(F.broadcast(large.select(SEGMENT)), SEGMENT, "left_anti")
    flat = flat.select(SEGMENT, *[values[c].alias(slot[c]) for c in names])
    gaps = flat.agg(*[F.count_if(F.col(s).isNull()).alias(s) for s in slot.values()]).first()
    gappy = {c: gaps[slot[c]] > 0 for c in names}
    ranks: dict[tuple, str] = {}
    exprs = {}
    for a, b in pairs:
        holes = tuple(sorted(slot[c] for c in (a, b) if gappy[c]))
        for c in (a, b):
            if (slot[c], holes) not in ranks:
                ranks[slot[c], holes] = f"r{len(ranks)}"
                whole = [F.col(h).isNotNull() for h in holes]
                by_rows = Window.partitionBy(SEGMENT, *whole)
                low = F.rank().over(by_rows.orderBy(slot[c]))
                same = F.count(F.lit(1)).over(Window.partitionBy(SEGMENT, *whole, slot[c]))
                rank = low + (same - 1) / 2.0
                exprs[ranks[slot[c], holes]] = F.when(reduce(Column.__and__, whole), rank) if holes else rank
    ranked = flat.select("*", *[e.alias(r) for r, e in exprs.items()])
    aggs, cells = [], []
    for i, (a, b) in enumerate(pairs):
        holes = tuple(sorted(slot[c] for c in (a, b) if gappy[c]))
        x, y = F.col(ranks[slot[a], holes]), F.col(ranks[slot[b], holes])
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.var_pop(F.when(y.isNotNull(), x)).alias(f"a{i}"),
                 F.var_pop(F.when(x.isNotNull(), y)).alias(f"b{i}")]
        rho = safe_corr(F.col(f"c{i}"), F.col(f"a{i}"), F.col(f"b{i}"))
        cells.append(F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), rho.alias("rho")))
    return ranked.groupBy(SEGMENT).agg(*aggs).select(SEGMENT, F.inline(F.array(*cells)))


def _ranked_large(rows: DataFrame, values: dict[str, Column], pairs: Sequence[tuple[str, str]], large: DataFrame) -> list[DataFrame]:
    """The same for segments beyond ``WINDOW_ROWS`` rows, all of them together, by value counts and rank buckets."""
    # at most rows / WINDOW_ROWS segments
    numbered = materialise(large.select(SEGMENT, F.row_number().over(Window.partitionBy().orderBy(SEGMENT)).alias("__key")))
    part = rows.join(F.broadcast(numbered), SEGMENT)
    names = list(dict.fromkeys(c for p in pairs for c in p))
    sizes = part.groupBy("__key").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(values[c]).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.approx_count_distinct(values[c]).alias(f"d{i}") for i, c in enumerate(names)],
        *[F.count(F.when(values[b].isNotNull(), values[a])).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
    ).collect()
    if not sizes:
        return []
    added = lambda of, x: {c: sum(r[f"{x}{i}"] for r in sizes) for i, c in enumerate(of)}
    rho = keyed_rank_correlations(
        part,
        F.col("__key"),
        [r["__key"] for r in sizes],
        values,
        pairs,
        added(pairs, "p"),
        added(names, "n"),
        added(names, "d"),
        sum(r["total"] for r in sizes),
    )
    table = [(k, a, b, r) for (k, (a, b)), r in rho.items()]
    found = small_table(rows.sparkSession, table, "__key int, col1 string, col2 string, rho double")
    return [found.join(F.broadcast(numbered), "__key").select(SEGMENT, "col1", "col2", "rho")]


def correlations_by(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str] | None = None,
    method: str = "auto",
    min_n: int = 8,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """``correlations`` for every segment; each segment is a family of tests of its own.

    ``auto`` takes Pearson for two columns that pass the normality gate in their segment, Spearman otherwise.
    """
    rows, _ = _split(df, by)
    names = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    pairs = all_pairs(names)
    if not pairs:
        raise ValueError("correlations need two numeric columns beside the segment columns")
    values = {c: value_of(df, c) for c in names}
    both = [SEGMENT, "col1", "col2"]
    found = materialise(pair_moments(rows, values, pairs, keys=[SEGMENT]).where(F.col("n_eff") >= min_n))
    pearson = found.withColumn("method", F.lit(K.PEARSON))
    if method != "pearson":
        large = materialise(rows.groupBy(SEGMENT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window_rows))
        rho = [_ranked_by(rows, values, pairs, large), *_ranked_large(rows, values, pairs, large)]
        ranked = found.join(reduce(DataFrame.unionByName, rho), both, "left")
        use = F.lit(True)
        if method == "auto":
            gate = _normality_by(_long(rows, values), _moments_by(rows, values)).where("is_normal")
            normal = gate.groupBy(SEGMENT).agg(F.collect_set("column").alias("__normal"))
            ranked = ranked.join(normal, SEGMENT, "left")
            fits = lambda c: F.coalesce(F.array_contains("__normal", F.col(c)), F.lit(False))
            use = ~(fits("col1") & fits("col2"))
        pearson = ranked.withColumns(
            {"method": F.when(use, K.SPEARMAN).otherwise(K.PEARSON), "r": F.when(use, F.col("rho")).otherwise(F.col("r"))}
        )
    n, r = F.col("n_eff"), F.coalesce(F.col("r"), F.lit(0.0))
    perfect = F.abs("r") >= 1.0
    t = F.abs("r") * F.sqrt(F.try_divide(n - 2, 1 - F.col("r") * F.col("r")))
    raw = F.when(F.col("r").isNull(), 1.0).when(perfect, 0.0).otherwise(student_p(F.when(~perfect, t), n - 2))
    tested = pearson.withColumn("raw_p_value", F.coalesce(raw, F.lit(1.0)))
    out = adjust_by(tested, [SEGMENT], order="pair").select(
        SEGMENT,
        F.col("pair").alias("position"),
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
    return _named(out, by)


def adjust_by(tests: DataFrame, keys: Sequence[str], p: str = "raw_p_value", order: str = "position") -> DataFrame:
    """Benjamini-Hochberg inside every family given by ``keys``; a family has one row per pair of columns at most."""
    family = Window.partitionBy(*keys)
    rank = F.row_number().over(family.orderBy(p, order))
    raised = tests.withColumn("__q", F.col(p) * F.count(F.lit(1)).over(family) / rank)
    later = family.orderBy(F.desc(p), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = raised.withColumn("p_adj", F.round(F.least(F.lit(1.0), F.min("__q").over(later)), 4)).drop("__q")
    return adjusted.withColumn("is_significant", F.col("p_adj") < 0.05)


def simpsons_by(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str] | None = None,
    groups: Sequence[str] | None = None,
    min_n: int = 15,
    min_r: float = 0.20,
    min_group: int = 6,
    min_group_r: float = 0.15,
) -> DataFrame:
    """``simpsons`` inside every segment: pairs whose correlation there changes sign in a subgroup of 2 to 5.

    ``finding`` numbers the pairs and grouping columns of a segment.
    """
    rows, _ = _split(df, by)
    names = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    cats = list(groups) if groups is not None else other_columns(df, exclude=by)
    pairs = all_pairs(names)
    if not pairs or not cats:
        raise ValueError("sign reversals need two numeric columns and a grouping column beside the segment columns")
    values = {c: value_of(df, c) for c in names}
    texts = {c: text_of(df, c) for c in cats}
    at = [SEGMENT, "column"]
    # a column with 2 to 5 values in a segment fills at most 5 of 128 buckets there
    filled = _long(rows, {c: F.when(t.isNotNull(), F.pmod(F.xxhash64(t), F.lit(128))) for c, t in texts.items()})
    likely = filled.distinct().groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n <= 5").select(*at)
    exact = attach(_long(rows, {c: key_of(t) for c, t in texts.items()}), materialise(likely), at).distinct()
    levels = exact.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 2 AND 5").select(*at)
    overall = materialise(
        pair_moments(rows, values, pairs, keys=[SEGMENT])
        .where((F.col("n_eff") >= min_n) & (F.abs("r") >= min_r))
        .select(SEGMENT, "col1", "col2", F.col("pair").alias("number"), F.col("r").alias("overall_r"))
    )
    slots = {c: f"v{i}" for i, c in enumerate(names)}
    flat = rows.select(SEGMENT, *[values[c].alias(s) for c, s in slots.items()], *[texts[c].alias(f"g{i}") for i, c in enumerate(cats)])
    cells = [x for i, c in enumerate(cats) for x in (F.lit(i), F.lit(c), F.col(f"g{i}"))]
    long = flat.select(SEGMENT, *slots.values(), F.stack(F.lit(len(cats)), *cells).alias("z", "column", "category"))
    long = attach(long.where(F.col("category").isNotNull()), materialise(levels), at)
    inner = pair_moments(long, {c: F.col(s) for c, s in slots.items()}, pairs, keys=[SEGMENT, "z", "column", "category"])
    found = inner.drop("pair").join(overall, [SEGMENT, "col1", "col2"]).where(
        (F.col("n_eff") >= min_group) & (F.abs("r") > min_group_r) & (F.signum("r") != F.signum("overall_r"))
    )
    place = F.dense_rank().over(Window.partitionBy(SEGMENT).orderBy("number", "z"))
    out = found.withColumn("finding", place).select(
        SEGMENT,
        "finding",
        F.col("col1").alias("feature_x"),
        F.col("col2").alias("feature_y"),
        F.col("column").alias("group_var"),
        F.round("overall_r", 4).alias("overall_corr"),
        "category",
        F.round("r", 4).alias("subgroup_corr"),
        "n_eff",
    )
    return _named(out, by)


# --- target -------------------------------------------------------------------------------------------------
def class_distribution_by(df: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """``(by..., class, n)`` without missing classes."""
    rows, _ = _split(df, by)
    counts = rows.select(SEGMENT, text_of(df, target).alias("class")).where(F.col("class").isNotNull())
    return _named(counts.groupBy(SEGMENT, "class").agg(F.count(F.lit(1)).alias("n")), by)


def class_balance_by(df: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """``class_balance`` for every segment that has a class."""
    from .target import balanced

    rows, _ = _split(df, by)
    counts = rows.select(SEGMENT, text_of(df, target).alias("class")).where(F.col("class").isNotNull())
    sizes = counts.groupBy(SEGMENT, "class").agg(F.count(F.lit(1)).alias("n")).groupBy(SEGMENT).agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("min_count"), F.max("n").alias("max_count")
    )
    return _named(balanced(sizes), by)
