"""Text claims from evidence tables, the rule gate, and the check of a text's numbers against evidence."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import plain_number, quoted
from ..plans.spreads import attach

_EVIDENCE = {
    "metric": "string",
    "column": "string",
    "other_column": "string",
    "n": "bigint",
    "missing_pct": "double",
    "severity": "string",
    "statistic": "double",
    "p_adj": "double",
    "is_normal": "boolean",
    "detail": "string",
    "mean": "double",
    "median": "double",
    "subgroups": "array<struct<category:string,corr:double,n_eff:bigint>>",
}


@dataclass(frozen=True)
class Claim:
    """How rows of an evidence table become sentences.

    ``numbers`` and ``labels`` map the facts of the sentence to columns of the table; ``subject`` names the labels that
    say what the sentence is about, ``where`` the rows worth a sentence, ``evidence`` the columns kept with it.
    """

    template: int
    metric: str
    category: str
    source: str
    order: str
    subject: tuple[str, ...] = ()
    labels: Mapping[str, str] = field(default_factory=dict)
    numbers: Mapping[str, str] = field(default_factory=dict)
    where: str = "true"
    evidence: Mapping[str, str] = field(default_factory=dict)

    @property
    def pieces(self) -> list[str]:
        """Wording and names of facts by turns."""
        return re.split(r"\{(\w+)\}", K.SENTENCES[self.metric])


def _shown(column: str, whole: bool) -> Column:
    """A number as sentences show it."""
    return F.col(column).cast("string") if whole else F.coalesce(plain_number(F.col(column).cast("double")), F.lit("None"))


_WHOLE = ("null_count", "duplicate_rows", "total_outliers")

CLAIMS = [
    Claim(
        1, "missingness", "quality", "column_quality", "position", ("column",),
        {"column": "column", "severity": "severity"},
        {"missing_pct": "missing_pct", "null_count": "null_count"},
        "null_count > 0",
        {"column": "column", "n": "null_count", "missing_pct": "missing_pct", "severity": "severity"},
    ),
    Claim(
        2, "duplicates", "quality", "table_quality", "0", (),
        {"severity": "duplicate_severity"},
        {"duplicate_rows": "duplicate_rows", "duplicate_pct": "duplicate_pct"},
        evidence={"n": "duplicate_rows", "statistic": "duplicate_pct", "severity": "duplicate_severity"},
    ),
    Claim(
        3, "constant_column", "quality", "column_quality", "position", ("column",), {"column": "column"},
        where="is_constant", evidence={"column": "column"},
    ),
    Claim(
        4, "quasi_constant", "quality", "column_quality", "position", ("column",),
        {"column": "column", "value": "top_value"}, {"top_pct": "top_pct"}, "is_quasi_constant",
        {"column": "column", "detail": "top_value", "statistic": "top_pct"},
    ),
    Claim(
        5, "pii", "quality", "pii", "position", ("column", "type"),
        {"column": "column", "type": "type", "confidence": "confidence"},
        evidence={"column": "column", "n": "matched", "severity": "confidence", "detail": "type"},
    ),
    Claim(
        6, "quality_score", "quality", "table_quality", "0", (), {"grade": "grade"}, {"overall_score": "overall_score"},
        evidence={"statistic": "overall_score", "detail": "grade"},
    ),
    Claim(
        7, "shape", "distribution", "numeric_dist", "position * 3", ("column",),
        {"column": "column", "severity": "skewness_severity"},
        {"mean": "mean", "median": "median", "skewness": "skewness"},
        evidence={
            "column": "column", "statistic": "skewness", "severity": "skewness_severity", "mean": "mean", "median": "median",
        },
    ),
    Claim(
        7, "normality", "distribution", "numeric_dist", "position * 3 + 1", ("column",),
        {"column": "column", "verdict": "verdict", "test": "test_used"}, {"p_value": "normality_p"},
        evidence={"column": "column", "statistic": "normality_statistic", "is_normal": "is_normal", "detail": "test_used"},
    ),
    Claim(
        7, "outliers", "distribution", "numeric_dist", "position * 3 + 2", ("column",),
        {"column": "column", "severity": "outlier_severity"},
        {"total_outliers": "total_outliers", "outlier_pct": "outlier_pct"},
        "total_outliers > 0",
        {"column": "column", "n": "total_outliers", "statistic": "outlier_pct", "severity": "outlier_severity"},
    ),
    Claim(
        10, "simpsons", "relationship", "simpsons", "finding", ("feature_x", "feature_y", "group_var"),
        {"feature_x": "feature_x", "feature_y": "feature_y", "group_var": "group_var"}, {"overall_corr": "overall_corr"},
        evidence={
            "column": "feature_x", "other_column": "feature_y", "n": "size(subgroups)", "statistic": "overall_corr",
            "detail": "group_var", "subgroups": "subgroups",
        },
    ),
    Claim(
        11, "correlation", "relationship", "correlations", "position", ("pair",),
        {"pair": "pair", "method": "method"}, {"corr": "corr", "p_adj": "p_adj"}, "is_significant",
        {
            "column": "col1", "other_column": "col2", "n": "n_eff", "statistic": "corr", "p_adj": "p_adj",
            "detail": "method",
        },
    ),
    Claim(
        12, "group_test", "relationship", "group_tests", "position", ("variables",),
        {"test": "test_name", "variables": "variables", "effect": "effect_size_type"},
        {"p_adj": "p_adj", "effect_size": "effect_size"}, "is_significant",
        {
            "column": "num_col", "other_column": "cat_col", "n": "n_eff", "statistic": "effect_size", "p_adj": "p_adj",
            "detail": "test_name",
        },
    ),
    Claim(
        13, "redundancy", "relationship", "redundant", "pair", ("col1", "col2"),
        {"col1": "col1", "col2": "col2"}, {"corr": "corr"},
        evidence={"column": "col1", "other_column": "col2", "statistic": "corr"},
    ),
    Claim(
        14, "imbalance", "anomaly", "balance", "0", (),
        {"classes": "listed", "severity": "imbalance_severity"}, {"ratio": "imbalance_ratio"},
        "imbalance_ratio IS NOT NULL",
        {"n": "classes", "statistic": "imbalance_ratio", "severity": "imbalance_severity", "detail": "listed"},
    ),
    Claim(
        15, "leakage", "anomaly", "leakage", "position", ("column",), {"column": "column"},
        {"correlation": "correlation"}, evidence={"column": "column", "statistic": "correlation"},
    ),
]
_BY_METRIC = {c.metric: c for c in CLAIMS}


def claims_of(metric: str, evidence: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., template, order, category, claim, evidence)``: one sentence per row of evidence that deserves one."""
    spec = _BY_METRIC[metric]
    pieces = spec.pieces
    words = [F.lit(pieces[0])]
    for name, wording in zip(pieces[1::2], pieces[2::2]):
        shown = _shown(spec.numbers[name], name in _WHOLE) if name in spec.numbers else F.col(spec.labels[name])
        words += [F.coalesce(shown, F.lit("null")), F.lit(wording)]
    fields = [
        (F.lit(metric) if k == "metric" else F.expr(spec.evidence[k]) if k in spec.evidence else F.lit(None))
        .cast(t)
        .alias(k)
        for k, t in _EVIDENCE.items()
    ]
    return evidence.where(spec.where).select(
        *[quoted(c) for c in by],
        F.lit(spec.template).alias("template"),
        F.expr(spec.order).cast("long").alias("order"),
        F.lit(spec.category).alias("category"),
        F.concat(*words).alias("claim"),
        F.struct(*fields).alias("evidence"),
    )


# --- evidence tables as the sentences need them -----------------------------------------------------------
def _with_verdict(numeric_dist: DataFrame) -> DataFrame:
    verdict = F.when(F.col("is_normal"), K.VERDICT_NORMAL).otherwise(K.VERDICT_NOT_NORMAL)
    return numeric_dist.withColumn("verdict", verdict)


def _with_subgroups(simpsons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per finding with its reversing subgroups, at most five."""
    inner = F.struct("category", F.col("subgroup_corr").alias("corr"), "n_eff")
    return simpsons.groupBy(*by, "finding", "feature_x", "feature_y", "group_var", "overall_corr").agg(
        F.sort_array(F.collect_list(inner)).alias("subgroups")
    )


#: classes that a sentence lists
LISTED_CLASSES = 50


def _with_listed(
    distribution: DataFrame, balance: DataFrame, most: int = LISTED_CLASSES, by: Sequence[str] = ()
) -> DataFrame:
    """Class balance with its classes in words, largest first; with more than ``most`` classes their number instead.

    Every class stays a row of ``distribution``. No list grows beyond ``most``: a class whose place among the larger ones
    is beyond it is dropped by a limit inside every task.
    """
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "class")
        first = distribution.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most)
    else:
        first = distribution.orderBy(F.desc("n"), "class").limit(most)
    item = F.transform("items", lambda x: F.concat(F.lit("'"), x["class"], F.lit("': "), (-x["size"]).cast("string")))
    listed = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("size"), "class"))).alias("items"))
    words = listed.select(*by, F.concat(F.lit("{"), F.concat_ws(", ", item), F.lit("}")).alias("listed"))
    if by:
        both = balance.join(words, list(by))
    else:  # one row each
        both = balance.unionByName(words, allowMissingColumns=True)
        both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    number = F.concat(F.col("classes").cast("string"), F.lit(" classes"))
    return both.withColumn("listed", F.when(F.col("classes") <= most, F.col("listed")).otherwise(number))


def missing_claims(column_quality: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return claims_of("missingness", column_quality, by)


def duplicate_claims(table_quality: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return claims_of("duplicates", table_quality, by)


def constant_claims(column_quality: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return claims_of("constant_column", column_quality, by)


def quasi_constant_claims(column_quality: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return claims_of("quasi_constant", column_quality, by)


def pii_claims(pii: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return claims_of("pii", pii, by)


def score_claims(table_quality: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return claims_of("quality_score", table_quality, by)


def distribution_claims(numeric_dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shape, normality and outlier claims, column by column."""
    named = _with_verdict(numeric_dist)
    return reduce(DataFrame.unionByName, [claims_of(m, named, by) for m in ("shape", "normality", "outliers")])


def simpson_claims(simpsons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return claims_of("simpsons", _with_subgroups(simpsons, by), by)


def correlation_claims(correlations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return claims_of("correlation", correlations, by)


def group_test_claims(group_tests: DataFrame) -> DataFrame:
    return claims_of("group_test", group_tests)


def redundancy_claims(redundant: DataFrame) -> DataFrame:
    return claims_of("redundancy", redundant)


def balance_claims(
    distribution: DataFrame, balance: DataFrame, most: int = LISTED_CLASSES, by: Sequence[str] = ()
) -> DataFrame:
    """One claim with the class counts, largest class first; none for fewer than two classes."""
    return claims_of("imbalance", _with_listed(distribution, balance, most, by), by)


def leakage_claims(leakage: DataFrame) -> DataFrame:
    return claims_of("leakage", leakage)


def number_claims(*parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., claim_id, category, claim, evidence, confidence, status)`` of all claims, numbered in report order.

    One claim per fact and column, or per pair of columns; with ``by``, every segment is numbered by itself.
    """
    every = reduce(DataFrame.unionByName, parts)
    number = F.row_number().over(Window.partitionBy(*[quoted(c) for c in by]).orderBy("template", "order"))
    return every.select(
        *[quoted(c) for c in by],
        F.concat(F.lit("claim_"), number.cast("string")).alias("claim_id"),
        "category",
        "claim",
        "evidence",
        F.lit("high").alias("confidence"),
        F.lit("pending_validation").alias("status"),
    )


# --- numbers of a text against evidence ---------------------------------------------------------------------
_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:E-?[0-9]+)?|-?Infinity|NaN|None)"
_JOINED = "\u0001"


def facts(tables: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., metric, subject, numbers, labels)``: what evidence tables know, one row per metric and subject.

    ``tables`` has evidence tables by name, as ``Audit.tables``; ``balance`` may be given instead of its two parts. Rows
    that deserve no sentence are known too, so that a false sentence about them is found out.
    """
    ready = dict(tables)
    if "numeric_dist" in ready:
        ready["numeric_dist"] = _with_verdict(ready["numeric_dist"])
    if "simpsons" in ready:
        ready["simpsons"] = _with_subgroups(ready["simpsons"], by)
    if "class_distribution" in ready and "class_balance" in ready:
        ready["balance"] = _with_listed(ready["class_distribution"], ready["class_balance"], by=by)
    parts = []
    for spec in CLAIMS:
        if spec.source not in ready:
            continue
        table = ready[spec.source]
        if spec.metric == "constant_column":
            table = table.where("is_constant")  # the sentence has no number: being constant is the fact
        pack = lambda names, kind: (
            F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c).cast(kind))])
            if names
            else F.create_map().cast(f"map<string,{kind}>")
        )
        parts.append(
            table.select(
                *[quoted(c) for c in by],
                F.lit(spec.metric).alias("metric"),
                F.concat_ws(_JOINED, *[F.col(spec.labels[s]) for s in spec.subject]).alias("subject"),
                pack(spec.numbers, "double").alias("numbers"),
                pack({k: c for k, c in spec.labels.items() if k not in spec.subject}, "string").alias("labels"),
            ).withColumn("labels", F.transform_values("labels", lambda _, v: F.coalesce(v, F.lit("null"))))
        )
    return reduce(DataFrame.unionByName, parts)


def _read(spec: Claim, text: Column) -> tuple[Column, Column]:
    """(whether a text is this sentence, what it says): the inverse of ``claims_of``."""
    pieces = spec.pieces
    quote = lambda wording: re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", wording)
    names = pieces[1::2]
    pattern = "(?s)^" + quote(pieces[0])
    for name, wording in zip(names, pieces[2::2]):
        pattern += (_NUMBER if name in spec.numbers else "(.*?)") + quote(wording)
    pattern += "$"
    said = {name: F.regexp_extract(text, pattern, i + 1) for i, name in enumerate(names)}
    pack = lambda chosen: (
        F.create_map(*[x for k in chosen for x in (F.lit(k), said[k])]) if chosen else F.create_map().cast("map<string,string>")
    )
    subject = F.concat_ws(_JOINED, *[said[s] for s in spec.subject])
    found = F.struct(
        F.lit(spec.metric).alias("metric"),
        subject.alias("subject"),
        pack([n for n in names if n in spec.numbers]).alias("numbers"),
        pack([n for n in names if n in spec.labels and n not in spec.subject]).alias("labels"),
    )
    return text.rlike(pattern), found


def read_claims(df: DataFrame, text_col: str = "claim", name: str = "said") -> DataFrame:
    """Add ``name``: (metric, subject, numbers, labels) as text, NULL for texts that are no known sentence."""
    text = F.col(text_col)
    said = None
    for spec in CLAIMS:
        fits, found = _read(spec, text)
        said = F.when(fits, found) if said is None else said.when(fits, found)
    return df.withColumn(name, said)


def _within(shown: Column, value: Column) -> Column:
    """Whether a number could have been written as ``shown``: it lies within half a unit of the last digit."""
    digits = F.length(F.regexp_extract(shown, r"\.([0-9]+)", 1))
    power = F.coalesce(F.regexp_extract(shown, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    half = F.pow(F.lit(10.0), power - digits) / 2
    number = shown.try_cast("double")
    near = F.abs(number - value) <= half * (1 + 1e-9) + F.abs(value) * 1e-12
    same = number.eqNullSafe(value)  # None, NaN and infinities
    return same | F.coalesce(near, F.lit(False))


def check_numbers(df: DataFrame, known: DataFrame, text_col: str = "claim", by: Sequence[str] = ()) -> DataFrame:
    """Add ``checked`` and ``mismatch``: known sentences are compared with ``facts``, number by number and word by word.

    ``mismatch`` tells the first fact that differs, or that nothing is known of the subject; texts that are no known
    sentence are not checked. One row per metric and subject (and segment) of ``known`` meets the texts, by broadcast
    while those rows are few.
    """
    # one key, whose missing parts compare as equal
    key = lambda metric, subject: F.struct(*[quoted(c) for c in by], metric.alias("metric"), subject.alias("subject"))
    rows = read_claims(df, text_col, "__said")
    rows = rows.withColumn("__key", key(F.col("__said.metric"), F.col("__said.subject")))
    # a subject that is there twice, as with repeated names, is known by the facts of one
    table = known.groupBy(key(F.col("metric"), F.col("subject")).alias("__key")).agg(
        F.first("numbers").alias("__numbers"), F.first("labels").alias("__labels"), F.lit(True).alias("__known")
    )
    joined = attach(rows, table, ["__key"], "left")
    number = lambda e: F.try_element_at("__numbers", e["key"])
    label = lambda e: F.try_element_at("__labels", e["key"])
    wrong = F.filter(F.map_entries("__said.numbers"), lambda e: ~_within(e["value"], number(e)))
    other = F.filter(F.map_entries("__said.labels"), lambda e: ~e["value"].eqNullSafe(label(e)))
    text = lambda c: F.coalesce(c, F.lit("None"))
    first = F.get(wrong, F.lit(0))
    word = F.get(other, F.lit(0))
    mismatch = (
        F.when(F.col("__said").isNull(), None)
        .when(F.col("__known").isNull(), K.REASON_NO_EVIDENCE)
        .when(F.size(wrong) > 0, F.format_string(K.REASON_NUMBER, first["key"], first["value"], text(plain_number(number(first)))))
        .when(F.size(other) > 0, F.format_string(K.REASON_LABEL, word["key"], word["value"], text(label(word))))
    )
    out = joined.withColumns({"checked": F.col("__said").isNotNull(), "mismatch": mismatch})
    return out.select(*[quoted(c) for c in df.columns], "checked", "mismatch")


def gate_numbers(df: DataFrame, known: DataFrame, text_col: str = "claim", by: Sequence[str] = ()) -> DataFrame:
    """The rule gate's ``status`` and ``failure_reason`` with the check of numbers as its last rule."""
    checked = check_numbers(df, known, text_col, by)
    reason = F.coalesce("failure_reason", "mismatch")
    return checked.withColumn("failure_reason", reason).withColumn(
        "status", F.when(reason.isNull(), "supported").otherwise("unsupported")
    ).drop("mismatch")


# --- gate -----------------------------------------------------------------------------------------------
def gate(
    df: DataFrame,
    text_col: str,
    missing_pct: str | Column | None = None,
    p_adj: str | Column | None = None,
    is_normal: str | Column | None = None,
) -> DataFrame:
    """Add ``status`` and ``failure_reason``: the first broken rule rejects a text, the rest are supported.

    Works on any table with a text column; the numbers a rule needs come from the named columns.
    """

    def given(c: str | Column | None, kind: str) -> Column:
        if c is None:
            return F.lit(None).cast(kind)
        return (F.col(c) if isinstance(c, str) else c).cast(kind)

    pct, p, normal = given(missing_pct, "double"), given(p_adj, "double"), given(is_normal, "boolean")
    text = F.col(text_col)
    low = F.lower(text)

    def says(*words: str) -> Column:
        return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])

    exaggerated = says("missing") & (pct < 5.0) & says(*K.EXAGGERATIONS)
    insignificant = says("statistically significant") & (p >= 0.05)
    not_normal = says("complies with normal distribution", "is normally distributed") & ~F.coalesce(
        normal, F.lit(False)
    )
    baseless = says("anomaly") & ~says("outlier", "imbalance", "simpson")
    reason = (
        F.when(text.rlike(K.CAUSAL_PATTERN), K.REASON_CAUSAL)
        .when(exaggerated, F.format_string(K.REASON_SEVERITY, plain_number(pct)))
        .when(insignificant, F.format_string(K.REASON_SIGNIFICANCE, plain_number(p)))
        .when(not_normal, K.REASON_NORMALITY)
        .when(says("drop") & says("missing"), K.REASON_DROP)
        .when(baseless, K.REASON_ANOMALY)
    )
    return df.withColumn("failure_reason", reason).withColumn(
        "status", F.when(F.col("failure_reason").isNull(), "supported").otherwise("unsupported")
    )


def gate_claims(claims: DataFrame) -> DataFrame:
    """The gate with the numbers of each claim's own evidence."""
    return gate(
        claims.drop("status"), "claim", "evidence.missing_pct", "evidence.p_adj", "evidence.is_normal"
    )


def gate_counts(gated: DataFrame) -> DataFrame:
    """``(status, n)``."""
    return gated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
