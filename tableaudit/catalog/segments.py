"""Evidence by segment, and texts checked against evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import claims as C
from ..operators.distribution import categorical_profile, numeric_profile
from ..operators.quality import column_quality, table_quality
from ..operators.relations import correlations, simpsons
from ..operators.target import class_balance, class_distribution
from ..plans.materialise import materialise
from .common import DOCS_LABELS, docs_labels, steady, steady_sql, student_p_sql, table, union_all
from .distribution import _PROFILE, profile_sql
from .quality import _MESSY_ORDERS, _NORM, _column_quality_sql, _messy_orders, _score_sql
from .relations import _REVERSING, _reversing, _simpson_sql
from .text import _DUPLICATE_TEXT, _MISSING_TEXT, _QUASI_TEXT, _SCORE_TEXT

#: every third supplier is one segment, which holds a third of all rows; return flags are the others
_HOT = "CASE WHEN l_suppkey % 3 = 0 THEN 'hot' ELSE l_returnflag END"
_LINE_SEGMENTS = ("'hot'", "'A'", "'N'", "'R'")
_LINES = f"SELECT {_HOT} AS segment, l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount, l_tax FROM lineitem"
#: means of two neighbouring values, whose last digit may be exactly between two roundings
_MIDDLE = ("q25", "median", "q75", "iqr", "mad")
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LANGS = ("'en'", "'de'", "'fr'", "'es'", "NULL")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.expr(_HOT).alias("segment"),
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        "l_tax",
    )


def _docs(spark, sf_dir):
    """Labelled documents whose language is unknown for every seventh."""
    return (
        docs_labels(spark, sf_dir)
        .withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
        .withColumn("length_class", F.when(F.col("n_chars") > 20000, "book").otherwise("text"))
    )


_DOCS = (
    "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, source, n_chars, quality, toxic, "
    f"CASE WHEN n_chars > 20000 THEN 'book' ELSE 'text' END AS length_class FROM ({DOCS_LABELS})"
)
_DOC_COLUMNS = ["doc_id", "source", "n_chars", "quality", "toxic", "length_class"]


def _each(source: str, name: str, values: tuple[str, ...], sql) -> str:
    """``sql`` of the rows of every segment, with the segment; segments without rows are left out."""
    return union_all(
        [
            f"SELECT {v}::VARCHAR AS {name}, * FROM ({sql(f'SELECT * FROM ({source}) WHERE {name} IS NOT DISTINCT FROM {v}')}) "
            f"WHERE EXISTS (SELECT 1 FROM ({source}) WHERE {name} IS NOT DISTINCT FROM {v})"
            for v in values
        ]
    )


def segment_quality(spark, sf_dir):
    """Column quality of labelled documents in every language, the unknown one too."""
    return column_quality(_docs(spark, sf_dir), by=["lang"]).withColumn("sentinels", F.array_join("sentinels", ", "))


_QUALITY_SQL = _each(
    _DOCS, "lang", _LANGS, lambda s: _column_quality_sql(s, _DOC_COLUMNS, {"doc_id", "n_chars", "quality", "toxic"})
)

def segment_scores(spark, sf_dir):
    """Duplicates, score and grade of messy orders by priority."""
    return table_quality(_messy_orders(spark, sf_dir).withColumn("priority", F.trim("priority")).drop("amount"), by=["priority"])


def _scores_sql() -> str:
    columns = ["status", "band", "weight"]
    source = f"SELECT {', '.join(columns)}, trim(priority, ' ') AS priority FROM ({_MESSY_ORDERS})"

    def one(s: str) -> str:
        negative = " + ".join(f"(SELECT (min({c}) < 0)::INTEGER FROM ({s}))" for c in ("band", "weight"))
        forms = f"SELECT {_NORM} AS k FROM (SELECT status AS v FROM ({s})) GROUP BY k HAVING count(DISTINCT v) > 1"
        return _score_sql(s, columns, f"({negative})", f"(SELECT (count(*) > 0)::INTEGER FROM ({forms}))")

    plain = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
    names = ("'?'", *(f"'{p}'" for p in plain), *(f"'{p}' || chr(9)" for p in plain))
    return _each(source, "priority", names, one)


def segment_profile(spark, sf_dir):
    """All distribution statistics of line items by segment, one of them with a third of all rows."""
    out = numeric_profile(_lines(spark, sf_dir), by=["segment"])
    return out.select(
        "segment",
        "column",
        "n",
        *[steady(F.col(c)).alias(c) for c in _PROFILE if c not in (*_MIDDLE, "skewness", "kurtosis")],
        *[F.when(F.col(c) >= 1e4, F.round(c, 1)).otherwise(F.round(c, 4)).alias(c) for c in _MIDDLE],
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


_COARSE = ", ".join(f"CASE WHEN {c} >= 1e4 THEN round({c}, 1) ELSE {c} END AS {c}" for c in _MIDDLE)
_PROFILE_SQL = (
    f"SELECT * REPLACE ({_COARSE}) FROM "
    f"({_each(_LINES, 'segment', _LINE_SEGMENTS, lambda s: profile_sql(s, _MEASURES))})"
)


def segment_categories(spark, sf_dir):
    """The three most frequent values of every text column of documents, by toxicity label."""
    return categorical_profile(docs_labels(spark, sf_dir).select("toxic", "lang", "source"), top=3, by=["toxic"])


_CATEGORIES_SQL = (
    "SELECT toxic, CASE c WHEN 'lang' THEN 0 ELSE 1 END AS position, c AS \"column\", nunique, round(nunique / total, 4) AS unique_ratio, "
    "place::INTEGER AS place, v AS value, n, round(n * 100.0 / total, 2) AS pct FROM (SELECT *, count(*) OVER w AS nunique, "
    "(sum(n) OVER w)::BIGINT AS total, row_number() OVER (PARTITION BY toxic, c ORDER BY n DESC, v) AS place FROM "
    "(SELECT toxic, c, v, count(*) AS n FROM (SELECT toxic, unnest(['lang', 'source']) AS c, unnest([lang, source]) AS v "
    f"FROM ({DOCS_LABELS})) WHERE v IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY toxic, c)) WHERE place <= 3"
)


def segment_correlations(spark, sf_dir):
    """A rank correlation family of line items in every segment, with gaps."""
    return correlations(_lines(spark, sf_dir), by=["segment"])


def _correlations_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]]
    ranked = union_all(
        [
            f"SELECT {i} AS position, '{a}' AS col1, '{b}' AS col2, segment, "
            f"rank() OVER (PARTITION BY segment ORDER BY {a}) + (count(*) OVER (PARTITION BY segment, {a}) - 1) / 2.0 AS ra, "
            f"rank() OVER (PARTITION BY segment ORDER BY {b}) + (count(*) OVER (PARTITION BY segment, {b}) - 1) / 2.0 AS rb "
            f"FROM ({_LINES}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            for i, (a, b) in enumerate(pairs)
        ]
    )
    tests = f"SELECT segment, position, col1, col2, count(*) AS n_eff, corr(ra, rb) AS r FROM ({ranked}) GROUP BY ALL"
    p = student_p_sql("abs(r) * sqrt((n_eff - 2) / (1.0 - r * r))", "n_eff - 2")
    raised = (
        "SELECT *, raw_p * count(*) OVER (PARTITION BY segment) / row_number() OVER (PARTITION BY segment ORDER BY raw_p, position) AS q "
        f"FROM (SELECT *, {p} AS raw_p FROM ({tests}))"
    )
    adjusted = (
        "SELECT *, round(least(1.0, min(q) OVER (PARTITION BY segment ORDER BY raw_p DESC, position DESC "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS p_adj FROM ({raised})"
    )
    return (
        f"SELECT segment, position, col1 || ' & ' || col2 AS pair, col1, col2, '{K.SPEARMAN}' AS method, round(r, 4) AS corr, "
        "round(raw_p, 4) AS raw_p_value, n_eff, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END "
        f"AS strength, p_adj, p_adj < 0.05 AS is_significant FROM ({adjusted})"
    )


def segment_reversals(spark, sf_dir):
    """Correlations that change sign by line status, inside every return flag."""
    return simpsons(_reversing(spark, sf_dir), by=["l_returnflag"])


def segment_classes(spark, sf_dir):
    """Toxic and other documents in every source."""
    return class_distribution(docs_labels(spark, sf_dir), "toxic", by=["source"])


def segment_balance(spark, sf_dir):
    return class_balance(docs_labels(spark, sf_dir), "toxic", by=["source"])


_CLASSES_SQL = f"SELECT source, toxic::VARCHAR AS class, count(*) AS n FROM ({DOCS_LABELS}) WHERE toxic IS NOT NULL GROUP BY ALL"
_BALANCE_SQL = (
    "SELECT *, CASE WHEN imbalance_ratio < 0.2 THEN 'severe' WHEN imbalance_ratio < 0.5 THEN 'moderate' ELSE 'balanced' END AS imbalance_severity "
    "FROM (SELECT source, count(*) AS classes, min(n) AS min_count, max(n) AS max_count, "
    f"CASE WHEN count(*) > 1 THEN round(min(n) / max(n), 4) END AS imbalance_ratio FROM ({_CLASSES_SQL}) GROUP BY source)"
)


def segment_claims(spark, sf_dir):
    """Quality claims of every language, numbered in each, with their evidence and the gate's decision."""
    docs = _docs(spark, sf_dir)
    columns, whole = column_quality(docs, by=["lang"]), table_quality(docs, by=["lang"])
    claims = C.number_claims(
        C.missing_claims(columns, ["lang"]),
        C.duplicate_claims(whole, ["lang"]),
        C.quasi_constant_claims(columns, ["lang"]),
        C.score_claims(whole, ["lang"]),
        by=["lang"],
    )
    shown = [F.col(f"evidence.{c}").alias(c) for c in ("metric", "column", "n", "missing_pct", "severity", "statistic", "detail")]
    return C.gate_claims(claims).select("lang", "claim_id", "category", "claim", *shown, "confidence", "status")


def _segment_tables() -> tuple[str, str]:
    return (
        _QUALITY_SQL,
        _each(_DOCS, "lang", _LANGS, lambda s: _score_sql(s, _DOC_COLUMNS, "0", "0")),
    )


def _claims_sql() -> str:
    columns, whole = "SELECT * FROM columns_known", "SELECT * FROM whole_known"
    known = "WITH columns_known AS MATERIALIZED ({}), whole_known AS MATERIALIZED ({}) ".format(*_segment_tables())
    none = {"column": "NULL", "n": "NULL", "missing_pct": "NULL", "severity": "NULL", "statistic": "NULL", "detail": "NULL"}

    def part(template, metric, order, text, source, **evidence):
        cells = ", ".join(f'{v} AS "e_{k}"' for k, v in (none | evidence).items())
        return f"SELECT lang, {template} AS template, {order} AS o, '{metric}' AS metric, {text} AS claim, {cells} FROM ({source})"

    rows = union_all(
        [
            part(1, "missingness", "position", _MISSING_TEXT, f"SELECT * FROM ({columns}) WHERE null_count > 0",
                 column='"column"', n="null_count", missing_pct="missing_pct", severity="severity"),
            part(2, "duplicates", "0", _DUPLICATE_TEXT, whole, n="duplicate_rows", statistic="duplicate_pct", severity="duplicate_severity"),
            part(4, "quasi_constant", "position", _QUASI_TEXT, f"SELECT * FROM ({columns}) WHERE is_quasi_constant",
                 column='"column"', statistic="top_pct", detail="top_value"),
            part(6, "quality_score", "0", _SCORE_TEXT, whole, statistic="overall_score", detail="grade"),
        ]
    )
    return known + (
        "SELECT lang, 'claim_' || row_number() OVER (PARTITION BY lang ORDER BY template, o) AS claim_id, 'quality' AS category, claim, metric, "
        'e_column AS "column", e_n::BIGINT AS n, e_missing_pct::DOUBLE AS missing_pct, e_severity AS severity, e_statistic::DOUBLE AS statistic, '
        f"e_detail AS detail, 'high' AS confidence, 'supported' AS status FROM ({rows})"
    )


# --- numbers of texts against evidence -------------------------------------------------------------------------
def checked_claims(spark, sf_dir):
    """Right and altered quality claims of labelled documents by language, each with what differs from the evidence."""
    docs = _docs(spark, sf_dir)
    columns, whole = materialise(column_quality(docs, by=["lang"])), materialise(table_quality(docs, by=["lang"]))
    known = C.facts({"column_quality": columns, "table_quality": whole}, ["lang"])
    altered = {
        "right": columns,
        "one row more": columns.withColumn("null_count", F.col("null_count") + 1),
        "other share": columns.withColumn("missing_pct", F.round(F.col("missing_pct") + 0.5, 4)),
        "other severity": columns.withColumn("severity", F.concat(F.lit("not "), F.col("severity"))),
        "other column": columns.withColumn("column", F.concat(F.col("column"), F.lit("_x"))),
    }
    parts = [C.missing_claims(t, ["lang"]).select("lang", F.lit(k).alias("kind"), "claim") for k, t in altered.items()]
    parts += [
        C.duplicate_claims(whole, ["lang"]).select("lang", F.lit("right").alias("kind"), "claim"),
        C.score_claims(whole, ["lang"]).select("lang", F.lit("right").alias("kind"), "claim"),
        C.score_claims(whole.withColumn("overall_score", F.round(F.col("overall_score") - 1, 1)), ["lang"]).select(
            "lang", F.lit("other score").alias("kind"), "claim"
        ),
        whole.select("lang", F.lit("free text").alias("kind"), F.lit("Most documents are short.").alias("claim")),
    ]
    texts = parts[0]
    for part in parts[1:]:
        texts = texts.unionByName(part)
    gated = C.gate_numbers(C.gate(texts, "claim"), known, by=["lang"])
    return gated.select("lang", "kind", "claim", "checked", "status", "failure_reason")


def _checked_sql() -> str:
    columns, whole = "SELECT * FROM columns_known", "SELECT * FROM whole_known"
    missing = f"SELECT * FROM ({columns}) WHERE null_count > 0"

    def part(kind: str, text: str, source: str, reason: str = "NULL", checked: str = "true") -> str:
        return (
            f"SELECT lang, '{kind}' AS kind, {text} AS claim, {checked} AS checked, "
            f"CASE WHEN {reason} IS NULL THEN 'supported' ELSE 'unsupported' END AS status, {reason} AS failure_reason FROM ({source})"
        )

    number = "'Numeric Mismatch: {0} is ' || {1} || ' in the text and ' || {2} || ' in the evidence.'"
    more = "SELECT * REPLACE (null_count + 1 AS null_count), null_count AS was FROM ({0}) WHERE null_count >= 0"
    none = "SELECT * FROM ({0}) WHERE null_count > 0"
    known = "WITH columns_known AS MATERIALIZED ({}), whole_known AS MATERIALIZED ({}) ".format(*_segment_tables())
    return known + union_all(
        [
            part("right", _MISSING_TEXT, missing),
            part("one row more", _MISSING_TEXT, more.format(columns), number.format("null_count", "null_count", "was::DOUBLE")),
            part("other share", _MISSING_TEXT, f"SELECT * REPLACE (round(missing_pct + 0.5, 4) AS missing_pct), missing_pct AS was FROM ({missing})",
                 number.format("missing_pct", "missing_pct", "was")),
            part("other severity", _MISSING_TEXT, f"SELECT * REPLACE ('not ' || severity AS severity), severity AS was FROM ({missing})",
                 "'Label Mismatch: severity is ''' || severity || ''' in the text and ''' || was || ''' in the evidence.'"),
            part("other column", _MISSING_TEXT, f"SELECT * REPLACE (\"column\" || '_x' AS \"column\") FROM ({missing})", f"'{K.REASON_NO_EVIDENCE}'"),
            part("right", _DUPLICATE_TEXT, whole),
            part("right", _SCORE_TEXT, whole),
            part("other score", _SCORE_TEXT, f"SELECT * REPLACE (round(overall_score - 1, 1) AS overall_score), overall_score AS was FROM ({whole})",
                 number.format("overall_score", "overall_score", "was")),
            part("free text", "'Most documents are short.'", none.format(f"SELECT *, 1 AS null_count FROM ({whole})"), checked="false"),
        ]
    )


QUERIES = {
    "segment_quality": (segment_quality, _QUALITY_SQL),
    "segment_scores": (segment_scores, _scores_sql()),
    "segment_profile": (segment_profile, _PROFILE_SQL),
    "segment_categories": (segment_categories, _CATEGORIES_SQL),
    "segment_correlations": (segment_correlations, _correlations_sql()),
    "segment_reversals": (
        segment_reversals,
        _each(
            _REVERSING, "l_returnflag", ("'A'", "'N'", "'R'"),
            lambda s: _simpson_sql(s, ["level", "rate", "l_tax"], ["l_linestatus"], None, 0.2, 0.15),
        ),
    ),
    "segment_classes": (segment_classes, _CLASSES_SQL),
    "segment_balance": (segment_balance, _BALANCE_SQL),
    "segment_claims": (segment_claims, _claims_sql()),
    "checked_claims": (checked_claims, _checked_sql()),
}
