"""Text claims from evidence, and the rule gate over tables of claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..audit import audit
from ..functions import constants as K
from ..operators import claims as C
from ..operators.distribution import numeric_profile
from ..operators.pii import detect_pii
from ..operators.quality import column_quality, table_quality
from ..operators.relations import correlations, group_tests, redundant_pairs, simpsons
from ..operators.target import class_balance, class_distribution, leakage
from .common import DOCS_LABELS, PRICED_LINEITEM, docs_labels, priced_lineitem, table, union_all
from .distribution import profile_sql
from .quality import _QUALITY_SOURCE, _column_quality_sql, _contacts, _pii_sql, _score_sql
from .relations import (
    _PRICED,
    _REVERSING,
    _STATUS_GROUPS,
    _family_sql,
    _group_family,
    _pearson_tests,
    _reversing,
    _simpson_sql,
    _spearman_tests,
)
from .target import _leakage_sql

# The wording of claims, as SQL expressions.
# fmt: off
_MISSING_TEXT = "'Column ''' || \"column\" || ''' has ' || missing_pct || '% missing values (' || null_count || ' rows), categorized as ' || severity || ' severity.'"
_DUPLICATE_TEXT = "'Dataset contains ' || duplicate_rows || ' duplicate rows (' || duplicate_pct || '%), representing a ' || duplicate_severity || ' uniqueness concern.'"
_CONSTANT_TEXT = "'Feature ''' || \"column\" || ''' is a zero-variance constant column with 1 unique value across all rows.'"
_QUASI_TEXT = "'Feature ''' || \"column\" || ''' is quasi-constant, with value ''' || top_value || ''' accounting for ' || top_pct || '% of observations.'"
_SCORE_TEXT = "'Overall Data Quality Score is ' || overall_score || '/100 with Grade ' || grade || '.'"
_SHAPE_TEXT = "'Numeric feature ''' || \"column\" || ''' exhibits mean=' || mean || ', median=' || median || ', skewness=' || skewness || ' (' || skewness_severity || ').'"
_NORMAL_TEXT = "'Numeric feature ''' || \"column\" || ''' ' || CASE WHEN is_normal THEN 'complies with' ELSE 'departs from' END || ' normal distribution assumptions per ' || test_used || ' (p=' || normality_p || ').'"
_OUTLIER_TEXT = "'Feature ''' || \"column\" || ''' contains ' || total_outliers || ' outliers (' || outlier_pct || '%), representing a ' || outlier_severity || ' outlier presence.'"
_REVERSAL_TEXT = "'Simpson''s Paradox detected between ''' || feature_x || ''' and ''' || feature_y || ''': overall correlation (r=' || overall_corr || ') reverses direction when conditioned on subgroup ''' || group_var || '''.'"
_PAIR_TEXT = "'Pairwise correlation between ' || pair || ' is statistically significant (' || method || ', r=' || corr || ', FDR p_adj=' || p_adj || ').'"
_REDUNDANT_TEXT = "'Features ''' || col1 || ''' and ''' || col2 || ''' exhibit high feature redundancy with correlation r=' || round(abs(r), 4) || '.'"
_BALANCE_TEXT = "'Target variable exhibits a class distribution of ' || listed || ' with a minority/majority imbalance ratio of ' || ratio || ' (' || sev || ' imbalance).'"
_LEAKAGE_TEXT = "'Data leakage warning: Column ''' || \"column\" || ''' has near-perfect correlation (r=' || correlation || ') with the target variable.'"
# fmt: on

_SHOWN = ["claim_id", "category", "claim", "status"]


def _numbered_sql(parts: list[tuple[int, str, str, str, str]]) -> str:
    """From (template, category, order, text, source) to numbered claims."""
    rows = [
        f"SELECT {t} AS template, '{category}' AS category, {order} AS o, {text} AS claim FROM ({source})"
        for t, category, order, text, source in parts
    ]
    return (
        "SELECT 'claim_' || row_number() OVER (ORDER BY template, o) AS claim_id, category, claim, 'supported' AS status "
        f"FROM ({union_all(rows)})"
    )


def quality_claims(spark, sf_dir):
    """Missing-value, duplicate, constant, near-constant and score claims of labelled documents."""
    df = docs_labels(spark, sf_dir).withColumns(
        {"edition": F.lit("first"), "length_class": F.when(F.col("n_chars") > 20000, "book").otherwise("text")}
    )
    columns, whole = column_quality(df), table_quality(df)
    claims = C.number_claims(
        C.missing_claims(columns),
        C.duplicate_claims(whole),
        C.constant_claims(columns),
        C.quasi_constant_claims(columns),
        C.score_claims(whole),
    )
    return C.gate_claims(claims).select(*_SHOWN)


_QUALITY_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic", "edition", "length_class"]
_COLUMNS_SQL = _column_quality_sql(_QUALITY_SOURCE, _QUALITY_COLUMNS, {"doc_id", "n_chars", "quality", "toxic"})
_TABLE_SQL = _score_sql(_QUALITY_SOURCE, _QUALITY_COLUMNS, "0", "0")

_QUALITY_CLAIMS = _numbered_sql(
    [
        (1, "quality", "position", _MISSING_TEXT,
         f"SELECT * FROM ({_COLUMNS_SQL}) WHERE null_count > 0"),
        (2, "quality", "0", _DUPLICATE_TEXT, _TABLE_SQL),
        (3, "quality", "position", _CONSTANT_TEXT,
         f"SELECT * FROM ({_COLUMNS_SQL}) WHERE is_constant"),
        (4, "quality", "position", _QUASI_TEXT,
         f"SELECT * FROM ({_COLUMNS_SQL}) WHERE is_quasi_constant"),
        (6, "quality", "0", _SCORE_TEXT, _TABLE_SQL),
    ]
)


def pii_claims(spark, sf_dir):
    contacts = _contacts(spark, sf_dir)
    return C.gate_claims(C.number_claims(C.pii_claims(detect_pii(contacts)))).select(*_SHOWN)


_PII_CLAIMS = _numbered_sql(
    [(5, "quality", "position", "'Column ''' || \"column\" || ''' contains potential ' || type || ' PII with ' || confidence || ' confidence.'", _pii_sql())]
)


def distribution_claims(spark, sf_dir):
    """Shape, normality and outlier claims of events."""
    df = table(spark, sf_dir, "events").select("value", "user_id")
    return C.gate_claims(C.number_claims(C.distribution_claims(numeric_profile(df)))).select(*_SHOWN)


def _distribution_sql() -> str:
    source = profile_sql("events", ["value", "user_id"])
    order = "CASE \"column\" WHEN 'value' THEN 0 ELSE 3 END"
    return _numbered_sql(
        [
            (7, "distribution", order, _SHAPE_TEXT, source),
            (7, "distribution", f"1 + {order}", _NORMAL_TEXT, source),
            (7, "distribution", f"2 + {order}", _OUTLIER_TEXT,
             f"SELECT * FROM ({source}) WHERE total_outliers > 0"),
        ]
    )


def relationship_claims(spark, sf_dir):
    """Sign reversal, correlation, group test and redundancy claims."""
    df = _reversing(spark, sf_dir)
    priced = priced_lineitem(spark, sf_dir)
    claims = C.number_claims(
        C.simpson_claims(simpsons(df)),
        C.correlation_claims(correlations(df)),
        C.group_test_claims(group_tests(df)),
        C.redundancy_claims(redundant_pairs(priced)),
    )
    return C.gate_claims(claims).select(*_SHOWN)


def _relationship_sql() -> str:
    reversals = _simpson_sql(_REVERSING, ["level", "rate", "l_tax"], ["l_linestatus", "l_returnflag"], None, 0.2, 0.15)
    return _numbered_sql(
        [
            (10, "relationship", "finding", _REVERSAL_TEXT,
             f"SELECT DISTINCT finding, feature_x, feature_y, group_var, overall_corr FROM ({reversals})"),
            (11, "relationship", "position", _PAIR_TEXT,
             f"SELECT * FROM ({_family_sql(_spearman_tests(_REVERSING, ['level', 'rate', 'l_tax']))}) WHERE is_significant"),
            (12, "relationship", "position", "'Group difference test (' || test_name || ') on ' || variables || ' indicates a statistically significant difference (p_adj=' || p_adj || ', effect size ' || effect_size_type || '=' || effect_size || ').'",
             f"SELECT * FROM ({_group_family(_STATUS_GROUPS)}) WHERE is_significant"),
            (13, "relationship", "position", _REDUNDANT_TEXT,
             f"SELECT * FROM ({_pearson_tests(PRICED_LINEITEM, _PRICED)}) WHERE abs(r) > 0.9"),
        ]
    )


def _balance_sql(source: str, target: str) -> str:
    counts = f"SELECT CAST({target} AS VARCHAR) AS c, count(*) AS n FROM ({source}) WHERE {target} IS NOT NULL GROUP BY {target}"
    ratio = "round(min(n) * 1.0 / max(n), 4)"
    return (
        f"SELECT '{{' || string_agg('''' || c || ''': ' || n, ', ' ORDER BY n DESC, c) || '}}' AS listed, {ratio} AS ratio, "
        f"CASE WHEN {ratio} < 0.2 THEN 'severe' WHEN {ratio} < 0.5 THEN 'moderate' ELSE 'balanced' END AS sev FROM ({counts}) HAVING count(*) > 1"
    )


def anomaly_claims(spark, sf_dir):
    """Imbalance of a label and leakage into a money target."""
    docs, priced = docs_labels(spark, sf_dir), priced_lineitem(spark, sf_dir)
    claims = C.number_claims(
        C.balance_claims(class_distribution(docs, "toxic"), class_balance(docs, "toxic")),
        C.leakage_claims(leakage(priced, "revenue")),
    )
    return C.gate_claims(claims).select(*_SHOWN)


def _anomaly_sql() -> str:
    balance = _balance_sql(DOCS_LABELS, "toxic")
    return _numbered_sql(
        [
            (14, "anomaly", "0", _BALANCE_TEXT, balance),
            (15, "anomaly", "position", _LEAKAGE_TEXT,
             _leakage_sql(PRICED_LINEITEM, ["l_quantity", "l_extendedprice", "unit_price", "charge"], "revenue", 0.95)),
        ]
    )


def audited_orders(spark, sf_dir):
    """All claims of a whole audit of orders, every column included, gated."""
    return C.gate_claims(audit(table(spark, sf_dir, "orders"), target="o_orderstatus").claims()).select(*_SHOWN, "confidence")


def _audit_sql() -> str:
    source, numeric = "SELECT * FROM orders", ["o_orderkey", "o_custkey", "o_totalprice"]
    columns = _column_quality_sql(
        source, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], set(numeric)
    )
    score = _score_sql(source, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "0", "0")
    profile = profile_sql(source, numeric)
    centres = union_all(
        [f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median FROM orders" for c in numeric]
    )
    shapes = f"SELECT p.* REPLACE (m.mean AS mean, m.median AS median) FROM ({profile}) p JOIN ({centres}) m ON p.\"column\" = m.\"column\""
    at = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {3 * i}" for i, c in enumerate(numeric)) + " END"
    codes = f"SELECT *, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS code FROM ({source})"
    reversals = _simpson_sql(source, numeric, ["o_orderstatus", "o_orderpriority"], None, 0.2, 0.15)
    found = _numbered_sql(
        [
            (1, "quality", "position", _MISSING_TEXT, f"SELECT * FROM ({columns}) WHERE null_count > 0"),
            (2, "quality", "0", _DUPLICATE_TEXT, score),
            (3, "quality", "position", _CONSTANT_TEXT, f"SELECT * FROM ({columns}) WHERE is_constant"),
            (4, "quality", "position", _QUASI_TEXT, f"SELECT * FROM ({columns}) WHERE is_quasi_constant"),
            (6, "quality", "0", _SCORE_TEXT, score),
            (7, "distribution", at, _SHAPE_TEXT, shapes),
            (7, "distribution", f"1 + {at}", _NORMAL_TEXT, profile),
            (7, "distribution", f"2 + {at}", _OUTLIER_TEXT, f"SELECT * FROM ({profile}) WHERE total_outliers > 0"),
            (10, "relationship", "finding", _REVERSAL_TEXT, f"SELECT DISTINCT finding, feature_x, feature_y, group_var, overall_corr FROM ({reversals})"),
            (11, "relationship", "position", _PAIR_TEXT, f"SELECT * FROM ({_family_sql(_pearson_tests(source, numeric))}) WHERE is_significant"),
            (13, "relationship", "position", _REDUNDANT_TEXT, f"SELECT * FROM ({_pearson_tests(source, numeric)}) WHERE abs(r) > 0.9"),
            (14, "anomaly", "0", _BALANCE_TEXT, _balance_sql(source, "o_orderstatus")),
            (15, "anomaly", "position", _LEAKAGE_TEXT, _leakage_sql(codes, numeric, "code", 0.95)),
        ]
    )
    return f"SELECT *, 'high' AS confidence FROM ({found})"


# --- gate over a large table of claims -------------------------------------------------------------------------
def _order_claims(spark, sf_dir):
    """One written claim per order, worded by its status and priority, with the numbers it rests on."""
    price = F.col("o_totalprice")
    wording = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Price class causes late delivery")
        .when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "O"), "The field has CRITICAL missing values")
        .when(F.col("o_orderpriority") == "2-HIGH", "Drop the field because values are missing")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "The difference is statistically significant")
        .when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "F"), "The price is normally distributed")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "The price complies with normal distribution")
        .when(F.col("o_orderstatus") == "P", "The order is an anomaly")
        .otherwise("The order is an anomaly: an outlier")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        wording.alias("claim"),
        F.floor(price / 50000).cast("double").alias("pct"),
        F.when(price < 300000, F.floor(price / 30000) / 100).alias("p"),
        F.when(price > 100000, price > 250000).alias("normal"),
    )


def gated_orders(spark, sf_dir):
    """Status and reason of one claim per order."""
    return C.gate(_order_claims(spark, sf_dir), "claim", "pct", "p", "normal").select(
        "o_orderkey", "claim", "status", "failure_reason"
    )


def gate_totals(spark, sf_dir):
    return C.gate_counts(C.gate(_order_claims(spark, sf_dir), "claim", "pct", "p", "normal"))


def gated_documents(spark, sf_dir):
    """The gate over whole documents and conversation turns, without numbers."""
    texts = (
        table(spark, sf_dir, "documents")
        .select(F.lit("documents").alias("origin"), "text")
        .unionByName(table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), "text"))
    )
    gated = C.gate(texts, "text")
    return gated.groupBy("origin", "status", "failure_reason").agg(F.count(F.lit(1)).alias("n"))


_ORDER_CLAIMS = (
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Price class causes late delivery' "
    "WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 'The field has CRITICAL missing values' "
    "WHEN o_orderpriority = '2-HIGH' THEN 'Drop the field because values are missing' "
    "WHEN o_orderpriority = '3-MEDIUM' THEN 'The difference is statistically significant' "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'The price is normally distributed' "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'The price complies with normal distribution' "
    "WHEN o_orderstatus = 'P' THEN 'The order is an anomaly' ELSE 'The order is an anomaly: an outlier' END AS claim, "
    "floor(o_totalprice / 50000) AS pct, CASE WHEN o_totalprice < 300000 THEN floor(o_totalprice / 30000) / 100 END AS p, "
    "CASE WHEN o_totalprice > 100000 THEN o_totalprice > 250000 END AS normal FROM orders"
)


def _gate_sql(source: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    has = lambda *words: "(" + " OR ".join(f"contains(lower(claim), '{w}')" for w in words) + ")"
    reason = (
        r"CASE WHEN regexp_matches(claim, '(?i)\b(causes|caused|causation|drives|leads to|resulted in)\b') THEN "
        + quote(K.REASON_CAUSAL)
        + f" WHEN {has('missing')} AND pct < 5 AND {has(*K.EXAGGERATIONS)} THEN 'Severity Misclassification: ' || pct || "
        + quote("% missingness is low (<5%) and cannot be claimed as substantial/critical.")
        + f" WHEN {has('statistically significant')} AND p >= 0.05 THEN 'Unsupported Significance: p_adj=' || p || "
        + quote(" >= 0.05 does not reach statistical significance threshold.")
        + f" WHEN {has('complies with normal distribution', 'is normally distributed')} AND NOT coalesce(normal, false) THEN "
        + quote(K.REASON_NORMALITY)
        + f" WHEN {has('drop')} AND {has('missing')} THEN "
        + quote(K.REASON_DROP)
        + f" WHEN {has('anomaly')} AND NOT {has('outlier', 'imbalance', 'simpson')} THEN "
        + quote(K.REASON_ANOMALY)
        + " END"
    )
    return f"SELECT *, CASE WHEN failure_reason IS NULL THEN 'supported' ELSE 'unsupported' END AS status FROM (SELECT *, {reason} AS failure_reason FROM ({source}))"


_DOCUMENT_CLAIMS = (
    "SELECT 'documents' AS origin, text AS claim, NULL::DOUBLE AS pct, NULL::DOUBLE AS p, NULL::BOOLEAN AS normal FROM documents "
    "UNION ALL SELECT 'conversations', text, NULL, NULL, NULL FROM conversations"
)

QUERIES = {
    "quality_claims": (quality_claims, _QUALITY_CLAIMS),
    "pii_claims": (pii_claims, _PII_CLAIMS),
    "distribution_claims": (distribution_claims, _distribution_sql()),
    "relationship_claims": (relationship_claims, _relationship_sql()),
    "anomaly_claims": (anomaly_claims, _anomaly_sql()),
    "audited_orders": (audited_orders, _audit_sql()),
    "gated_orders": (gated_orders, f"SELECT o_orderkey, claim, status, failure_reason FROM ({_gate_sql(_ORDER_CLAIMS)})"),
    "gate_totals": (gate_totals, f"SELECT status, count(*) AS n FROM ({_gate_sql(_ORDER_CLAIMS)}) GROUP BY status"),
    "gated_documents": (
        gated_documents,
        f"SELECT origin, status, failure_reason, count(*) AS n FROM ({_gate_sql(_DOCUMENT_CLAIMS)}) GROUP BY ALL",
    ),
}
