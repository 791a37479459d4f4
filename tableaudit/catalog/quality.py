"""Missing values, duplicates, constants, placeholders, variants, score and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.pii import detect_pii, mask_pii, pii_matches
from ..operators.quality import (
    category_variants,
    column_quality,
    duplicates,
    missing_values,
    sentinel_values,
    table_quality,
)
from .common import DOCS_LABELS, GAPPY_LINEITEM, docs_labels, gappy_lineitem, table, union_all

_DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


def _severity(pct: str) -> str:
    return (
        f"CASE WHEN {pct} >= 40 THEN 'critical' WHEN {pct} >= 20 THEN 'high' WHEN {pct} >= 5 THEN 'moderate' "
        "ELSE 'low' END"
    )


def docs_column_quality(spark, sf_dir):
    """Column quality of documents with their labels, plus a constant and a near-constant column."""
    df = docs_labels(spark, sf_dir).withColumns(
        {
            "edition": F.lit("first"),
            "length_class": F.when(F.col("n_chars") > 20000, "book").otherwise("text"),
        }
    )
    return column_quality(df).withColumn("sentinels", F.array_join("sentinels", ", "))


_QUALITY_SOURCE = (
    f"SELECT *, 'first' AS edition, CASE WHEN n_chars > 20000 THEN 'book' ELSE 'text' END AS length_class FROM ({DOCS_LABELS})"
)


def _column_quality_sql(source: str, columns: list[str], numeric: set[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        pct = f"round((count(*) - count({c})) * 100.0 / count(*), 4)"
        top = f"SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM ({source}) WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k DESC, v LIMIT 1"
        share = f"(SELECT k FROM ({top})) * 100.0 / count({c})"
        quasi = f"({share} >= 95 AND count(DISTINCT {c}) > 1)"
        negative = f"coalesce(min({c}) < 0, false)" if c in numeric else "false"
        words = ", ".join(f"'{w}'" for w in K.SENTINELS)
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS total_rows, count(*) - count({c}) AS null_count, "
            f"{pct} AS missing_pct, count(DISTINCT {c}) = 1 AS is_constant, {quasi} AS is_quasi_constant, "
            f"CASE WHEN {quasi} THEN (SELECT v FROM ({top})) END AS top_value, "
            f"CASE WHEN {quasi} THEN round({share}, 2) END AS top_pct, {negative} AS has_negative, "
            f"coalesce(string_agg(DISTINCT CASE WHEN trim(CAST({c} AS VARCHAR)) IN ({words}) THEN trim(CAST({c} AS VARCHAR)) END, ', ' ORDER BY CASE WHEN trim(CAST({c} AS VARCHAR)) IN ({words}) THEN trim(CAST({c} AS VARCHAR)) END), '') AS sentinels, "
            f"{_severity(pct)} AS severity FROM ({source})"
        )
    return union_all(parts)


def legacy_missing(spark, sf_dir):
    return missing_values(gappy_lineitem(spark, sf_dir), labels="legacy")


def _legacy_sql() -> str:
    parts = []
    for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]):
        pct = f"round((count(*) - count({c})) * 100.0 / count(*), 2)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS total_rows, count(*) - count({c}) AS null_count, "
            f"{pct} AS missing_pct, CASE WHEN {pct} > 40 THEN 'HIGH (>40%)' WHEN {pct} >= 1 THEN 'MODERATE (1-40%)' "
            f"ELSE 'LOW (<1%)' END AS severity FROM ({GAPPY_LINEITEM})"
        )
    return union_all(parts)


def duplicate_lines(spark, sf_dir):
    """Duplicate rows of line items seen through seven columns."""
    names = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
    return duplicates(table(spark, sf_dir, "lineitem").select(*names))


def duplicate_documents(spark, sf_dir):
    """Documents with the same text, language and source, compared by whole text."""
    return duplicates(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def _duplicates_sql(source: str, columns: str) -> str:
    pct = "round(coalesce(sum(n - 1), 0) * 100.0 / sum(n), 4)"
    return (
        f"SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, "
        f"{pct} AS duplicate_pct, CASE WHEN {pct} >= 10 THEN 'high' WHEN {pct} >= 2 THEN 'moderate' ELSE 'low' END "
        f"AS duplicate_severity FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns})"
    )


def _messy_orders(spark, sf_dir):
    """Orders with spelling variants of the status, padded priorities, refunds and placeholders."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_totalprice") > 200000, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " ?")
        .when(F.col("o_totalprice") < 50000, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("\t")))
        .otherwise(F.col("o_orderpriority"))
        .alias("priority"),
        F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_totalprice") < 10000, F.lit(-999)).otherwise(F.floor(F.col("o_totalprice") / 10000)).cast("int").alias("band"),
        F.when(F.col("o_totalprice") > 450000, F.lit(-999.0)).otherwise(F.lit(1.0)).alias("weight"),
    )


_MESSY_ORDERS = (
    "SELECT CASE WHEN o_totalprice > 200000 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status, "
    "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' ?' WHEN o_totalprice < 50000 THEN "
    "' ' || o_orderpriority || chr(9) ELSE o_orderpriority END AS priority, "
    "CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount, "
    "CASE WHEN o_totalprice < 10000 THEN -999 ELSE CAST(floor(o_totalprice / 10000) AS INTEGER) END AS band, "
    "CASE WHEN o_totalprice > 450000 THEN -999.0 ELSE 1.0 END AS weight FROM orders"
)

_NORM = "lower(trim(v, chr(9) || chr(10) || chr(13) || ' '))"


def variants(spark, sf_dir):
    return category_variants(_messy_orders(spark, sf_dir))


def _variants_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", {_NORM} AS normalised, v AS variant, count(*) AS n FROM "
        f"(SELECT {c} AS v FROM ({_MESSY_ORDERS})) GROUP BY v"
        for c in ("status", "priority")
    ]
    return (
        f"SELECT * FROM ({union_all(parts)}) QUALIFY count(*) OVER (PARTITION BY \"column\", normalised) > 1"
    )


def sentinels(spark, sf_dir):
    found = sentinel_values(_messy_orders(spark, sf_dir))
    return found.select("position", "column", F.array_join("sentinels", ", ").alias("sentinels"))


def order_score(spark, sf_dir):
    return table_quality(_messy_orders(spark, sf_dir))


def docs_score(spark, sf_dir):
    return table_quality(docs_labels(spark, sf_dir))


def _score_sql(source: str, columns: list[str], negatives: str, variant_columns: str) -> str:
    k = len(columns)
    nulls = " + ".join(f"(count(*) - count({c}))" for c in columns)
    score = (
        f"round(0.4 * (100.0 * (1.0 - total_nulls / (total_rows * {k}.0))) + 0.2 * (100.0 * (1.0 - duplicate_rows * 1.0 / total_rows)) "
        f"+ 0.2 * (100.0 * (1.0 - negative_columns / {k}.0)) + 0.2 * (100.0 * (1.0 - variant_columns / {k}.0)), 1)"
    )
    dup = "round(duplicate_rows * 100.0 / total_rows, 4)"
    base = (
        f"SELECT count(*) AS total_rows, {nulls} AS total_nulls, "
        f"(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM ({source}) GROUP BY ALL)) AS duplicate_rows, "
        f"{negatives} AS negative_columns, CAST({variant_columns} AS BIGINT) AS variant_columns FROM ({source})"
    ).replace("(SELECT count(*) AS n FROM", f"(SELECT {', '.join(columns)}, count(*) AS n FROM")
    return (
        f"SELECT total_rows, {k} AS total_cols, total_nulls, round(total_nulls * 100.0 / (total_rows * {k}), 2) AS overall_missing_pct, "
        f"duplicate_rows, {dup} AS duplicate_pct, CASE WHEN {dup} >= 10 THEN 'high' WHEN {dup} >= 2 THEN 'moderate' ELSE 'low' END AS duplicate_severity, "
        f"negative_columns, variant_columns, round(100.0 * (1.0 - total_nulls / (total_rows * {k}.0)), 1) AS completeness, "
        f"round(100.0 * (1.0 - duplicate_rows * 1.0 / total_rows), 1) AS uniqueness, round(100.0 * (1.0 - negative_columns / {k}.0), 1) AS validity, "
        f"round(100.0 * (1.0 - variant_columns / {k}.0), 1) AS consistency, {score} AS overall_score, "
        f"CASE WHEN {score} >= 95 THEN 'A+' WHEN {score} >= 90 THEN 'A' WHEN {score} >= 80 THEN 'B' WHEN {score} >= 70 THEN 'C' "
        f"WHEN {score} >= 60 THEN 'D' ELSE 'F' END AS grade, round({k}.0 / total_rows, 4) AS dimensionality_ratio, "
        f"round({k}.0 / total_rows, 4) > 0.1 AS is_high_dimensional FROM ({base})"
    )


# --- personal data -------------------------------------------------------------------------------------------
def _contacts(spark, sf_dir):
    """Customers with contact columns made from their own keys and balances."""
    key = F.col("c_custkey")
    card = F.concat(F.lit("4532-0151-"), F.lpad(key.cast("string"), 8, "0"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("customer_name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("contact"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("+1555"), F.lpad(key.cast("string"), 7, "0")))
        .otherwise("not given")
        .alias("mobile"),
        F.concat_ws("-", F.lpad(F.col("c_nationkey").cast("string"), 3, "1"), F.lit("45"), F.lpad(key.cast("string"), 4, "0")).alias("tax_no"),
        F.concat_ws(".", F.lit("10"), F.col("c_nationkey").cast("string"), F.length("c_mktsegment").cast("string"), F.lit("7")).alias("ip"),
        card.alias("card"),
        "c_mktsegment",
    )


_CONTACTS = (
    "SELECT c_name AS customer_name, lower(replace(c_name, '#', '.')) || '@example.com' AS contact, "
    "CASE WHEN c_acctbal > 5000 THEN '+1555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') ELSE 'not given' END AS mobile, "
    "lpad(CAST(c_nationkey AS VARCHAR), 3, '1') || '-45-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS tax_no, "
    "'10.' || c_nationkey || '.' || length(c_mktsegment) || '.7' AS ip, "
    "'4532-0151-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS card, c_mktsegment FROM customer"
)
_CONTACT_COLUMNS = ["customer_name", "contact", "mobile", "tax_no", "ip", "card", "c_mktsegment"]


def contact_pii(spark, sf_dir):
    return detect_pii(_contacts(spark, sf_dir))


_EMAIL = r"^[\w\.-]+@[\w\.-]+\.\w+$"
_PHONE = r"^\+?1?\d{9,15}$|^\d{3}[-\s]?\d{3}[-\s]?\d{4}$"
_SSN = r"^\d{3}-\d{2}-\d{4}$|^\d{9}$"
_IP = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def _hits(pattern: str) -> str:
    return f"count(*) FILTER (WHERE regexp_matches(v, '{pattern}'))"


def _luhn(v: str) -> str:
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    spread = (
        "list_sum(list_transform(range(1, length(d) + 1), lambda i : (CASE WHEN i % 2 = 0 THEN "
        "(CASE WHEN CAST(substr(reverse(d), i, 1) AS INTEGER) > 4 THEN CAST(substr(reverse(d), i, 1) AS INTEGER) * 2 - 9 "
        "ELSE CAST(substr(reverse(d), i, 1) AS INTEGER) * 2 END) ELSE CAST(substr(reverse(d), i, 1) AS INTEGER) END)))"
    ).replace("d)", f"{digits})")
    return f"(length({digits}) BETWEEN 13 AND 19 AND ({spread}) % 10 = 0)"


def _matches_sql(source: str, columns: list[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        card = f"count(*) FILTER (WHERE {_luhn('v')})" if any(w in c for w in K.CARD_NAMES) else "0"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count(v) AS n_values, {card} AS card, {_hits(_EMAIL)} AS email, "
            f"{_hits(_PHONE)} AS phone, {_hits(_SSN)} AS ssn, {_hits(_IP)} AS ip FROM (SELECT trim({c}) AS v FROM ({source})) "
            "WHERE lower(v) NOT IN ('', 'nan', 'none', 'null')"
        )
    return union_all(parts)


def _pii_sql() -> str:
    """The rules for the contact columns, whose names hold customer_name, mobile, ip and card."""
    share = lambda c: f"({c} * 1.0 / n_values)"
    rules = [
        ("\"column\" = 'card' AND card > 0", K.CARD_TYPE, f"CASE WHEN {share('card')} > 0.2 THEN 'HIGH' ELSE 'MEDIUM' END", "card"),
        (f"{share('email')} > 0.05", K.EMAIL_TYPE, f"CASE WHEN {share('email')} > 0.3 THEN 'HIGH' WHEN {share('email')} > 0.1 THEN 'MEDIUM' ELSE 'LOW' END", "email"),
        ("\"column\" = 'mobile'", K.PHONE_TYPE, "'HIGH'", "phone"),
        (f"{share('phone')} > 0.05", K.PHONE_TYPE, f"CASE WHEN {share('phone')} > 0.3 THEN 'HIGH' WHEN {share('phone')} > 0.1 THEN 'MEDIUM' ELSE 'LOW' END", "phone"),
        (f"{share('ssn')} > 0.05", K.SSN_TYPE, f"CASE WHEN {share('ssn')} > 0.2 THEN 'HIGH' ELSE 'MEDIUM' END", "ssn"),
        (f"{share('ip')} > 0.2", K.IP_TYPE, f"CASE WHEN {share('ip')} > 0.3 THEN 'HIGH' ELSE 'MEDIUM' END", "ip"),
        ("\"column\" = 'customer_name'", K.PERSON_TYPE, "'HIGH'", "n_values"),
    ]
    pick = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN {k(r)}" for r in rules) + " END"
    return (
        f"SELECT * FROM (SELECT position, \"column\", {pick(lambda r: chr(39) + r[1] + chr(39))} AS type, "
        f"{pick(lambda r: r[2])} AS confidence, {pick(lambda r: r[3])} AS matched, n_values, "
        f"{pick(lambda r: chr(39) + K.RECOMMENDATIONS[r[1]] + chr(39))} AS recommendation "
        f"FROM ({_matches_sql(_CONTACTS, _CONTACT_COLUMNS)})) WHERE type IS NOT NULL"
    )


def word_pii(spark, sf_dir):
    """Matches of every rule among all words of all documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return pii_matches(words)


def page_pii(spark, sf_dir):
    return pii_matches(table(spark, sf_dir, "pages").select("url", "html"))


def masked_contacts(spark, sf_dir):
    contacts = _contacts(spark, sf_dir)
    return mask_pii(contacts, detect_pii(contacts))


_MASKED = (
    "SELECT 'person_' || substr(sha256(customer_name), 1, 16) AS customer_name, '[redacted email]' AS contact, "
    "regexp_replace(mobile, '[0-9]', '*', 'g') AS mobile, sha256(tax_no) AS tax_no, "
    r"regexp_replace(ip, '\.\d{1,3}\.\d{1,3}$', '.0.0') AS ip, "
    "repeat('*', 12) || right(regexp_replace(card, '[^0-9]', '', 'g'), 4) AS card, c_mktsegment "
    f"FROM ({_CONTACTS})"
)

QUERIES = {
    "docs_column_quality": (
        docs_column_quality,
        _column_quality_sql(_QUALITY_SOURCE, [*_DOC_COLUMNS, "edition", "length_class"], {"doc_id", "n_chars", "quality", "toxic"}),
    ),
    "legacy_missing": (legacy_missing, _legacy_sql()),
    "duplicate_lines": (
        duplicate_lines,
        _duplicates_sql("lineitem", "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_linenumber, l_suppkey"),
    ),
    "duplicate_documents": (duplicate_documents, _duplicates_sql("documents", "text, lang, source")),
    "variants": (variants, _variants_sql()),
    "sentinels": (
        sentinels,
        f"SELECT 1 AS position, 'priority' AS \"column\", '?' AS sentinels WHERE EXISTS (SELECT 1 FROM ({_MESSY_ORDERS}) WHERE trim(priority) = '?') "
        f"UNION ALL SELECT 3, 'band', '-999' WHERE EXISTS (SELECT 1 FROM ({_MESSY_ORDERS}) WHERE band = -999)",
    ),
    "order_score": (
        order_score,
        _score_sql(
            _MESSY_ORDERS,
            ["status", "priority", "amount", "band", "weight"],
            "CAST(min(amount) < 0 AS INTEGER) + CAST(min(band) < 0 AS INTEGER) + CAST(min(weight) < 0 AS INTEGER)",
            f"(SELECT count(DISTINCT \"column\") FROM ({_variants_sql()}))",
        ),
    ),
    "docs_score": (
        docs_score,
        _score_sql(
            DOCS_LABELS,
            _DOC_COLUMNS,
            "0",
            "((SELECT CAST(count(DISTINCT lower(lang)) < count(DISTINCT lang) AS INTEGER) FROM documents) + "
            "(SELECT CAST(count(DISTINCT lower(source)) < count(DISTINCT source) AS INTEGER) FROM documents))",
        ),
    ),
    "contact_pii": (contact_pii, _pii_sql()),
    "word_pii": (
        word_pii,
        _matches_sql("SELECT unnest(string_split(text, ' ')) AS word FROM documents", ["word"]).replace(
            "trim(word)", r"trim(word, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160))"
        ),
    ),
    "page_pii": (page_pii, _matches_sql("SELECT url, html FROM pages", ["url", "html"])),
    "masked_contacts": (masked_contacts, _MASKED),
}
