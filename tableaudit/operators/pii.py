"""Personal-data findings per column, and masking of what was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.columns import is_numeric, quoted, stripped, text_of, value_of
from ..plans.aggregates import per_column
from ..sources.sampling import sample_rows as take_sample


def is_luhn_number(text: Column) -> Column:
    """True when the digits of a text form a 13 to 19 digit number with a valid Luhn checksum."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _named(column: str, words: Sequence[str]) -> bool:
    name = column.lower().strip()
    return any(w in name for w in words)


def _rules(column: str) -> Column:
    """The first rule that emits a finding, over the counted matches of one column."""
    n = F.col("n_values").cast("double")

    def rule(kind: str, hits: str | Column, emits: Column, confidence: Column):
        matched = F.col(hits) if isinstance(hits, str) else hits
        return emits, F.struct(
            F.lit(kind).alias("type"),
            confidence.alias("confidence"),
            matched.cast("long").alias("matched"),
            F.lit(K.RECOMMENDATIONS[kind]).alias("recommendation"),
        )

    def graded(pct: Column, high: float, medium: float, named: bool) -> Column:
        scale = F.when(pct > high, "HIGH").when(pct > medium, "MEDIUM").otherwise("LOW")
        return F.lit("HIGH") if named else scale

    card, email, phone, ssn, ip = (F.col(c) / n for c in ("card", "email", "phone", "ssn", "ip"))
    rules = []
    if _named(column, K.CARD_NAMES):
        rules.append(
            rule(K.CARD_TYPE, "card", F.col("card") > 0, F.when(card > 0.2, "HIGH").otherwise("MEDIUM"))
        )
    named = _named(column, K.EMAIL_NAMES)
    rules.append(rule(K.EMAIL_TYPE, "email", F.lit(named) | (email > 0.05), graded(email, 0.3, 0.1, named)))
    named = _named(column, K.PHONE_NAMES)
    rules.append(rule(K.PHONE_TYPE, "phone", F.lit(named) | (phone > 0.05), graded(phone, 0.3, 0.1, named)))
    named = _named(column, ["ssn"])
    rules.append(rule(K.SSN_TYPE, "ssn", F.lit(named) | (ssn > 0.05), graded(ssn, 0.2, 0.05, named)))
    named = _named(column, ["ip_address"])
    rules.append(
        rule(K.IP_TYPE, "ip", F.lit(named) | (ip > 0.2), F.when(ip > 0.3, "HIGH").otherwise("MEDIUM"))
    )
    if _named(column, K.PERSON_NAMES):
        rules.append(rule(K.PERSON_TYPE, "n_values", F.lit(True), F.lit("HIGH")))
    out = None
    for emits, found in rules:
        out = F.when(emits, found) if out is None else out.when(emits, found)
    return F.when(F.col("n_values") > 0, out)


def pii_matches(df: DataFrame) -> DataFrame:
    """``(position, column, n_values, card, email, phone, ssn, ip)``: matching values, in one scan."""
    return per_column(df, {name: _match_counts(df, name) for name in df.columns})


def _match_counts(df: DataFrame, name: str) -> dict[str, Column]:
    """Aggregates of one column. Only text needs pattern matching; a number is judged by its digits."""
    dtype = df.schema[name].dataType
    text = stripped(text_of(df, name))
    none = F.count_if(F.lit(False))
    card = F.count_if(is_luhn_number(text)) if _named(name, K.CARD_NAMES) else none
    if isinstance(dtype, T.StringType):
        blank = (F.octet_length(text) <= 4) & F.lower(text).isin(K.BLANK_TOKENS)
        text = F.when(~blank, text)
        # the number patterns match 17 characters at most, 4 bytes each: longer text needs no pattern matching
        short = F.octet_length(text) <= 68
        return {
            "n_values": F.count(text),
            "card": F.count_if(is_luhn_number(text)) if _named(name, K.CARD_NAMES) else none,
            "email": F.count_if(text.contains("@") & text.rlike(K.EMAIL_PATTERN)),
            "phone": F.count_if(short & text.rlike(K.PHONE_PATTERN)),
            "ssn": F.count_if(short & text.rlike(K.SSN_PATTERN)),
            "ip": F.count_if(short & text.rlike(K.IP_PATTERN)),
        }
    found = {"n_values": F.count(text), "card": card, "email": none, "phone": none, "ssn": none, "ip": none}
    if isinstance(dtype, T.IntegralType):
        value = quoted(name)
        # 9 to 15 digits, or 16 that start with 1
        found["phone"] = F.count_if(value.between(10**8, 2 * 10**15 - 1))
        found["ssn"] = F.count_if(value.between(10**8, 10**9 - 1))
        found["n_values"] = F.count(value)
    elif isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        found["phone"] = F.count_if(text.rlike(K.PHONE_PATTERN))
        found["ssn"] = F.count_if(text.rlike(K.SSN_PATTERN))
    elif is_numeric(dtype):
        found["n_values"] = F.count(value_of(df, name))
    return found


def detect_pii(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """``(position, column, type, confidence, matched, n_values, recommendation)`` for suspicious columns.

    All rows are read unless ``sample_rows`` asks for a fixed-size sample.
    """
    source = take_sample(df, sample_rows) if sample_rows else df
    found = F.coalesce(*[F.when(F.col("column") == c, _rules(c)) for c in df.columns])
    return (
        pii_matches(source)
        .withColumn("found", found)
        .where(F.col("found").isNotNull())
        .select("position", "column", "found.type", "found.confidence", "found.matched", "n_values", "found.recommendation")
    )


def mask_column(text: Column, kind: str, salt: str = "") -> Column:
    """Replacement of one kind of personal data, following the recommendation of its finding."""
    hashed = F.sha2(F.concat(F.lit(salt), text), 256)
    if kind == K.CARD_TYPE:
        digits = F.regexp_replace(text, "[^0-9]", "")
        return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(digits) - 4, F.lit(0))), F.right(digits, F.lit(4)))
    if kind == K.EMAIL_TYPE:
        return F.when(text.isNotNull(), F.lit("[redacted email]"))
    if kind == K.PHONE_TYPE:
        return F.regexp_replace(text, "[0-9]", "*")
    if kind == K.SSN_TYPE:
        return hashed
    if kind == K.IP_TYPE:
        return F.regexp_replace(text, r"\.\d{1,3}\.\d{1,3}$", ".0.0")
    return F.concat(F.lit("person_"), F.substring(hashed, 1, 16))


def mask_pii(df: DataFrame, findings: DataFrame, salt: str = "") -> DataFrame:
    """Mask every column named in ``findings`` (one row per column of ``df`` at most)."""
    kinds = {r["column"]: r["type"] for r in findings.select("column", "type").collect()}
    return df.select(
        *[
            mask_column(text_of(df, c), kinds[c], salt).alias(c) if c in kinds else quoted(c)
            for c in df.columns
        ]
    )
