"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, address schemes and identifier cues. Each
anchor is expanded by a small deterministic parser of its kind, which finds the exact boundaries and validates them:

* email: left over local characters, right over dot-separated labels, at least two;
* ip: four numbers with dots, each at most 255;
* card: digits with single spaces or hyphens between, 14 to 19 of them, with a right Luhn sum;
* phone: a plus sign, then digits, spaces, brackets, dots and hyphens, 10 to 15 digits;
* url: a scheme and a host, up to white space or a quote, without closing punctuation;
* account: a cue such as ``iban`` or ``passport no``, then an identifier of 6 to 34 letters and digits, four of them
  digits;
* secret: ``password``, ``token`` or ``api_key`` with ``=`` or ``:`` and a value of 8 characters or more, or an access
  key id.

The first four are the base kinds. Within a kind, spans are leftmost and do not overlap; a base span that fails its
validation is dropped and not tried again from a later place. Places are code points, ends exclusive.

Defined cases: a null text is empty and has no spans; repeated rows stay; an empty table gives no rows. Other columns
are not read by ``find`` and are kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record, table, text_slices

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "routing", "swift", "tax id")
SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "secret", "akia")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOUR = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_URL = re.compile(r"(?:https?|ftp)://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?", re.IGNORECASE)
#: White space is never given back: what follows it cannot be white space.
_ACCOUNT = re.compile(r"(?:\s*+(?:number|no\.?|nr\.?|#))?\s*+[:=#]?\s*+([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])", re.IGNORECASE)
_SECRET = re.compile(r"\s*+[=:]\s*+[\"']?([A-Za-z0-9_+/=.-]{8,})")
_ACCESS_KEY = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")

Span = tuple[int, int, int]  # start, kind, end


@cache
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, (sign if sign in "@+" else "0", 1))
    for what, words in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for word in words:
            for form in (word, word.capitalize(), word.upper()):
                found.add_word(form, (what, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _email(text: str, at: int, after: int) -> Span | None:
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, 0, domain.end()) if domain else None


def _small(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) < 4 and int(number or 0) <= 255


def _phone(text: str, at: int) -> Span | None:
    found = _PHONE.match(text, at)
    return (at, 3, found.end()) if found and 10 <= sum(c.isdigit() for c in found[0]) <= 15 else None


def _account(text: str, end: int) -> Span | None:
    found = _ACCOUNT.match(text, end)
    if not found:
        return None
    # words that follow the identifier are not part of it
    start, stop = found.span(1)
    while stop > start and not text[stop - 1].isdigit():
        stop -= 1
    own = text[start:stop]
    return (start, 5, stop) if sum(c.isdigit() for c in own) >= 4 and sum(c.isalnum() for c in own) >= 6 else None


def _secret(text: str, start: int, end: int) -> Span | None:
    if text[start:end] == "AKIA":
        found = _ACCESS_KEY.match(text, end)
        return (start, 6, found.end()) if found else None
    found = _SECRET.match(text, end)
    return (found.start(1), 6, found.end(1)) if found else None


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text as (start, place of the kind in ``KINDS``, end), in order."""
    if not text:
        return []
    out: list[Span] = []
    last = dict.fromkeys(range(len(KINDS)), 0)
    run = four = 0  # ends of the digit chain and of the digits tried as an address
    for end, (what, size) in _anchors().iter(text):
        at = end + 1 - size
        if what == "0":
            if at >= run:
                chain = _CHAIN.match(text, at)
                run = chain.end()
                digits = chain[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, run))
            if at >= four:
                found = _FOUR.match(text, at)
                if found:
                    four = found.end()
                    if all(map(_small, found.groups())):
                        out.append((at, 1, four))
                else:
                    four = _DIGITS.match(text, at).end()
            continue
        if what == "@":
            span = _email(text, at, last[0])
        elif what == "+":
            span = _phone(text, at) if at >= last[3] else None
        elif what == "url":
            found = _URL.match(text, at) if at >= last[4] else None
            span = (at, 4, at + len(found[0].rstrip(".,;:!?)]}"))) if found else None
        elif what == "account":
            span = _account(text, end + 1)
        else:
            # a cue inside a value leads to a part of that value, unless only the sign after it is left
            span = _secret(text, at, end + 1) if end + 2 >= last[6] else None
        if span and span[0] >= last[span[1]]:
            out.append(span)
            last[span[1]] = span[2]
    return sorted(out)


_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
)
_FOUND_SQL = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans are ordered by start, then kind as listed in ``KINDS``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t)] for t in batch.column("text").to_pylist()
            ]
            yield record(_FOUND, doc_id=batch.column("doc_id"), spans=found)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(search, _FOUND_SQL)


def redacted(text: str | None, kinds: frozenset[str] = frozenset(KINDS)) -> str | None:
    """The text with a mark such as ``[EMAIL]`` in place of each span; spans that overlap share the first one's mark."""
    if not text:
        return text
    out, done, last = [], 0, -1
    for start, kind, end in spans_of(text):
        if KINDS[kind] not in kinds:
            continue
        if start >= last:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        last = done = max(end, done)
    return "".join([*out, text[done:]]) if out else text


def redact(docs: DataFrame, kinds: frozenset[str] = frozenset(KINDS)) -> DataFrame:
    """All columns of ``docs`` with the spans of ``text`` replaced; a column ``n_chars`` is counted anew."""
    schema = docs.schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            new = [redacted(t, kinds) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield batch

    out = docs.mapInArrow(replace, schema)
    if "n_chars" in docs.columns:
        counted = F.char_length("text").cast(schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(counted, F.col("n_chars"))))
    return out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""

    def joined(spans: Column) -> Column:
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op8_pii": (op8_pii, None)}
