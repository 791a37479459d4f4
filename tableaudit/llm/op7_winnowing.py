"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into words. Every run of ``GRAM`` words is hashed, and of every ``window`` - GRAM
+ 1 neighbouring hashes the smallest is kept as a fingerprint (the rightmost of equal ones). Two texts that share
``window`` words in a row choose the same fingerprint inside that span, so looking up a document's fingerprints among
the items' finds every shared span. A hit is then extended to the windows of words around it, which are compared word
by word with the items' windows. Items shorter than a window are one window: all runs of their own length are
fingerprints for them.

The items' fingerprints and windows are sent to every task, in blocks of a checked size: as many passes over the
documents as there are blocks, and one for any benchmark up to ``BLOCK_BYTES`` of text. Documents are not shuffled, so
a passage that a third of them share costs no more than others.

Defined cases: a null text or one without words has no words, no hits and the digest of an empty list; null item texts
and items without words match nothing; repeated items count each, by their ids; null item ids are left out; repeated
rows stay. Extra columns of documents are not read; those of items neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grams, keep, record, table, text_slices

WINDOW = 10
GRAM = 5
#: Text of benchmark items sent to the tasks at once.
BLOCK_BYTES = 32_000_000

#: Bytes of words in lower case; all others become spaces.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, A-Z in lower case, a-z and all characters beyond ASCII."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest of every ``width`` neighbouring hashes, the rightmost of equal ones."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, place = hashes[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, width):
        new = hashes[i : i + n] <= least
        least[new] = hashes[i : i + n][new]
        place[new] = i
    return np.unique(place + np.arange(n))


class Windows:
    """All windows of one number of words of some items, by hash; and the fingerprints that lead to them."""

    def __init__(self, items: list[tuple[int, list[bytes]]], size: int, gram: int):
        self.size, self.gram = size, gram
        self.ids = [item for item, _ in items]
        self.texts = [b" ".join(words) for _, words in items]
        self.ends = [np.cumsum([len(w) + 1 for w in words]) - 1 for _, words in items]
        hashes = [word_hashes(words) for _, words in items]
        keys = [grams(h, size) for h in hashes]
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        owner = np.repeat(np.arange(len(items), dtype=np.int32), sizes)[order]
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])[order]
        self._group(keys[order], owner, place)
        self.prints = np.unique(np.concatenate([self.fingerprints(h)[1] for h in hashes]))

    def _group(self, keys: np.ndarray, owner: np.ndarray, place: np.ndarray) -> None:
        """Every window once: its hash, one place that has its words, and the number of the list of items that have it.

        Windows of a template that many items share lead to one list, which is kept once.
        """
        self.lists: list[np.ndarray] = [np.array([i], np.int64) for i in self.ids]
        known: dict[bytes, int] = {}
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        last = np.concatenate([first[1:], [len(keys)]])
        alone = last - first == 1
        at, number = [first[alone]], [owner[first[alone]].astype(np.int64)]
        for a, b in zip(first[~alone].tolist(), last[~alone].tolist()):
            texts: dict[bytes, list[int]] = {}
            for i in range(a, b):
                texts.setdefault(self._text(owner[i], place[i]), []).append(i)
            for rows in texts.values():  # more than one only where hashes of different windows agree
                own = np.unique(np.array([self.ids[o] for o in owner[rows].tolist()], np.int64))
                if (at_list := known.setdefault(own.tobytes(), len(self.lists))) == len(self.lists):
                    self.lists.append(own)
                at.append(np.array(rows[:1]))
                number.append(np.array([at_list]))
        at, number = np.concatenate(at), np.concatenate(number)
        order = np.argsort(keys[at], kind="stable")
        self.keys, self.owner, self.place, self.number = (x[order] for x in (keys[at], owner[at], place[at], number))

    def fingerprints(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the hashes kept from a text's words."""
        found = grams(hashes, self.gram)
        places = winnow(found, self.size - self.gram + 1)
        return places, found[places]

    def _text(self, owner: int, place: int) -> bytes:
        ends = self.ends[owner]
        return self.texts[owner][ends[place - 1] + 1 if place else 0 : ends[place + self.size - 1]]

    def search(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places in ``words`` where a window occurs, with the number of the list of items that have it."""
        places, values = self.fingerprints(hashes)
        if not len(places):
            return
        at = np.minimum(np.searchsorted(self.prints, values), len(self.prints) - 1)
        hits = places[self.prints[at] == values]
        if not len(hits):
            return
        around = (hits[:, None] - np.arange(self.size - self.gram + 1)).reshape(-1)
        around = np.unique(around[(around >= 0) & (around <= len(words) - self.size)])
        keys = grams(hashes, self.size)[around]
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        for i, a, b in zip(around.tolist(), low.tolist(), high.tolist()):
            if a < b:
                own = b" ".join(words[i : i + self.size])
                for k in range(a, b):
                    if self._text(self.owner[k], self.place[k]) == own:
                        yield i, int(self.number[k])


class Index:
    """Fingerprints and windows of some items, by the number of words of a window."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, gram: int = GRAM):
        groups: dict[int, list[tuple[int, list[bytes]]]] = {}
        for item, text in items:
            if words := words_of(text):
                groups.setdefault(min(window, len(words)), []).append((item, words))
        self.groups = [Windows(own, size, min(gram, window) if size == window else size) for size, own in groups.items()]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words (start, end) that are hit, joined where they meet, and the items that occur."""
        hashes = word_hashes(words)
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for group in self.groups:
            lists = set()
            for i, number in group.search(words, hashes):
                spans.append((i, i + group.size))
                lists.add(number)
            for number in lists:
                items.update(group.lists[number].tolist())
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they meet or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``size`` bytes of text, each collected alone."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // size))
    for i in range(count):
        part = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


_HITS = "array<struct<start:bigint,end:bigint>>"


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document.

    ``spans`` are the hit words as (start, end) in ascending order without overlaps, ``items`` the ids of the items with
    an occurring window in no particular order.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    state = source.select("*", F.array().cast(_HITS).alias("spans"), F.array().cast("array<bigint>").alias("items"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(span)), ("items", pa.list_(pa.int64()))]
    blocks = _sent(spark, items, window, gram, block_bytes)
    sent = next(blocks)
    while sent is not None:
        after = next(blocks, None)
        final = after is None
        schema = pa.schema([("n_words", pa.int64()) if final and k[0] == "text" else k for k in kinds])

        def search(batches: Iterator[pa.RecordBatch], sent=sent, final=final, schema=schema) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in text_slices(batches):
                texts, sizes, spans, found = batch.column("text").to_pylist(), [], [], []
                for text, old, have in zip(texts, batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                    words = words_of(text)
                    new, hit = index.search(words)
                    sizes.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in old] + new)])
                    found.append(sorted({*have, *hit}))
                second = {"n_words": sizes} if final else {"text": texts}
                yield record(schema, doc_id=batch.column("doc_id"), **second, spans=spans, items=found)

        columns = f"doc_id bigint, {'n_words bigint' if final else 'text string'}, spans {_HITS}, items array<bigint>"
        state = state.mapInArrow(search, columns)
        if not final:
            state = keep(state)
            sent.unpersist()
        sent = after
    return state


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with all their columns."""
    for number, sent in enumerate(_sent(docs.sparkSession, items, window, gram, block_bytes)):
        if number:  # one block's index at a time
            docs = keep(docs)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in text_slices(batches):
                yield batch.filter(pa.array([not index.search(words_of(t))[1] for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def _sent(spark: SparkSession, items: DataFrame, window: int, gram: int, block_bytes: int) -> Iterator:
    for block in _blocks(items, block_bytes):
        yield spark.sparkContext.broadcast(Index(block, window, gram))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and occurring benchmark items of every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words_sql(source: str, name: str) -> str:
    lowered = f"translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}')"
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"SELECT {name}, regexp_extract_all({lowered}, '{pattern}') AS w FROM {source}"


def _sql() -> str:
    windows = (
        "SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win "
        "FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)"
    )
    runs = (
        "SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win FROM "
        "(SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows))"
    )
    return (
        f"WITH docs AS ({_words_sql('documents', 'doc_id')}), items AS ({_words_sql('benchmark', 'item_id')}), "
        f"windows AS ({windows}), runs AS ({runs}), "
        "hits AS (SELECT doc_id, item_id, i, runs.size FROM runs JOIN windows ON runs.win = windows.win AND runs.size = windows.size), "
        "words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id), "
        "found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM "
        "(SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id) "
        "SELECT docs.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, "
        "sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated "
        "FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"
    )


QUERIES = {"op7_benchmark_decontamination": (op7_benchmark_decontamination, _sql())}
