"""Detection of periodic runs of words by the dictionary of basic factors.

A run is a stretch of consecutive words with a smallest period q that no neighbouring word extends, of at least ``LEAST``
words and ``REPEATS`` periods. The dictionary names, for every power of two L, the factors of L words so that equal
factors of a text have equal names; the names for 2L are those of pairs of names for L. At each length the occurrences
of a factor within twice the length of one another are followed: three of them at equal distance, an arithmetic progression, propose
that distance as a period. A run of period q is proposed at the length L with q <= L < 2q: there the next occurrence
of a factor of the run is exactly q words on, and the run, of four periods or more, holds three of them. Proposals are
extended to both sides by names of falling length, and equal ones are dropped. A factor that occurs once has no name, so
longer factors are only formed where text repeats.

A batch of texts is handled at once with arrays; a text that fills a batch by itself is handled alone and as a
whole. Texts never meet: names hold the number of the text.

Defined cases: a null text has no words; an empty text or one without words has no runs; rows are answered one by one, so
repeated rows and ids have equal rows; a null doc_id stays; an empty table gives no rows; extra columns are not read by the
query, and ``find_runs`` keeps the doc_id only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

LEAST = 6
REPEATS = 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())]
)
_FOUND_DDL = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _next(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names of the values, -1 for those that occur once, and the next place with the same value (-1: none)."""
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    same = ranked[1:] == ranked[:-1]
    follows = np.full(len(names), -1, np.int64)
    follows[order[:-1][same]] = order[1:][same]
    dense = np.empty(len(names), np.int64)
    dense[order] = np.cumsum(np.concatenate(([0], ~same)))
    often = np.zeros(len(names), bool)
    often[1:] |= same
    often[:-1] |= same
    dense[order[~often]] = -1
    return dense, follows


class Factors:
    """Names of the factors of 1, 2, 4, ... symbols of a batch of texts; ``symbols`` differ between texts."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        #: per length, the places that still repeat, in order, and their names
        self.levels: list[np.ndarray] = []
        self.proposed: list[np.ndarray] = []
        names, follows = _next(symbols) if self.n else (symbols, symbols)
        size = 1
        while self.n and (names >= 0).any():
            self.levels.append(names.astype(np.int32))
            self._propose(follows, size)
            at = np.flatnonzero((names >= 0) & (np.arange(self.n) + size < self.n))
            at = at[names[at + size] >= 0]
            longer = np.full(self.n, -1, np.int64)
            follows = np.full(self.n, -1, np.int64)
            if len(at):
                dense, after = _next(names[at] * self.n + names[at + size])
                longer[at] = dense
                linked = after >= 0
                follows[at[linked]] = at[after[linked]]
            names, size = longer, 2 * size

    def _propose(self, follows: np.ndarray, size: int) -> None:
        """(place, period) where three occurrences lie at equal distance of at most ``2 * size``, first of each stretch."""
        at = np.flatnonzero(follows >= 0)
        step = follows[at] - at
        near = step <= 2 * size
        at, step = at[near], step[near]
        distance = np.zeros(self.n, np.int64)
        distance[at] = step
        thrice = distance[at + step] == step
        at, step = at[thrice], step[thrice]
        if len(at):
            first = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(step) != 0)))
            self.proposed.append(np.stack([at[first], step[first]], axis=1))

    def common(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """Symbols that agree from places ``a`` and ``b`` on, or before them; ``a`` < ``b``.

        Stretches that agree are shorter than twice the longest named factor, so each length is tried once.
        """
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[level], 1 << level
            if forward:
                x, y = a + length, b + length
                fits = y + size <= self.n
            else:
                x, y = a - length - size, b - length - size
                fits = x >= 0
            x, y = np.where(fits, x, 0), np.where(fits, y, 0)
            length[fits & (names[x] >= 0) & (names[x] == names[y])] += size
        return length

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) of all runs, by start and period."""
        if not self.proposed:
            return np.empty((0, 3), np.int64)
        at, period = np.unique(np.concatenate(self.proposed), axis=0).T
        start = at - self.common(at, at + period, forward=False)
        length = at - start + self.common(at, at + period) + period
        found = np.stack([start, length, period], axis=1)[length >= np.maximum(LEAST, REPEATS * period)]
        return np.unique(found[np.lexsort((found[:, 2], found[:, 0]))], axis=0)


def runs_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of each text, one row each with start, length, period and the number of the text, and the words to keep."""
    counts = np.array([len(w) for w in words], np.int64)
    begins = np.concatenate(([0], np.cumsum(counts)))
    number = np.repeat(np.arange(len(words)), counts)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for text in words for w in text), np.int64, begins[-1])
    found = Factors(number * max(1, len(known)) + codes).runs()
    text = number[found[:, 0]] if len(found) else np.empty(0, np.int64)
    change = np.zeros(begins[-1] + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], -1)
    np.add.at(change, found[:, 0] + found[:, 1], 1)
    kept = np.cumsum(change)[:-1] == 0
    return np.stack([found[:, 0] - begins[text], found[:, 1], found[:, 2], text], axis=1), kept


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; ``runs`` by start and period, ``collapsed`` the text without the
    words that a run repeats, joined by one space."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = pc.cast(batch.column("text"), pa.binary()).to_pylist()
            words = [(t or b"").split() for t in texts]  # on the six ASCII signs of white space
            found, kept = runs_of(words)
            counts = [len(w) for w in words]
            ends = np.cumsum(counts)
            collapsed = []
            for own, n, end in zip(words, counts, ends):
                keep = kept[end - n : end]
                collapsed.append(b" ".join(own if keep.all() else [own[i] for i in np.flatnonzero(keep)]))
            offsets = np.searchsorted(found[:, 3], np.arange(len(words) + 1))
            rows = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                schema=_FOUND,
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, _FOUND_DDL)


def with_planted(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents with its later words replaced by repetitions of a stretch of them.

    With h the crc32 of the decimal doc_id and g = h div 10, documents with h mod 10 = 0 have each word i >= a replaced by
    word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null doc_id plants nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, n - a)
    planted = F.array_join(F.concat(F.slice(words, 1, a), repeated), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), planted).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the longest run and digests of all runs and of the collapsed text, for every document."""
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", with_planted(F.col("doc_id"), F.col("text")).alias("text")))
    ranked = F.transform(
        "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    )
    return found.withColumn("longest", F.array_max(ranked)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("longest.length * 1000 div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs have no SQL of bearable cost; ``tests/llm`` compares with a search of every period.
QUERIES = {"op12_periodic_runs": (op12_periodic_runs, None)}
