"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the windows of ordinary and one on those of toxic labelled documents. Since
toxic documents are mostly ordinary text, a third one is the ordinary one and what marks toxic text, chosen by counting: the
words and word beginnings that recur in it in many different surroundings and hardly in ordinary text. A text is cut into
windows of words. A window that gets shorter with the toxic or the marked dictionary than with the ordinary one speaks for
toxic text; how much shorter is its margin. A document's margins (the largest ones, how many pass one and two bytes, their
sum, mean and share) meet weights and a threshold that are calibrated on labelled documents kept apart from the dictionaries.

Learning reads a bounded sample: at most ``TOXIC_ROWS`` toxic and ``ORDINARY_ROWS`` ordinary labelled documents of at
most ``LONGEST`` characters, chosen by a hash of doc_id, none with crc32(doc_id) mod 5 = 0. Scoring reads every window
of every text.

Defined cases: a null or empty text has one empty window and a low score; a document with contradicting labels counts
as toxic; labels that are neither 0 nor 1 and null ids are left out; a null doc_id is not held out; without labels of
both kinds every score is 0; repeated rows stay, and of the texts of a repeated doc_id the smallest is learned from. Extra columns of documents are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record, table, text_slices
from .op7_winnowing import words_of

TOXIC_ROWS = 2000
ORDINARY_ROWS = 4000
LONGEST = 20_000
#: Share of the sample that the dictionaries learn from; the rest calibrates.
TRAIN_SHARE = 0.6
WINDOW_WORDS = 16
DICTIONARY_BYTES = 32 << 10
#: A word or beginning is distinctive if it stands in so many different surroundings in toxic text, at least ...
SURROUNDINGS, SURROUNDINGS_SHARE = 8, 2e-5
#: ... and so many times as often as in ordinary text.
TIMES = 10.0
#: Bytes of word beginnings that count beside whole words.
BEGINNINGS = (5, 6, 7)
HELD_OUT = 5

_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def windows_of(text: str | None, size: int = WINDOW_WORDS) -> list[bytes]:
    """All words of a text in windows of ``size`` words, in lower case with single spaces."""
    words = words_of(text)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, max(1, len(words)), size)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Literals stay plain and matches are long, so that lengths differ only by what the dictionary holds."""
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_FAST,
        target_length=1,
        min_match=6,
        hash_log=18,
        window_log=18,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def _sizes(compressor: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    done = compressor.multi_compress_to_buffer(windows, threads=1)
    return np.fromiter((len(x) for x in done), np.int64, len(windows))


def _train(samples: Sequence[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; very few samples are a dictionary as they are."""
    try:
        return zstandard.train_dictionary(size, list(samples), k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].rjust(16)


def _surroundings(texts: Sequence[str]) -> tuple[Counter, int]:
    """In how many different places (word before, word after) each word and each beginning of words stands."""
    places = set()
    for text in texts:
        words = words_of(text)
        places.update(zip([b"", *words], words, [*words[1:], b""]))
    segments: Counter = Counter()
    for word, n in Counter(w for _, w, _ in places).items():
        segments[b" " + word + b" "] += n
        for size in BEGINNINGS:
            if len(word) > size:
                segments[b" " + word[:size]] += n
    return segments, len(places)


def train_dictionaries(ordinary: Sequence[str], toxic: Sequence[str]) -> tuple[bytes, bytes, bytes]:
    """Dictionaries trained on ordinary and on toxic text, and the ordinary one with the marks of toxic text."""
    base = _train([w for t in ordinary for w in windows_of(t)], DICTIONARY_BYTES)
    other = _train([w for t in toxic for w in windows_of(t)], DICTIONARY_BYTES)
    here, n_here = _surroundings(toxic)
    there, n_there = _surroundings(ordinary)
    least = max(SURROUNDINGS, SURROUNDINGS_SHARE * n_here)
    marks = [
        s for s, n in here.items() if n >= least and n / max(1, n_here) > TIMES * (there[s] + 0.5) / max(1, n_there)
    ]
    # matches near the end are cheapest: the most frequent segments come last
    marks.sort(key=lambda s: (here[s], s))
    return base, other, base + b"".join(marks)[-DICTIONARY_BYTES:]


@dataclass(frozen=True)
class Model:
    """Three dictionaries and the calibrated weights; small enough to go with every task."""

    ordinary: bytes
    toxic: bytes
    marked: bytes
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def features(self, texts: Sequence[str | None]) -> np.ndarray:
        plain, toxic, marked = (_compressor(x) for x in (self.ordinary, self.toxic, self.marked))
        rows = []
        for text in texts:
            windows = windows_of(text)
            length = _sizes(plain, windows)
            margin, other = length - _sizes(marked, windows), length - _sizes(toxic, windows)
            gain = np.sort(np.maximum(margin, 0))[::-1]
            one, two = int((margin >= 1).sum()), int((margin >= 2).sum())
            top = [*gain[:3].tolist(), 0, 0, 0][:3]
            rows.append(
                [1.0, *top, np.log1p(one), np.log1p(two), np.log1p(gain.sum()), np.log(len(margin)), two / len(margin), margin.mean()]
                + [other.max(), other.mean(), (other >= 2).mean()]
            )
        return np.array(rows, float).reshape(len(texts), 13)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Calibrated scores; 0.5 is the threshold."""
        if not self.weights:
            return np.zeros(len(texts))
        z = (self.features(texts) - np.array(self.centre)) / np.array(self.scale) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(model: Model, texts: Sequence[str], labels: Sequence[int], share: float) -> Model:
    """Weights of a logistic score on labelled texts; ``share`` is how frequent toxic documents are among all labels."""
    x, y = model.features(texts), np.array(labels, float)
    if not 0 < y.sum() < len(y):
        return model
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    centre[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    x = (x - centre) / scale
    b = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps; the small ridge keeps them finite
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        slope = x.T @ (weight * (p - y)) + 0.01 * b
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(b))
        b -= np.linalg.solve(bend, slope)
    return Model(model.ordinary, model.toxic, model.marked, tuple(centre), tuple(scale), tuple(b))


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % HELD_OUT


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of labelled documents."""
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (_remainder(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    sample = known.filter("toxic = 1").orderBy(order).limit(TOXIC_ROWS).union(
        known.filter("toxic = 0").orderBy(order).limit(ORDINARY_ROWS)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = (
        texts.filter(F.char_length("text").between(1, LONGEST))
        .join(F.broadcast(sample), "doc_id")  # at most TOXIC_ROWS + ORDINARY_ROWS ids
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))  # whatever the order of rows
        .withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1000)) / 1000)
        .orderBy("doc_id")
        .collect()
    )
    split = {(t, part): [r["text"] for r in rows if r["toxic"] == t and (r["share"] < TRAIN_SHARE) == part] for t in (0, 1) for part in (True, False)}
    if not all(split.values()):
        return Model(b"", b"", b"")
    model = Model(*train_dictionaries(split[0, True], split[1, True]))
    apart = split[0, False] + split[1, False]
    truth = [0] * len(split[0, False]) + [1] * len(split[1, False])
    return calibrate(model, apart, truth, count[1] / (count[0] + count[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield record(_SCORES, doc_id=batch.column("doc_id"), score=model.scores(batch.column("text").to_pylist()))

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(compute, "doc_id bigint, score double")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield batch.filter(pa.array(model.scores(batch.column("text").to_pylist()) < threshold, pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(_remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op5_toxicity": (op5_toxicity, None)}
