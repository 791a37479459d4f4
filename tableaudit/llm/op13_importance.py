"""Resampling of documents towards a target distribution, with hashed n-gram features.

Features of a text are all runs of 1 to 3 consecutive words, joined by one space; a feature's bucket is the crc32 of its
bytes modulo ``BUCKETS``. Counts of buckets over all documents and over all target texts give each bucket a gain, the
logarithm of their smoothed ratio. A document's weight is the sum of gains over its features, its score the
weight with Gumbel noise that follows from its doc_id, and the highest scores are drawn: a sample without replacement
by importance.

Buckets come from length-bucketed CRC matrices. A batch of texts is written as words with one space between, so that each
feature is a stretch of bytes. Distinct features of equal length stand together as a matrix of bytes, one row per
position; the CRCs of all of them advance position by position with one table look-up, and the buckets are scattered back to all
occurrences. Features of more than ``LONGEST`` bytes, at most a few in a batch, take the library's crc32.

Plan: two passes over the texts without a shuffle of text. The first leaves at most ``BUCKETS`` sums per task, the second one
row per document; the gains (``BUCKETS`` numbers) are broadcast. Scores are written once; a sketch gives a score that
at least the wanted share passes, and only those rows are ranked, in range partitions.

Defined cases: null and empty texts have no features and weight 0; repeated rows count, are weighted and may be drawn
each; rows without a doc_id have no score and are never drawn, nor counted as documents to draw from; ties in score
go to the smaller doc_id; without target texts all t are 0; empty tables give no rows; extra columns are not read by the query.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, record, table, text_slices
from .op11_shards import CRC_SQL, crc_sql
from .ordering import running

BUCKETS = 10_000
GRAMS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
LONGEST = 2048
#: Text handled at once; arrays take about 60 times this.
BATCH_BYTES = 2_000_000

_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_WEIGHTS = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]
)


def _crc_table() -> np.ndarray:
    """The remainder of every byte under the reflected polynomial of crc32."""
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, rest >> 1 ^ np.uint32(0xEDB88320), rest >> 1).astype(np.uint32)
    return rest


def _fold_table() -> bytes:
    """Letters in lower case, digits and bytes from 0x80 as they are, all else a space."""
    return bytes(
        b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
        for b in range(256)
    )


_CRC = _crc_table()
_FOLD = _fold_table()


def crc_matrix(octets: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """crc32 of the stretches of ``length`` bytes at ``start``."""
    matrix = octets[start[None, :] + np.arange(length)[:, None]]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for column in matrix:
        crc = _CRC[(crc ^ column) & 0xFF] ^ crc >> np.uint32(8)
    return ~crc


def buckets_of(octets: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every stretch of bytes, those of equal length by one matrix."""
    out = np.empty(len(start), np.int32)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        size = int(length[group[0]])
        if size > LONGEST:
            crc = np.array([zlib.crc32(octets[a : a + size].tobytes()) for a in start[group]], np.uint32)
        else:
            crc = crc_matrix(octets, start[group], size)
        out[group] = crc % np.uint32(buckets)
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense codes, and one place of each."""
    coded = pa.array(codes).dictionary_encode()
    dense = coded.indices.to_numpy()
    place = np.empty(len(coded.dictionary), np.int64)
    place[dense] = np.arange(len(dense))
    return dense.astype(np.int64), place


class Features:
    """Words, documents and buckets of the features of a batch of texts."""

    def __init__(self, texts: list[bytes | None], buckets: int = BUCKETS):
        lines = [b" ".join((t or b"").translate(_FOLD).split()) for t in texts]
        self.n_words = np.array([line.count(b" ") + 1 if line else 0 for line in lines], np.int64)
        written = b" ".join(line for line in lines if line) + b" "
        octets = np.frombuffer(written, np.uint8)
        ends = np.flatnonzero(octets == 0x20)
        #: (document of each feature, bucket of each feature), one pair for each number of words
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        n = int(self.n_words.sum())
        if not n:
            return
        starts = np.concatenate(([0], ends[:-1] + 1))
        document = np.repeat(np.arange(len(texts)), self.n_words)
        # a word is written with the space after it, so its bytes lie between two starts
        bounds = pa.py_buffer(np.concatenate((starts, [len(written)])).astype(np.int64))
        listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, bounds, pa.py_buffer(written)])
        coded = listed.dictionary_encode()
        word, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        codes, places = word, np.empty(many, np.int64)
        places[word] = np.arange(n)
        for size in range(1, GRAMS + 1):
            if size > 1:  # pairs of a shorter run and the word after it
                if n < size:
                    break
                codes, places = _distinct(codes[: n - size + 1] * many + word[size - 1 :])
            own = buckets_of(octets, starts[places], ends[places + size - 1] - starts[places], buckets)
            inside = document[: n - size + 1] == document[size - 1 :]
            self.parts.append((document[: n - size + 1][inside], own[codes][inside]))

    def counts(self, buckets: int) -> np.ndarray:
        return sum((np.bincount(b, minlength=buckets) for _, b in self.parts), np.zeros(buckets, np.int64))

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Sum of gains of each document; partial sums are whole numbers below 2**53."""
        out = np.zeros(len(self.n_words))
        for document, bucket in self.parts:
            out += np.bincount(document, gains[bucket], minlength=len(out))
        return out.astype(np.int64)

    def number(self) -> np.ndarray:
        return sum((np.maximum(self.n_words - k, 0) for k in range(GRAMS)), np.zeros(len(self.n_words), np.int64))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return pc.cast(batch.column("text"), pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; each task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches, BATCH_BYTES):
            total += Features(_texts(batch), buckets).counts(buckets)
        at = np.flatnonzero(total)
        yield record(_COUNTS, bucket=at, n=total[at])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, in thousandths, rounded down."""
    found = [np.zeros(buckets), np.zeros(buckets)]
    for own, rows in zip(found, (docs, target)):
        for row in bucket_counts(rows, buckets).collect():  # at most one row a bucket
            own[row["bucket"]] = row["n"]
    s, t = found
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))))


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in text_slices(batches, BATCH_BYTES):
            found = Features(_texts(batch), len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.n_words), pa.array(found.number()), pa.array(found.sums(own))],
                schema=_WEIGHTS,
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a sha256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))) * -1000.0).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; ``rank`` is null for rows that are not drawn."""
    weighed = weights(docs, gains(docs, target))
    scored = keep(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    may = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    pool = scored.filter(may)
    # the sketch's rank is at most a thousandth off, so a hundredth more than the share is surely enough
    least, total = pool.agg(
        F.percentile_approx("score", max(0.0, 0.99 - percent / 100), 1000), F.count("*")
    ).first()
    wanted = percent * total // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    likely = may & (F.col("score") >= least)
    order = [-F.col("score"), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    ranked = running(scored.filter(likely), order, {"rank": F.lit(1)})
    drawn = F.when(F.col("rank") < wanted, F.col("rank") + 1)
    rest = scored.filter(~likely).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", drawn).unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn documents with all their columns; of rows that share a drawn doc_id, all stay."""
    drawn = resample(docs, target, percent).filter("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document, with ``benchmark`` as the target."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_SQL = f"""
WITH RECURSIVE {CRC_SQL},
texts AS MATERIALIZED (
    SELECT row_number() OVER () AS place, * FROM (
        SELECT 's' AS side, doc_id, {_WORDS} AS words FROM documents
        UNION ALL SELECT 't', NULL, {_WORDS} FROM benchmark
    )
),
features AS MATERIALIZED (
    SELECT place, side, unnest(words
        || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
        || list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
    ) AS feature
    FROM texts
),
coded AS MATERIALIZED (
    SELECT feature, ({crc_sql("feature")} % {BUCKETS})::INTEGER AS bucket
    FROM (SELECT DISTINCT feature FROM features), crc_table
),
counts AS (
    SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
    FROM features JOIN coded USING (feature) GROUP BY bucket
),
gains AS (
    SELECT bucket, floor(1000 * ln(
        (t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + {BUCKETS})::DOUBLE
        / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
    FROM counts
),
sums AS (
    SELECT place, count(*) AS n_features, sum(gain)::BIGINT AS weight
    FROM features JOIN coded USING (feature) JOIN gains USING (bucket) WHERE side = 's' GROUP BY place
),
scored AS (
    SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
    FROM texts LEFT JOIN sums USING (place) WHERE side = 's'
),
ranked AS (
    SELECT *, coalesce(n_words >= {LEAST_WORDS} AND score IS NOT NULL, false) AS may,
           row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id, n_features, weight) AS rank,
           {PERCENT} * count(*) OVER (PARTITION BY may) // 100 AS wanted
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND rank <= wanted THEN rank END AS rank FROM ranked
"""

QUERIES = {"op13_importance": (op13_importance, _SQL)}
