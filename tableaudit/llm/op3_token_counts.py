"""Exact length histogram: how many documents have each encoded length, and what every context limit costs.

Documents are counted by the number of their ids; the histogram has at most one row per distinct length, so its size
follows the longest document, not the number of documents. Suffix sums over it answer, for any limit, how many
documents and ids lie beyond it and how many ids are left after truncation, and they give exact quantiles.

Defined cases: a null or empty text has length 0; an empty table gives an empty histogram; repeated rows count each.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import record, table, text_slices
from .tokens import BATCH_BYTES, default_path, encoder

_SCHEMA = pa.schema([("length", pa.int64())])


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The number of ids of each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, BATCH_BYTES):
            coded = encoder(tokenizer).encode(batch.column("text").to_pylist())
            yield record(_SCHEMA, length=[len(x) // 4 for x in coded])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "length bigint")


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per distinct length, taken as a context limit.

    ``n_docs`` have this length, ``n_longer`` a greater one with ``tokens_longer`` ids. ``total_tokens`` is the same on
    every row, ``truncated_tokens`` what is left when each document is cut at the limit, ``cut_tokens`` what is lost,
    and ``share_fitting`` the share of documents that fit, which makes the row the quantile of that share.
    """
    counted = lengths(docs, tokenizer).groupBy("length").agg(F.count("*").alias("n_docs"))
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0).cast("bigint")
    n = F.col("n_docs")
    rows = counted.select(
        "length",
        "n_docs",
        F.coalesce(F.sum(n).over(longer), zero).alias("n_longer"),
        F.coalesce(F.sum(n * F.col("length")).over(longer), zero).alias("tokens_longer"),
        F.sum(n).over(every).alias("__docs"),
        F.sum(n * F.col("length")).over(every).alias("total_tokens"),
    )
    kept = F.col("total_tokens") - F.col("tokens_longer") + F.col("length") * F.col("n_longer")
    return rows.select(
        "length",
        "n_docs",
        "n_longer",
        "tokens_longer",
        "total_tokens",
        kept.alias("truncated_tokens"),
        (F.col("total_tokens") - kept).alias("cut_tokens"),
        ((F.col("__docs") - F.col("n_longer")) / F.col("__docs")).alias("share_fitting"),
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Documents and ids beyond each limit, and the ids left when documents are cut there."""
    long = F.col("length") > F.col("limit")
    n = F.col("n_docs")
    asked = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits]))
    return (
        histogram.select("length", "n_docs", asked.alias("limit"))
        .groupBy("limit")
        .agg(
            F.coalesce(F.sum(F.when(long, n)), F.lit(0)).alias("n_longer"),
            F.sum(F.col("length") * n).alias("total_tokens"),
            F.sum(F.least("length", "limit") * n).alias("truncated_tokens"),
        )
    )


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed."""
    fits = [F.min(F.when(F.col("share_fitting") >= s, F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)]
    row = histogram.agg(*fits)
    pairs = [F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.share", "x.length")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with the suffix sums of every limit."""
    return length_histogram(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op3_token_counts": (op3_token_counts, None)}
