"""Best-fit packing of documents into sequences of a fixed number of ids, in bulk-synchronous steps.

Documents and gaps are kept in order of size. All documents of one length act in one step: their successor among the
gaps, the smallest gap that still holds them, takes as many as fit; which document goes to which gap is settled by
rank (the first document of the length to the first gap); the gaps are updated, and the step repeats with the next
successor until the length is placed or new sequences are opened. Steps run from the longest length down, so the
result is that of best-fit decreasing.

What the steps need is no more than how many documents have each length and how many sequences have each gap, in runs
of equal size: at most one row per length up to the capacity, however many documents there are. So the sweep over the
runs happens in one place, and Spark does the work that grows: encoding, counting, ranking documents within their
length, and giving each document its sequence by its rank.

Defined cases: a null text is empty, and an empty text is one piece with its end id only; repeated rows are packed
each; an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, record, table, text_slices
from .tokens import END_OF_DOCUMENT, default_path, encoder

CAPACITY = 2048
#: Text encoded at once: arrays of the encoder take many times as much, in every worker of an executor.
PACK_BYTES = 3_000_000
#: Documents of one length are ranked in groups of about so many.
RANK_GROUP = 500
#: Placement runs that may be broadcast; 40 bytes each.
BROADCAST_RUNS = 500_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, turn bigint"
_RUNS = "length bigint, first bigint, count bigint, sequence bigint, place bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_OF_DOCUMENT, ids: bool = False) -> DataFrame:
    """Pieces of all documents, each document ended by ``end_id``; longer ones are cut into pieces of ``capacity``.

    The first piece of a cut document takes what is left over. ``turn`` numbers pieces inside a task. With ``ids`` the
    ids themselves are kept too, as bytes.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "turn"] + ["ids"] * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids
    schema = pa.schema(list(zip(names, kinds)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in text_slices(batches, PACK_BYTES):
            rows: list[tuple] = []
            coded = encoder(tokenizer).encode(batch.column("text").to_pylist())
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), coded):
                data += end
                total = len(data) // 4
                edges = [0, *range(total % capacity or capacity, total + 1, capacity)] if total > capacity else [0, total]
                for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    part = data[4 * a : 4 * b]
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(part), turn, *([part] if ids else [])))
                    turn += 1
            if rows:
                yield record(schema, **dict(zip(names, zip(*rows))))

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, _PIECES + ", ids binary" * ids)


def best_fit_runs(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placement runs (length, first, count, sequence, place) for ``counts`` documents of each length.

    The documents ranked ``first`` to ``first + count - 1`` of a length go to as many sequences from ``sequence`` on,
    at ``place`` in each.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, count)
    sizes: list[int] = []  # those with runs, ascending
    runs, opened = [], 0

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(gap: int, first: int, count: int, each: int) -> None:
            """Place ``each`` documents in every one of ``count`` sequences that have ``gap``."""
            nonlocal rank, left
            for i in range(each):
                runs.append((length, rank, count, first, capacity - gap + i * length))
                rank, left = rank + count, left - count
            add(gap - each * length, first, count)

        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            each = gap // length
            full = min(count, left // each)
            some = 1 if full < count and left > full * each else 0
            # the sequence with some of them comes last, those without any stay
            rest = left - full * each
            add(gap, first + full + some, count - full - some)
            if full:
                fill(gap, first, full, each)
            if some:
                fill(gap, first + full, 1, min(each, rest))
    return runs


def ranked(pieces: DataFrame, counts: Mapping[int, int]) -> DataFrame:
    """Add ``rank`` from 0 among the pieces of one length, by doc_id inside groups that split frequent lengths."""
    spark = pieces.sparkSession
    # one row per length, at most as many as the capacity
    groups = spark.createDataFrame([(k, -(-n // RANK_GROUP)) for k, n in counts.items()], "length bigint, __groups bigint")
    rows = pieces.join(F.broadcast(groups), "length").withColumn(
        "__group", F.pmod(F.xxhash64("doc_id", "piece", "turn"), F.col("__groups"))
    )
    sizes = rows.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__group").orderBy("doc_id", "piece", "turn")
    numbered = rows.withColumn("__inside", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, ["length", "__group"])
    return joined.withColumn("rank", F.col("__before") + F.col("__inside")).drop("__group", "__groups", "__before", "__inside")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_OF_DOCUMENT, ids: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids.

    Sequences are numbered from 0 and filled without holes from offset 0 on. Pieces are written once to the shared
    folder, since counting and placing must see the same ones.
    """
    pieces = keep(cut_pieces(docs, tokenizer, capacity, end_id, ids))
    # one row per length, at most ``capacity`` rows
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = best_fit_runs(counts, capacity)
    spark = docs.sparkSession
    placed = spark.createDataFrame(runs, _RUNS).withColumnRenamed("length", "__length")
    if len(runs) <= BROADCAST_RUNS:
        placed = F.broadcast(placed)
    rank = F.col("rank")
    inside = (F.col("length") == F.col("__length")) & (rank >= F.col("first")) & (rank < F.col("first") + F.col("count"))
    out = ranked(pieces, counts).join(placed, inside)
    return out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + rank - F.col("first")).alias("sequence_id"),
        F.col("place").alias("offset"),
        *(["ids"] if ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence and where its pieces begin, from ``pack(..., ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("sequence_id").to_pylist(), batch.column("parts").to_pylist())
            done = [
                (s, np.frombuffer(b"".join(x["ids"] for x in p), "<u4").tolist(), [x["offset"] for x in p], [x["doc_id"] for x in p])
                for s, p in rows
            ]
            schema = pa.schema(
                [("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64()))]
            )
            if done:
                yield record(schema, **dict(zip(schema.names, zip(*done))))

    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.mapInArrow(join, "sequence_id bigint, ids array<int>, starts array<bigint>, doc_ids array<bigint>")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of all documents."""
    return pack(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op9_best_fit_packing": (op9_best_fit_packing, None)}
