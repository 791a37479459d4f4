"""Token ids in files of patched frame-of-reference blocks.

Documents are range-partitioned by doc_id, encoded and written as file images of whole documents. In an image every
block of 256 ids stores its minimum, the differences packed at a bit width chosen by percentile, and the high bits of
the few larger differences in an exception list. An index holds where each block starts, so any run of ids is read
by decoding its blocks only.

An image, all numbers little-endian: ``PFR1``; documents, ids, blocks as unsigned 32-bit; doc_id (signed 64-bit, zero
where null), null flag (8-bit), ids (unsigned 32-bit) of each document; blocks + 1 byte positions (unsigned 32-bit);
blocks. A block: minimum (unsigned 32-bit), width (8-bit), exceptions (unsigned 16-bit), packed differences, exception
places (8-bit), exception values shifted right by the width (unsigned 32-bit). The last block is filled up with its
own minimum.

Defined cases: a null text is empty; an empty text has its end id only; null doc_ids come first; equal doc_ids are
ordered by text; an empty table gives an empty set of files. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record, scratch, table, text_slices
from .tokens import BATCH_BYTES, default_path, encoder

BLOCK = 256
#: Share of a block's differences that the packed width must hold; the rest are exceptions.
PERCENTILE = 0.95
#: An image ends with the document that reaches so many ids.
IDS_AN_IMAGE = 1 << 18
END_ID = 2

_MAGIC = b"PFR1"
_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("image_no", pa.int32()),
        ("start", pa.int64()),
        ("n_docs", pa.int64()),
        ("n_ids", pa.int64()),
        ("image", pa.binary()),
    ]
)
_WRITTEN = "part int, image_no int, start bigint, n_docs bigint, n_ids bigint, image binary"
_READ = pa.schema(
    [("part", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


# --- the codec -----------------------------------------------------------------------------------------------
def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if not values.size or values.max() < 1 << 16:
        return _SHORT_LENGTHS[values]
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


_SHORT_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of values, lowest first; eight values make ``width`` bytes. One row a block."""
    wide = np.uint32 if width <= 24 else np.uint64
    eight = np.ascontiguousarray(values.reshape(-1, 8).T).astype(wide) & wide((1 << width) - 1)
    out = np.empty((eight.shape[1], width), np.uint8)
    for j in range(width):
        low = 8 * j
        byte = np.zeros(eight.shape[1], wide)
        for i in range(low // width, min(7, (low + 7) // width) + 1):
            shift = i * width - low
            byte |= eight[i] << wide(shift) if shift >= 0 else eight[i] >> wide(-shift)
        out[:, j] = byte.astype(np.uint8)
    return out.reshape(len(values), -1)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    """The values of blocks from their packed bytes, one row a block."""
    wide = np.uint32 if width <= 24 else np.uint64
    parts = np.ascontiguousarray(data.reshape(-1, width).T).astype(wide)
    out = np.empty((parts.shape[1], 8), np.uint32)
    for i in range(8):
        low = i * width
        value = np.zeros(parts.shape[1], wide)
        for j in range(low // 8, (low + width - 1) // 8 + 1):
            shift = 8 * j - low
            value |= parts[j] << wide(shift) if shift >= 0 else parts[j] >> wide(-shift)
        out[:, i] = value & wide((1 << width) - 1)
    return out.reshape(len(data), -1)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[list[bytes], int]:
    """Blocks of unsigned 32-bit ids, and how many ids were exceptions."""
    n = len(ids)
    if not n:
        return [], 0
    count = -(-n // BLOCK)
    grid = np.empty(count * BLOCK, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[(count - 1) * BLOCK :].min()
    grid = grid.reshape(count, BLOCK)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    bits = _bit_lengths(diff)
    at = max(0, min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(bits, at, axis=1)[:, at]
    over = bits > width[:, None]
    spare = over.sum(axis=1)
    row, place = np.nonzero(over)
    high = (diff[row, place] >> width[row].astype(np.uint32)).astype("<u4").tobytes()
    places = place.astype(np.uint8).tobytes()
    ends = np.cumsum(spare).tolist()
    packed: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            data = _pack(diff[rows], w).tobytes()
            size = w * BLOCK // 8
            for i, own in enumerate(rows.tolist()):
                packed[own] = data[i * size : (i + 1) * size]
    out = []
    for lowest, w, n, end, data in zip(low.tolist(), width.tolist(), spare.tolist(), ends, packed):
        block = struct.pack("<IBH", lowest, w, n) + data
        out.append(block + places[end - n : end] + high[4 * (end - n) : 4 * end] if n else block)
    return out, ends[-1]


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` in ``data``."""
    out = np.zeros((len(starts), BLOCK), np.uint32)
    begins = starts.tolist()
    heads = [struct.unpack_from("<IBH", data, s) for s in begins]
    low, width, spare = (np.array(x, np.int64) for x in zip(*heads))
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            size = w * BLOCK // 8
            packed = b"".join([data[s + 7 : s + 7 + size] for s in starts[rows].tolist()])
            out[rows] = _unpack(np.frombuffer(packed, np.uint8).reshape(len(rows), size), w)
    for i in np.flatnonzero(spare).tolist():
        n, w = int(spare[i]), int(width[i])
        at = begins[i] + 7 + w * BLOCK // 8
        out[i, np.frombuffer(data, np.uint8, n, at)] += np.frombuffer(data, "<u4", n, at + n) << np.uint32(w)
    out += low.astype(np.uint32)[:, None]
    return out.reshape(-1)


def write_image(doc_ids: list[int | None], docs: list[bytes], percentile: float = PERCENTILE) -> bytes:
    """The file image of documents given as bytes of their ids."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    blocks, _ = pack_blocks(ids, percentile)
    n = len(docs)
    head = 16 + 13 * n + 4 * (len(blocks) + 1)
    starts = head + np.cumsum([0, *map(len, blocks)])
    return b"".join(
        [
            _MAGIC,
            struct.pack("<III", n, len(ids), len(blocks)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([len(d) // 4 for d in docs], "<u4").tobytes(),
            starts.astype("<u4").tobytes(),
            *blocks,
        ]
    )


class Image:
    """A file image: its documents, and any run of its ids."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a token file image")
        n, self.n_ids, self.n_blocks = struct.unpack_from("<III", data, 4)
        self.data = data
        nulls = np.frombuffer(data, np.uint8, n, 16 + 8 * n)
        self.doc_ids = [None if x else d for d, x in zip(np.frombuffer(data, "<i8", n, 16).tolist(), nulls)]
        self.lengths = np.frombuffer(data, "<u4", n, 16 + 9 * n).astype(np.int64)
        self.starts = np.frombuffer(data, "<u4", self.n_blocks + 1, 16 + 13 * n)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to ``stop``; only the blocks in between are decoded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        ids = unpack_blocks(self.data, self.starts[first:last].astype(np.int64))
        return ids[start - first * BLOCK : stop - first * BLOCK]


# --- in Spark ------------------------------------------------------------------------------------------------
def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, percentile: float = PERCENTILE) -> None:
    """Write the ids of all documents in ascending doc_id order as images, in Parquet files of Spark's writer.

    A part is a range of doc_id; ``start`` counts the ids before an image inside its part.
    """
    end = np.array([end_id], "<u4").tobytes()

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        names, held, size = [], [], 0

        def image():
            return record(
                _SCHEMA,
                part=[part],
                image_no=[number],
                start=[before],
                n_docs=[len(held)],
                n_ids=[size],
                image=[write_image(names, held, percentile)],
            )

        for batch in text_slices(batches, BATCH_BYTES):
            coded = encoder(tokenizer).encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded):
                names.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= IDS_AN_IMAGE:
                    yield image()
                    names, held, number, before, size = [], [], number + 1, before + size, 0
        if held:
            yield image()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(images, _WRITTEN).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of ``write_tokens``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "image"))):
                image = Image(data)
                raw = memoryview(image.read().astype("<u4").tobytes())
                ends = np.cumsum(image.lengths)
                begins = ends - image.lengths
                yield record(
                    _READ,
                    part=[part] * len(ends),
                    doc_id=image.doc_ids,
                    local=start + begins,
                    n_tokens=image.lengths,
                    ids_crc32=[zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())],
                )

    files = spark.read.schema(_WRITTEN).parquet(path)
    docs = files.select("part", "start", "image").mapInArrow(
        decode, "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # one row per part, at most as many as tasks wrote
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).selectExpr(
        "part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"
    )
    return docs.join(F.broadcast(totals), "part").select(
        "doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, default_path())
    return read_documents(spark, path)


QUERIES = {"op10_token_files": (op10_token_files, None)}
