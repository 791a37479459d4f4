"""Sharding by global byte-size prefix sums.

All rows are brought into the order of (doc_id, checksum, size). Totals of bytes and rows of every range partition give
the bytes and rows before each partition, running sums inside it those before each row. The row of ``size`` bytes with
``before`` bytes before it belongs to the shard in which its middle byte falls when all bytes are cut at equal targets:
shards are contiguous in the order, and each differs from its equal share by at most the size of the rows at its ends.

Defined cases: a null text has no bytes and the checksum 0, and counts with the fixed cost of a row, as an empty one
does; rows without a doc_id come first; repeated rows are rows of their own, next to each other, and a cut may fall
between them; equal texts need not share a shard under this law; a row larger than a whole share leaves the shards it
covers without rows; an empty table gives no rows; extra columns, also such as ``shard`` or ``size``, are not read by
the query, and ``place`` refuses tables that have a column of the names that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table
from .ordering import running

SHARDS = 24
#: Bytes that a row costs beside its text, as a length field does.
ROW_BYTES = 8
ADDED = ("size", "text_crc32", "shard", "slot")


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


def checksum_of(text: str = "text") -> Column:
    return F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint")


def place(docs: DataFrame, shards: int = SHARDS, text: str = "text", order: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with size, text_crc32, shard and slot (the row's place in its shard, from 0).

    The columns selected beforehand travel through one range shuffle, are written to the shared folder, and travel through
    one shuffle of partition numbers; where only the places are wanted, ``place_sized`` takes sizes and checksums alone.
    """
    if clash := set(ADDED) & {c.lower() for c in docs.columns}:
        raise ValueError(f"rename the columns {sorted(clash)}")
    return place_sized(docs.select("*", size_of(text).alias("size"), checksum_of(text).alias("text_crc32")), shards, order)


def place_sized(rows: DataFrame, shards: int = SHARDS, order: str = "doc_id") -> DataFrame:
    """``rows`` (with size and text_crc32) and their shard and slot."""
    placed = running(
        rows, [F.col(order), F.col("text_crc32"), F.col("size")], {"__bytes": F.col("size"), "__rows": F.lit(1)}
    )
    total = rows.agg(F.sum("size")).first()[0] or 1
    middle = (F.col("__bytes") * 2 + F.col("size")).cast("decimal(38,0)")
    cut = F.floor(middle * shards / F.lit(2 * total).cast("decimal(38,0)")).cast("int")
    sharded = placed.withColumn("shard", F.least(cut, F.lit(shards - 1)))
    # at most one row a shard
    first = sharded.groupBy("shard").agg(F.min("__rows").alias("__first"))
    return sharded.join(F.broadcast(first), "shard").select(
        *rows.columns, "shard", (F.col("__rows") - F.col("__first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` below ``path``, one folder ``shard=N`` each, its files in the order of slots.

    A shard is spread over tasks by runs of slots, so a shard of any size is written by many tasks.
    """
    placed = place(docs, shards)
    run = F.floor(F.col("slot") / rows_per_file)
    dealt = placed.repartition(F.col("shard"), run).sortWithinPartitions("shard", "slot")
    dealt.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot under the law of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    # written once, so that texts are read once: range limits are taken from a sample of their own
    sized = keep(docs.select("doc_id", size_of().alias("size"), checksum_of().alias("text_crc32")))
    return place_sized(sized).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: crc32 from its definition: the reflected polynomial 0xEDB88320 over all bytes.
CRC_SQL = """
step(i, k, c) AS (
    SELECT i, 0, i::BIGINT FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY i) AS crc_of FROM step WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of a text, beside ``crc_table``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


_SQL = f"""
WITH RECURSIVE {CRC_SQL},
sized AS (
    SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + {ROW_BYTES} AS size,
           {crc_sql("coalesce(text, '')")}::BIGINT AS text_crc32
    FROM documents, crc_table
),
before AS (
    SELECT *, row_number() OVER o AS place, sum(size) OVER o - size AS earlier, sum(size) OVER () AS total
    FROM sized WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
),
cut AS (SELECT *, least(((2 * earlier + size) * {SHARDS}) // (2 * total), {SHARDS - 1})::INTEGER AS shard FROM before)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

QUERIES = {"op11_shards": (op11_shards, _SQL)}
