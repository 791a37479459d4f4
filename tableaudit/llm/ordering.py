"""Places and running totals in a total order over all rows, from per-partition totals.

Rows are dealt to range partitions, which are written once to the shared folder with their partition number. Totals of
the partitions give each one its offset, and a window inside a partition does the rest, so no task reads more than its
range. A number given to every row ends the sort keys: rows that are equal in all keys spread over many partitions too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep


def running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Add ``<name>`` for each of ``sums``: the total of its column over all rows that come earlier in ``order``.

    Rows that tie in ``order`` come in any order, which is the same in every later read. The columns to add up are whole
    numbers; null counts as 0. ``parts`` is the number of range partitions, by default that of shuffles.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__key{i}" for i in range(len(order))]
    numbered = rows.select(
        "*",
        *[c.alias(k) for c, k in zip(order, keys)],
        *[F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"__{name}") for name, c in sums.items()],
        F.monotonically_increasing_id().alias("__deal"),
    )
    dealt = keep(numbered.repartitionByRange(parts, *keys, "__deal").withColumn("__part", F.spark_partition_id()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = (
        dealt.groupBy("__part")
        .agg(*[F.sum(f"__{name}").alias(f"__sum_{name}") for name in sums])
        .select("__part", *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__from_{n}") for n in sums])
    )
    inside = Window.partitionBy("__part").orderBy(*keys, "__deal").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(
        *rows.columns, "__part", *[F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)).alias(f"__in_{n}") for n in sums]
    )
    return local.join(F.broadcast(offsets), "__part").select(
        *rows.columns, *[(F.col(f"__in_{n}") + F.col(f"__from_{n}")).alias(n) for n in sums]
    )
