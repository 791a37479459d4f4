"""Integer codes for the values of a text column, in ascending order or in order of first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialise import materialise

SMALL_CODES = 100_000


def value_codes(
    df: DataFrame, value: Column, small: int = SMALL_CODES, order: Column | None = None
) -> tuple[DataFrame, bool]:
    """``(value, n, code)`` with codes 0, 1, ... and whether the table has few rows.

    Codes ascend by value, or by the smallest ``order`` of a value's rows.

    Many distinct values are sorted into ranges. The sorted table is checkpointed before its partitions are
    numbered, so that a recomputation cannot move a value to another range.
    """
    present = df.select(value.alias("value"), (F.lit(0) if order is None else order).alias("at"))
    present = present.where(F.col("value").isNotNull())
    distinct = present.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    by = ["at", "value"]
    if distinct.limit(small + 1).count() <= small:
        return distinct.select("value", "n", (F.row_number().over(Window.orderBy(*by)) - 1).alias("code")), True
    ranged = distinct.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged)
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return ranged.join(starts, "part").select("value", "n", (F.col("start") + inside - 1).alias("code")), False
