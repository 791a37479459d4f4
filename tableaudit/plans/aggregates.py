"""One aggregate over the table, reshaped to one row per column."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quoted


#: aggregates per pass that still compile to one fast method, and the most passes a wide table is cut into
_AGGREGATES = 32
_PASSES = 8


def pass_width(columns: int, aggregates: int) -> int:
    """Columns per pass: few enough for compact generated code, but never more than ``_PASSES`` passes."""
    return max(1, _AGGREGATES // max(aggregates, 1), -(-columns // _PASSES))


def per_column(
    df: DataFrame, stats: Mapping[str, Mapping[str, Column]], keys: Sequence[str] = (), width: int | None = None
) -> DataFrame:
    """``stats[column][name]`` aggregates as rows ``(keys..., position, column, name...)``.

    Columns are aggregated side by side, a few at a time to keep generated code small. The passes run side
    by side too, and each reads only its own columns, so a wide table is still read once in total.
    """
    names = list(stats)
    if not names:
        raise ValueError("no columns to aggregate")
    width = width or pass_width(len(names), len(stats[names[0]]))
    parts = []
    for start in range(0, len(names), width):
        chunk = names[start : start + width]
        flat = [expr.alias(f"s{i}_{stat}") for i, c in enumerate(chunk) for stat, expr in stats[c].items()]
        wide = df.groupBy(*[quoted(k) for k in keys]).agg(*flat) if keys else df.agg(*flat)
        rows = [
            F.struct(
                F.lit(start + i).alias("position"),
                F.lit(c).alias("column"),
                *[F.col(f"s{i}_{stat}").alias(stat) for stat in stats[c]],
            )
            for i, c in enumerate(chunk)
        ]
        parts.append(wide.select(*[quoted(k) for k in keys], F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """Statistics that are already on the driver, as a literal inside the plan: no Python stage, known to be small."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    one = spark.range(0, 1, 1, 1).select(F.from_json(F.lit(text), f"array<struct<{schema}>>").alias("rows"))
    return one.select(F.inline("rows"))
