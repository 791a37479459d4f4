"""Joining rows to a lookup table when a few keys may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialise import materialise

#: a key holding more than one part in this many of the rows is joined without a shuffle
HOT_SHARE = 64
#: rows that one task can take whatever their keys
EASY_ROWS = 1_000_000


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    total: int,
    share: int = HOT_SHARE,
    easy_rows: int = EASY_ROWS,
) -> DataFrame:
    """Left join of rows to ``table``, which has one row per key and a column ``n`` with the rows it stands for.

    At most ``share`` keys can each hold more than ``1 / share`` of the ``total`` rows. Their rows, copies
    included, meet a broadcast of those few keys; only rows of other keys are shuffled. The table is used
    three times and kept in the checkpoint folder for that.
    """
    if total <= easy_rows:
        return rows.join(table.drop("n"), list(keys), "left")
    table = materialise(table)
    hot = table.where(F.col("n") * share > total).select(*keys).collect()
    table = table.drop("n")
    if not hot:
        return rows.join(table, list(keys), "left")

    def one(key) -> Column:
        return reduce(Column.__and__, [F.col(k) == F.lit(key[k]) for k in keys])

    is_hot = F.coalesce(reduce(Column.__or__, [one(k) for k in hot]), F.lit(False))
    few = table.where(is_hot)
    first = rows.where(is_hot).join(F.broadcast(few), list(keys), "left")
    return first.unionByName(rows.where(~is_hot).join(table, list(keys), "left"))
