"""Statistics of one table that several operators need, each computed once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row

from ..plans.aggregates import small_table
from ..plans.pairs import pair_moments
from .distribution import moments, normality_from, numeric_values

_PAIRS = "pair int, col1 string, col2 string, n_eff bigint, cov double, var1 double, var2 double, r double"


class Facts:
    """Moments, normality and pair moments of the numeric columns: one row per column or pair, kept on the driver."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, order_col: str | None = None):
        self.df = df
        self.order_col = order_col
        self.values: dict[str, Column] = numeric_values(df, columns)

    @cached_property
    def moments(self) -> list[Row]:
        return moments(self.df, self.values).collect() if self.values else []

    @cached_property
    def normality(self) -> list[Row]:
        return normality_from(self.df, self.values, self.moments).collect() if self.values else []

    @cached_property
    def pairs(self) -> list[Row]:
        if len(self.values) < 2:
            return []
        return sorted(pair_moments(self.df, self.values).collect(), key=lambda r: r["pair"])

    @cached_property
    def levels(self) -> dict[str, list[str]]:
        """Values of the low-cardinality columns, in group order."""
        from .relations import category_values

        return category_values(self.df, order_col=self.order_col)

    def pair_table(self) -> DataFrame:
        rows = [tuple(r[part.split()[0]] for part in _PAIRS.split(", ")) for r in self.pairs]
        return small_table(self.df.sparkSession, rows, _PAIRS)
