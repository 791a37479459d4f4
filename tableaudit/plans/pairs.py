"""Pairwise-complete moments of many column pairs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import safe_corr

#: more pairs than this are accumulated as matrix products instead of single aggregates
MATRIX_PAIRS = 12
_PAIRS_PER_AGGREGATE = 8


def all_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def _by_expressions(df, columns, pairs, keys) -> DataFrame:
    parts = []
    width = max(_PAIRS_PER_AGGREGATE, -(-len(pairs) // 8))
    for start in range(0, len(pairs), width):
        chunk = pairs[start : start + width]
        used = list(dict.fromkeys(c for pair in chunk for c in pair))
        flat = df.select(*keys, *[columns[c].alias(f"x{i}") for i, c in enumerate(used)])
        aggs, rows = [], []
        for i, (a, b) in enumerate(chunk):
            x, y = F.col(f"x{used.index(a)}"), F.col(f"x{used.index(b)}")
            x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
            aggs += [
                F.count(x).alias(f"n{i}"),
                F.covar_pop(x, y).alias(f"c{i}"),
                F.var_pop(x).alias(f"a{i}"),
                F.var_pop(y).alias(f"b{i}"),
            ]
            rows.append(
                F.struct(
                    F.lit(start + i).alias("pair"),
                    F.lit(a).alias("col1"),
                    F.lit(b).alias("col2"),
                    F.col(f"n{i}").alias("n_eff"),
                    F.col(f"c{i}").alias("cov"),
                    F.col(f"a{i}").alias("var1"),
                    F.col(f"b{i}").alias("var2"),
                )
            )
        wide = flat.groupBy(*keys).agg(*aggs) if keys else flat.agg(*aggs)
        parts.append(wide.select(*keys, F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def _by_matrices(df: DataFrame, columns: Mapping[str, Column], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Each task adds up cross products of its rows as matrices; only k x k sums are shuffled."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    flat = df.select(*[columns[c].alias(f"x{i}") for i, c in enumerate(names)])
    finite = [F.when(F.abs(f"x{i}") < float("inf"), F.col(f"x{i}")) for i in range(len(names))]
    means = flat.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(finite)]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])
    first = np.array([names.index(a) for a, _ in pairs])
    second = np.array([names.index(b) for _, b in pairs])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        total = {s: np.zeros((k, k)) for s in ("n", "x", "xx", "xy", "spoiled")}
        seen = False
        for batch in batches:
            seen = True
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            mask = (~np.isnan(x)).astype(float)
            # an infinite value is present: it counts, and leaves its pairs without a correlation
            x = np.where(np.isinf(x), np.nan, x) - centre
            x[mask == 0] = 0.0
            spoiled = np.isnan(x)
            if spoiled.any():
                total["spoiled"] += spoiled.astype(float).T @ mask
                x[spoiled] = 0.0
            total["n"] += mask.T @ mask
            total["x"] += x.T @ mask
            total["xx"] += (x * x).T @ mask
            total["xy"] += x.T @ x
        if seen:
            # an infinite value in either column spoils the cross moment, one in a column its own moments
            own, other = total["spoiled"], total["spoiled"].T
            total["x"][own > 0] = np.nan
            total["xx"][own > 0] = np.nan
            total["xy"][(own > 0) | (other > 0)] = np.nan
            yield pa.RecordBatch.from_pydict(
                {
                    "pair": np.arange(len(pairs), dtype=np.int32),
                    "col1": [a for a, _ in pairs],
                    "col2": [b for _, b in pairs],
                    "n": total["n"][first, second],
                    "sx": total["x"][first, second],
                    "sy": total["x"][second, first],
                    "sxx": total["xx"][first, second],
                    "syy": total["xx"][second, first],
                    "sxy": total["xy"][first, second],
                }
            )

    schema = "pair int, col1 string, col2 string, n double, sx double, sy double, sxx double, syy double, sxy double"
    added = flat.mapInArrow(sums, schema).groupBy("pair", "col1", "col2").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )

    def central(cross: str, left: str, right: str) -> Column:
        n = F.col("n")
        return F.try_divide(F.col(cross), n) - F.try_divide(F.col(left), n) * F.try_divide(F.col(right), n)

    return added.select(
        "pair",
        "col1",
        "col2",
        F.col("n").cast("long").alias("n_eff"),
        central("sxy", "sx", "sy").alias("cov"),
        # a constant column leaves rounding dust instead of an exact zero
        _dust_free(central("sxx", "sx", "sx"), F.try_divide(F.col("sxx"), F.col("n"))).alias("var1"),
        _dust_free(central("syy", "sy", "sy"), F.try_divide(F.col("syy"), F.col("n"))).alias("var2"),
    )


def _dust_free(variance: Column, size: Column) -> Column:
    return F.when(variance <= size * 1e-14, 0.0).otherwise(variance)


def pair_moments(
    df: DataFrame,
    columns: Mapping[str, Column],
    pairs: Sequence[tuple[str, str]] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``(keys..., pair, col1, col2, n_eff, cov, var1, var2, r)`` over rows where both columns are present.

    ``r`` is NULL when a column has no spread.
    """
    pairs = list(pairs) if pairs is not None else all_pairs(list(columns))
    if not pairs:
        raise ValueError("no column pairs")
    if len(pairs) > MATRIX_PAIRS and not keys:
        out = _by_matrices(df, columns, pairs)
    else:
        out = _by_expressions(df, columns, pairs, list(keys))
    return out.withColumn("r", safe_corr(F.col("cov"), F.col("var1"), F.col("var2")))
