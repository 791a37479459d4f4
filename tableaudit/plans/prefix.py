"""Running totals over ordered value counts, spread over many tasks.

Bucket limits come from a quantile sketch and enter the plan as literals. A row's bucket depends on its
value alone, so a lost executor can recompute any part and nothing needs to be pinned by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 16384
_FAN = 128


def bucket_limits(
    df: DataFrame,
    columns: Mapping[str, Column],
    counts: Mapping[str, int],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> dict[str, list[float]]:
    """Value limits that cut each large column into buckets of about ``rows_per_bucket`` rows."""
    big = {c: min(MAX_BUCKETS, -(-counts[c] // rows_per_bucket)) for c in columns if counts[c] > rows_per_bucket}
    if not big:
        return {}
    row = df.agg(
        *[
            F.percentile_approx(columns[c], [k / size for k in range(1, size)], max(1000, 10 * size)).alias(f"b{i}")
            for i, (c, size) in enumerate(big.items())
        ]
    ).first()
    return {c: sorted(set(row[i])) for i, c in enumerate(big)}


def bucket_of(label: Column, value: Column, limits: Mapping[str, Sequence[float]]) -> Column:
    """Number of limits below the value, searched in two steps."""
    if not limits:
        return F.lit(0)

    def lookup(table: Mapping[str, Column]) -> Column:
        return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)])[label]

    coarse = lookup({k: F.lit([float(x) for x in v[_FAN - 1 :: _FAN]] or [float("inf")]) for k, v in limits.items()})
    fine = lookup(
        {
            k: F.array(*[F.lit([float(x) for x in v[i : i + _FAN]]) for i in range(0, len(v), _FAN)])
            for k, v in limits.items()
        }
    )
    step = F.coalesce(F.size(F.filter(F.coalesce(coarse, F.array().cast("array<double>")), lambda x: x < value)), F.lit(0))
    rest = F.coalesce(F.get(fine, step), F.array().cast("array<double>"))
    return (step * _FAN + F.size(F.filter(rest, lambda x: x < value))).cast("int")


def running_totals(
    counts: DataFrame,
    sums: Sequence[str],
    limits: Mapping[str, Sequence[float]],
    label: str = "column",
    value: str = "value",
) -> DataFrame:
    """Add ``<sum>_before``: the total of each sum over all smaller values with the same label.

    ``counts`` must hold one row per (label, value).
    """
    rows = counts.withColumn("__bucket", bucket_of(F.col(label), F.col(value), limits))
    inside = Window.partitionBy(label, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    if not limits:
        out = rows.select("*", *[F.coalesce(F.sum(s).over(inside), zero).alias(f"{s}_before") for s in sums])
        return out.drop("__bucket")
    earlier = Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(label, "__bucket")
        .agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
        .select(label, "__bucket", *[F.coalesce(F.sum(f"__t_{s}").over(earlier), zero).alias(f"__o_{s}") for s in sums])
    )
    # the join and the window share one partitioning by (label, bucket)
    joined = rows.join(starts, [label, "__bucket"])
    return joined.select(
        *[c for c in rows.columns if c != "__bucket"],
        *[(F.coalesce(F.sum(s).over(inside), zero) + F.col(f"__o_{s}")).alias(f"{s}_before") for s in sums],
    )


def average_ranks(counts: DataFrame, limits: Mapping[str, Sequence[float]], label: str = "column") -> DataFrame:
    """Add ``rank``: the mean 1-based position of each value, ties shared."""
    return running_totals(counts, ["n"], limits, label).withColumn(
        "rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    )
