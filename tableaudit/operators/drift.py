"""Chronological order, last rolling mean and drift between the early and the late half."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, quoted, value_of
from ..functions.tails import ks_p_by
from ..plans.aggregates import small_table
from ..plans.prefix import ROWS_PER_BUCKET, bucket_limits, bucket_of
from ..plans.quantiles import order_statistics
from .features import detect_datetime, parsed_time

#: later than any timestamp in microseconds that a double holds exactly: rows without a time come last
_NO_TIME = 9.0e15


def chronological(df: DataFrame, ts: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows sorted by time, unreadable times last."""
    return df.orderBy(parsed_time(df, ts).asc_nulls_last(), *[quoted(c).asc_nulls_last() for c in tiebreak])


def rolling_mean_last(
    df: DataFrame, ts: str, value: str, rows: int = 30, by: Sequence[str] = ()
) -> DataFrame:
    """Mean of the last ``rows`` rows in time order (ties by value), missing values skipped: ``rolling_mean_last``.

    Each task keeps only its own last rows before anything is shuffled, also for one key with most rows.
    """
    slim = df.select(*[quoted(k) for k in by], parsed_time(df, ts).alias("__ts"), value_of(df, value).alias("__v"))
    order = [F.col("__ts").desc_nulls_first(), F.col("__v").desc_nulls_first()]
    mean = F.round(F.avg("__v"), 4).alias("rolling_mean_last")
    if not by:
        return slim.orderBy(*order).limit(rows).agg(mean)
    last = slim.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(
        F.col("__n") <= rows
    )
    return last.groupBy(*by).agg(mean)


def drift_ks(
    df: DataFrame, ts: str, value: str, min_half: int = 5, rows_per_bucket: int = ROWS_PER_BUCKET, method: str = "auto"
) -> DataFrame:
    """Kolmogorov-Smirnov test between the first ``n // 2`` rows in time order and the rest.

    ``(n_early, n_late, ks_stat, ks_pvalue, drift_detected)``. The cut is an exact order statistic of the
    time, so no row is sorted; rows at the cut time are split by value. Both distribution functions come
    from value counts. NULL results when a half has fewer than ``min_half`` values. ``method`` names the p value: ``exact``
    path counts, the ``limit`` distribution, or ``auto``: counts up to 10 000 values a half.
    """
    flat = df.select(
        F.coalesce(F.unix_micros(parsed_time(df, ts)).cast("double"), F.lit(_NO_TIME)).alias("t"),
        value_of(df, value).alias("value"),
    )
    n = flat.count()
    mid = n // 2
    cut = _cut(flat, mid, n) if mid else None
    table = small_table(df.sparkSession, [], "column string, distance double, n_early double, n_late double")
    if cut is not None and min(cut["early"], cut["late"]) >= min_half:
        table = _distance(flat, cut, rows_per_bucket)
    p = ks_p_by[method](F.col("distance"), F.col("n_early"), F.col("n_late"))
    tested = table.withColumn("__p", p)
    result = tested.select(
        F.col("n_early").cast("long").alias("n_early"),
        F.col("n_late").cast("long").alias("n_late"),
        F.round("distance", 4).alias("ks_stat"),
        F.round("__p", 4).alias("ks_pvalue"),
        (F.col("__p") < 0.05).alias("drift_detected"),
    )
    if cut is not None and min(cut["early"], cut["late"]) >= min_half:
        return result
    empty = [(cut["early"] if cut else 0, cut["late"] if cut else 0, None, None, False)]
    schema = "n_early bigint, n_late bigint, ks_stat double, ks_pvalue double, drift_detected boolean"
    return small_table(df.sparkSession, empty, schema)


def _cut(flat: DataFrame, mid: int, n: int) -> dict:
    """Cut time, rows of the cut time that belong to the early half, and the number of values per half."""
    t, v = F.col("t"), F.col("value")
    at = order_statistics(flat, {"t": t}, {"t": [mid - 1]}, {"t": n})[("t", mid - 1)]
    row = flat.agg(
        F.count_if(t < at).alias("below"),
        F.count_if(t == at).alias("ties"),
        F.count_if((t < at) & v.isNotNull()).alias("early"),
        F.count_if((t == at) & v.isNotNull()).alias("tied"),
        F.count(v).alias("all"),
    ).first()
    take = min(mid - row["below"], row["tied"])  # missing values come last among equal times
    early = row["early"] + take
    return {"at": at, "take": take, "tied": row["tied"], "early": early, "late": row["all"] - early}


def _distance(flat: DataFrame, cut: dict, rows_per_bucket: int) -> DataFrame:
    t, v = F.col("t"), F.col("value")
    limits = bucket_limits(flat, {"v": v}, {"v": cut["early"] + cut["late"]}, rows_per_bucket)
    counts = (
        flat.where(v.isNotNull())
        .groupBy("value")
        .agg(
            F.count_if(t < cut["at"]).alias("early"),
            F.count_if(t == cut["at"]).alias("tie"),
            F.count_if(t > cut["at"]).alias("late"),
        )
        .withColumn("bucket", bucket_of(F.lit("v"), v, limits))
    )
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = ("early", "tie", "late")
    starts = counts.groupBy("bucket").agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    starts = starts.select(
        "bucket", *[F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"s_{c}") for c in names]
    )
    inside = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(starts, "bucket") if limits else counts.withColumns({f"s_{c}": F.lit(0) for c in names})
    upto = rows.select(*[(F.col(f"s_{c}") + F.sum(c).over(inside)).alias(c) for c in names])
    # the tied rows with the smallest values fill up the early half
    tie_early = F.least(F.col("tie"), F.lit(cut["take"]))
    early, late = F.col("early") + tie_early, F.col("late") + F.col("tie") - tie_early
    n1, n2 = float(cut["early"]), float(cut["late"])
    return upto.agg(F.max(F.abs(early / n1 - late / n2)).alias("distance")).select(
        "distance", F.lit(n1).alias("n_early"), F.lit(n2).alias("n_late")
    )


def temporal_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: time column, its range, and rolling mean and drift of the first numeric column.

    Without a time column every field is NULL and ``has_datetime`` is false.
    """
    skip = [target] if target else []
    found = detect_datetime(df, exclude=skip)
    schema = (
        "has_datetime boolean, date_col string, metric string, rolling_mean_last double, ks_stat double, "
        "ks_pvalue double, drift_detected boolean"
    )
    spark = df.sparkSession
    if not found:
        empty = small_table(spark, [(False, None, None, None, None, None, False)], schema)
        return empty.withColumns({"first_time": F.lit(None).cast("timestamp"), "last_time": F.lit(None).cast("timestamp")})
    ts = found[0]
    metric = next(iter(numeric_columns(df, exclude=skip, flags=False)), None)
    mean = stat = p = None
    drift = False
    if metric is not None:
        mean = rolling_mean_last(df, ts, metric).first()[0]
        row = drift_ks(df, ts, metric).first()
        stat, p, drift = row["ks_stat"], row["ks_pvalue"], row["drift_detected"]
    when = parsed_time(df, ts)
    span = df.agg(F.min(when).alias("first_time"), F.max(when).alias("last_time"))
    facts = (True, ts, metric, mean, stat, p, drift)
    fields = [part.split() for part in schema.split(", ")]
    literals = [F.lit(x).cast(kind).alias(name) for x, (name, kind) in zip(facts, fields)]
    return span.select(*literals, "first_time", "last_time")
