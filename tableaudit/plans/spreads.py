"""Quartiles, median deviation and outliers of many groups at once.

A group is one combination of key columns, such as (segment, column). Groups of up to ``direct`` rows are counted by
value in one shuffle; running totals over the values of a group give its quartiles, running totals over the distances from
the median its median deviation, and the same rows the outliers. Larger groups, of which there can be no more than rows /
``direct``, are never gathered: sketches of all of them propose value ranges around the wanted ranks, counting scans
prove the ranges, and only the values inside are counted by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialise import materialise
from .quantiles import DIRECT_ROWS

#: tables of at most this many groups are sent to all tasks
BROADCAST_GROUPS = 100_000
#: points of a sketch that may become limits of a range, and its accuracy
_GRID = 512
_ACCURACY = 4096
_ROUNDS = 6


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    """Zero-based ranks on both sides of a quantile."""
    spot = (n - 1) * p
    return F.floor(spot).cast("bigint"), F.ceil(spot).cast("bigint")


def _between(low: Column, high: Column, n: Column, p: float) -> Column:
    spot = (n - 1) * p
    return low + (high - low) * (spot - F.floor(spot))


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows beside the one row of ``table`` for their group; a table of few groups is broadcast."""
    few = table.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(table) if few else table, list(keys), how)


def outlier_flags(
    value: Column, s: dict[str, Column], mad_limit: float = 3.5, fence: float = 1.5
) -> tuple[Column, Column]:
    """(modified z score beyond ``mad_limit``, outside the quartile fences) beside columns with the spread."""
    iqr = s["q75"] - s["q25"]
    far = F.when(s["mad"] > 0, 0.6745 * F.abs(value - s["median"]) / s["mad"] > mad_limit).otherwise(False)
    return far, (value < s["q25"] - fence * iqr) | (value > s["q75"] + fence * iqr)


def spreads(
    long: DataFrame,
    keys: Sequence[str],
    sizes: DataFrame | None = None,
    mad_limit: float = 3.5,
    fence: float = 1.5,
    direct: int = DIRECT_ROWS,
) -> DataFrame:
    """``(keys..., n, q25, median, q75, mad, mad_count, iqr_count, total_outliers)`` of ``value`` in every group.

    ``long`` has the key columns, never null, and a double ``value``. ``sizes`` may give ``(keys..., n)``, if known.
    """
    keys = list(keys)
    if sizes is None:
        sizes = long.groupBy(*keys).agg(F.count("value").alias("n"))
    sizes = materialise(sizes.where(F.col("n") > 0).select(*keys, "n"))
    large = materialise(sizes.where(F.col("n") > direct))
    long = long.select(*keys, "value").where(F.col("value").isNotNull())
    if large.isEmpty():
        return counted_spreads(long, keys, mad_limit, fence)
    found = _bracketed(long, large, keys, mad_limit, fence, direct)
    if sizes.where(F.col("n") <= direct).isEmpty():  # no scan for the rest
        return found
    few = large.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rest = long.join(F.broadcast(large) if few else large, keys, "left_anti")
    return counted_spreads(rest, keys, mad_limit, fence).unionByName(found)


def counted_spreads(
    long: DataFrame, keys: Sequence[str], mad_limit: float = 3.5, fence: float = 1.5
) -> DataFrame:
    """``spreads`` of groups that a task can hold, from one table of value counts.

    Every window has the partitioning of the first, so the counts are shuffled once more and no more.
    """
    keys = list(keys)
    group = Window.partitionBy(*keys)
    before = lambda order: F.coalesce(
        F.sum("c").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    at = lambda x, rank: F.max(F.when(F.col("below") <= rank, F.col(x))).over(group)
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    rows = counts.withColumns({"n": F.sum("c").over(group), "below": before("value")})
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    rows = rows.withColumns(
        {c: _between(*[at("value", r) for r in _ranks(F.col("n"), p)], F.col("n"), p) for c, p in names.items()}
    )
    rows = rows.withColumn("away", F.abs(F.col("value") - F.col("median")))
    rows = rows.withColumn("below", before("away"))
    rows = rows.withColumn("mad", _between(*[at("away", r) for r in _ranks(F.col("n"), 0.5)], F.col("n"), 0.5))
    far, out = outlier_flags(F.col("value"), {c: F.col(c) for c in ("q25", "median", "q75", "mad")}, mad_limit, fence)
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    return rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "q25", "median", "q75", "mad")],
        count(far).alias("mad_count"),
        count(out).alias("iqr_count"),
        count(far | out).alias("total_outliers"),
    )


def _bracketed(
    long: DataFrame, large: DataFrame, keys: list[str], mad_limit: float, fence: float, direct: int
) -> DataFrame:
    quarts = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    table = materialise(group_quantiles(long, large, keys, quarts, direct))
    away = attach(long, table.select(*keys, "median"), keys)
    away = away.select(*keys, F.abs(F.col("value") - F.col("median")).alias("value"))
    mads = group_quantiles(away, large, keys, {"mad": 0.5}, direct)
    table = materialise(table.join(mads.drop("n"), keys))
    rows = attach(long, table, keys)
    far, out = outlier_flags(F.col("value"), {c: F.col(c) for c in ("q25", "median", "q75", "mad")}, mad_limit, fence)
    return rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "q25", "median", "q75", "mad")],
        F.count_if(far).alias("mad_count"),
        F.count_if(out).alias("iqr_count"),
        F.count_if(far | out).alias("total_outliers"),
    )


def group_quantiles(
    long: DataFrame, groups: DataFrame, keys: Sequence[str], probs: dict[str, float], direct: int = DIRECT_ROWS
) -> DataFrame:
    """``(keys..., n, quantiles...)`` of the groups in ``(keys..., n)``, exact, without gathering a group."""
    keys = list(keys)
    slots = F.array(
        *[
            F.struct(F.lit(name).alias("slot"), *[r.alias(a) for r, a in zip(_ranks(F.col("n"), p), ("low", "high"))])
            for name, p in probs.items()
        ]
    )
    open_end = F.lit(None).cast("double")
    state = groups.select(*keys, "n", F.inline(slots)).withColumns(
        {"start": open_end, "end": open_end, "under": F.lit(0).cast("bigint"), "inside": F.col("n"), "distinct": F.col("n")}
    )
    state = materialise(state)
    for _ in range(_ROUNDS):
        if state.where(F.col("distinct") > direct).isEmpty():
            break
        state = materialise(_narrowed(long, state, keys, direct, list(probs)))
    inside = _held(long, state, keys, list(probs)).groupBy(*keys, "slot", "value").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys, "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside.withColumn("below", F.coalesce(F.sum("c").over(order), F.lit(0)))
    ranked = ranked.join(state.select(*keys, "slot", "n", "low", "high", "under"), [*keys, "slot"])
    at = lambda rank: F.max(F.when(F.col("below") + F.col("under") <= F.col(rank), F.col("value")))
    found = ranked.groupBy(*keys, "n", "slot").agg(at("low").alias("a"), at("high").alias("b"))
    spot = {name: _between(F.col("a"), F.col("b"), F.col("n"), p) for name, p in probs.items()}
    return found.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("slot") == name, value)).alias(name) for name, value in spot.items()]
    )


def _wide(state: DataFrame, keys: list[str], slots: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group: each of ``columns`` as one column per slot, null where the group has no such slot."""
    return state.groupBy(*keys).agg(
        *[F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"__{c}{i}") for i, s in enumerate(slots) for c in columns],
        *[F.bool_or(F.col("slot") == s).alias(f"__is{i}") for i, s in enumerate(slots)],
    )


def _held(long: DataFrame, state: DataFrame, keys: list[str], slots: Sequence[str]) -> DataFrame:
    """``(keys..., slot, value)`` of the values inside each range; rows outside all of them are dropped first."""
    rows = attach(long, _wide(state, keys, slots, ["start", "end"]), keys)
    value = F.col("value")
    holds = [
        F.coalesce(
            F.col(f"__is{i}")
            & (F.col(f"__start{i}").isNull() | (value >= F.col(f"__start{i}")))
            & (F.col(f"__end{i}").isNull() | (value <= F.col(f"__end{i}"))),
            F.lit(False),
        )
        for i in range(len(slots))
    ]
    kept = rows.where(reduce(Column.__or__, holds)).select(*keys, "value", *[h.alias(f"__in{i}") for i, h in enumerate(holds)])
    cells = [F.when(F.col(f"__in{i}"), s) for i, s in enumerate(slots)]
    return kept.select(*keys, F.stack(F.lit(len(slots)), *cells).alias("slot"), "value").where(F.col("slot").isNotNull())


def _sketched(long: DataFrame, wide: DataFrame, keys: list[str], slots: Sequence[str]) -> DataFrame:
    """``(keys..., slot, __grid)`` of the values in each range; slots whose range is open still share one sketch of the group."""
    grid = [i / _GRID for i in range(_GRID + 1)]
    sketch = F.percentile_approx("value", grid, _ACCURACY).alias("__grid")
    open_, cut = (wide.where(c) for c in (F.col("start").isNull() & F.col("end").isNull(), F.col("start").isNotNull() | F.col("end").isNotNull()))
    found = []
    if not open_.isEmpty():
        found.append(open_.select(*keys, "slot").join(attach(long, open_.select(*keys).distinct(), keys).groupBy(*keys).agg(sketch), keys))
    if not cut.isEmpty():
        found.append(_held(long, cut, keys, slots).groupBy(*keys, "slot").agg(sketch))
    return reduce(DataFrame.unionByName, found).select(*keys, "slot", "__grid")


def _narrowed(long: DataFrame, state: DataFrame, keys: list[str], direct: int, slots: Sequence[str]) -> DataFrame:
    """Ranges cut down by one sketch scan and one counting scan; each end is adopted only when the counts prove it."""
    wide = state.where(F.col("distinct") > direct)
    sketch = _sketched(long, wide, keys, slots)
    # a sketch misplaces a rank by 1 / accuracy at most
    slack = 2.0 / _ACCURACY
    share = lambda rank: (rank - F.col("under")) / F.col("inside")
    first = F.greatest(F.lit(0), F.floor((share(F.col("low")) - slack) * _GRID)).cast("int")
    last = F.least(F.lit(_GRID), F.ceil((share(F.col("high") + 1) + slack) * _GRID)).cast("int")
    proposed = wide.join(sketch, [*keys, "slot"]).withColumns(
        {"__from": F.get("__grid", first), "__to": F.get("__grid", last)}
    )
    proposed = materialise(proposed.drop("__grid"))
    rows = attach(long, _wide(proposed, keys, slots, ["__from", "__to"]), keys)
    value, counts, cells = F.col("value"), [], []
    for i, s in enumerate(slots):
        start, end = F.col(f"____from{i}"), F.col(f"____to{i}")
        counts += [
            F.count_if(value < start).alias(f"lt{i}"),
            F.count_if(value <= end).alias(f"le{i}"),
            F.count_if((value > start) & (value < end)).alias(f"mid{i}"),
        ]
        cells.append(F.struct(F.lit(s).alias("slot"), *[F.col(f"{c}{i}").alias(c) for c in ("lt", "le", "mid")]))
    counted = rows.groupBy(*keys).agg(*counts).select(*keys, F.inline(F.array(*cells)))
    left, right = F.col("lt") <= F.col("low"), F.col("le") > F.col("high")
    start, end = F.when(left, F.col("__from")).otherwise(F.col("start")), F.when(right, F.col("__to")).otherwise(F.col("end"))
    under = F.when(left, F.col("lt")).otherwise(F.col("under"))
    inside = F.when(right, F.col("le")).otherwise(F.col("under") + F.col("inside")) - under
    # both ends and the rows strictly between them; many rows may share the value of an end
    distinct = F.when(left & right, F.col("mid") + 2).otherwise(inside)
    cut = proposed.join(counted, [*keys, "slot"]).select(
        *keys, "n", "slot", "low", "high", start.alias("start"), end.alias("end"), under.alias("under"),
        inside.alias("inside"), distinct.alias("distinct"),
    )
    return cut.unionByName(state.where(F.col("distinct") <= direct))
