"""Exact order statistics of large columns without sorting them.

A quantile sketch brackets each wanted rank, one counting scan proves the bracket, and only the distinct
values inside the bracket are grouped and ordered. Columns below ``direct`` rows skip the sketch.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .freq import long_form

DIRECT_ROWS = 1_000_000
ACCURACY = 2_000


@dataclass
class _Bracket:
    label: str
    low: int  # wanted zero-based ranks
    high: int
    start: float | None = None  # inclusive value range, None = open
    end: float | None = None
    below: int = 0  # rows under the range
    inside: int = 0  # rows in the range
    distinct: int = 0  # most distinct values the range can hold

    def holds(self, value: Column) -> Column:
        cond = value.isNotNull()
        if self.start is not None:
            cond = cond & (value >= self.start)
        if self.end is not None:
            cond = cond & (value <= self.end)
        return cond


def counts_of(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, int]:
    row = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(columns.values())]).first()
    return {label: row[i] for i, label in enumerate(columns)}


def _narrow(df: DataFrame, columns: Mapping[str, Column], wide: list[_Bracket]) -> None:
    """One sketch scan and one counting scan that shrink every bracket."""
    margin = 2.0 / ACCURACY
    # open brackets of one column share a sketch
    groups: dict[tuple, list[_Bracket]] = {}
    for b in wide:
        groups.setdefault((b.label, b.start, b.end), []).append(b)
    sketches = []
    for i, same in enumerate(groups.values()):
        value, span = columns[same[0].label], max(same[0].inside, 1)
        p = [
            min(1.0, max(0.0, edge))
            for b in same
            for edge in ((b.low - b.below) / span - margin, (b.high - b.below + 1) / span + margin)
        ]
        sketches.append(F.percentile_approx(F.when(same[0].holds(value), value), p, ACCURACY).alias(f"q{i}"))
    row = df.agg(*sketches).first()
    edges = {id(b): row[i][2 * k : 2 * k + 2] for i, same in enumerate(groups.values()) for k, b in enumerate(same)}
    # a sketch misplaces a rank by 1 / ACCURACY at most: that many rows lie strictly between the edges
    most = [b.high - b.low + 8 * b.inside // ACCURACY + 8 for b in wide]
    _prove(df, columns, wide, [edges[id(b)] for b in wide])
    for b, limit in zip(wide, most):
        b.distinct = min(b.distinct, limit)


def _prove(
    df: DataFrame, columns: Mapping[str, Column], wide: list[_Bracket], found: Sequence[Sequence[float]]
) -> None:
    """Count rows under and inside each proposed range, and adopt every edge that is proven right."""
    checks = []
    for i, b in enumerate(wide):
        value, (start, end) = columns[b.label], found[i]
        checks += [
            F.count(F.when(value < start, 1)).alias(f"lt{i}"),
            F.count(F.when(value <= end, 1)).alias(f"le{i}"),
        ]
    row = df.agg(*checks).first()
    for i, b in enumerate(wide):
        under, upto = row[f"lt{i}"], row[f"le{i}"]
        top = b.below + b.inside
        if under <= b.low:
            b.start, b.below = found[i][0], under
        if upto > b.high:
            b.end, top = found[i][1], upto
        b.inside = top - b.below
        b.distinct = 1 if b.start is not None and b.start == b.end else b.inside


def order_statistics(
    df: DataFrame,
    columns: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int],
    direct: int = DIRECT_ROWS,
    guesses: Mapping[str, tuple[float, float]] | None = None,
) -> dict[tuple[str, int], float]:
    """Value at each zero-based rank of each numeric expression (missing values are left out)."""
    found = order_positions(df, columns, ranks, counts, direct, guesses)
    return {key: value for key, (value, _, _) in found.items()}


def order_positions(
    df: DataFrame,
    columns: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int],
    direct: int = DIRECT_ROWS,
    guesses: Mapping[str, tuple[float, float]] | None = None,
) -> dict[tuple[str, int], tuple[float, int, int]]:
    """(value, rows below it, rows equal to it) at each zero-based rank of each numeric expression.

    ``guesses`` may propose a value range per label; it is proven like any other bracket.
    """
    brackets: list[_Bracket] = []
    for label, wanted in ranks.items():
        n = counts[label]
        if n == 0:
            continue
        for rank in sorted(set(wanted)):
            last = brackets[-1] if brackets and brackets[-1].label == label else None
            if last is not None and (rank <= last.high + 1 or n <= direct):
                last.high = max(last.high, rank)
            else:
                brackets.append(_Bracket(label, rank, rank, inside=n, distinct=n))
    if not brackets:
        return {}
    guessed = [b for b in brackets if b.label in (guesses or {}) and b.distinct > direct]
    if guessed:
        _prove(df, columns, guessed, [guesses[b.label] for b in guessed])
    for _ in range(6):
        wide = [b for b in brackets if b.distinct > direct]
        if not wide:
            break
        _narrow(df, columns, wide)
    inside = {str(i): F.when(b.holds(columns[b.label]), columns[b.label]) for i, b in enumerate(brackets)}
    counted = long_form(df, inside, "slot").groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("slot").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    picks, where = [], {}
    for i, b in enumerate(brackets):
        for rank in sorted(set(r for r in ranks[b.label] if b.low <= r <= b.high)):
            where[(b.label, rank)] = len(picks)
            hit = (F.col("slot") == str(i)) & (F.col("before") <= rank - b.below)
            place = F.struct("value", (F.col("before") + b.below).alias("below"), "n")
            picks.append(F.max(F.when(hit, place)).alias(f"p{len(picks)}"))
    row = counted.agg(*picks).first()
    return {key: tuple(row[i]) for key, i in where.items()}


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Sequence[float],
    counts: Mapping[str, int] | None = None,
    direct: int = DIRECT_ROWS,
) -> dict[str, dict[float, float]]:
    """Quantiles with linear interpolation between neighbouring values."""
    if not columns:
        return {}
    counts = counts or counts_of(df, columns)
    ranks = {
        label: [r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]
        for label, n in counts.items()
        if label in columns and n > 0
    }
    found = order_statistics(df, columns, ranks, counts, direct)
    out: dict[str, dict[float, float]] = {}
    for label in ranks:
        n = counts[label]
        out[label] = {}
        for p in probs:
            spot = (n - 1) * p
            low, high = found[(label, math.floor(spot))], found[(label, math.ceil(spot))]
            out[label][p] = low + (high - low) * (spot - math.floor(spot))
    return out
