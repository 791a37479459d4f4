"""Threshold scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scale(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower limit is reached."""
    out = None
    for limit, label in steps:
        out = F.when(value >= limit, label) if out is None else out.when(value >= limit, label)
    return out.otherwise(otherwise)


def missing_severity(pct: Column) -> Column:
    return _scale(pct, [(40.0, "critical"), (20.0, "high"), (5.0, "moderate")], "low")


def missing_level(pct: Column) -> Column:
    """The older three-step scale."""
    return (
        F.when(pct > 40.0, "HIGH (>40%)").when(pct >= 1.0, "MODERATE (1-40%)").otherwise("LOW (<1%)")
    )


def duplicate_severity(pct: Column) -> Column:
    return _scale(pct, [(10.0, "high"), (2.0, "moderate")], "low")


def outlier_severity(pct: Column) -> Column:
    return _scale(pct, [(10.0, "critical"), (5.0, "high"), (1.0, "moderate")], "low")


def skew_severity(skew: Column) -> Column:
    size = F.abs(skew)
    return F.when(size > 1.0, "strongly_skewed").when(size > 0.5, "moderately_skewed").otherwise("symmetric")


def correlation_strength(r: Column) -> Column:
    return _scale(F.abs(r), [(0.7, "strong"), (0.3, "moderate")], "weak")


def imbalance_severity(ratio: Column) -> Column:
    return F.when(ratio < 0.2, "severe").when(ratio < 0.5, "moderate").otherwise("balanced")


def grade(score: Column) -> Column:
    return _scale(score, [(95.0, "A+"), (90.0, "A"), (80.0, "B"), (70.0, "C"), (60.0, "D")], "F")
