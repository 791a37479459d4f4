"""Moment statistics as column expressions over n, mean and Spark's biased skewness and kurtosis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness; 0 for fewer than 3 values or no spread."""
    return F.when(
        n > 2, F.coalesce(g1, F.lit(0.0)) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))
    ).otherwise(0.0)


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for fewer than 4 values or no spread."""
    top = (n - 1.0) * ((n + 1.0) * g2 + 6.0)
    return F.when(
        n > 3, F.when(g2.isNotNull(), F.try_divide(top, (n - 2.0) * (n - 3.0))).otherwise(0.0)
    ).otherwise(0.0)


def skewness_score(n: Column, g1: Column) -> Column:
    """Normal score of the skewness (D'Agostino 1970)."""
    y = g1 * F.sqrt(F.try_divide((n + 1) * (n + 3), 6.0 * (n - 2)))
    b2 = F.try_divide(
        3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3), (n - 2) * (n + 5) * (n + 7) * (n + 9)
    )
    w2 = F.sqrt(2.0 * (b2 - 1)) - 1
    delta = F.try_divide(F.lit(1.0), F.sqrt(0.5 * F.log(w2)))
    alpha = F.sqrt(F.try_divide(F.lit(2.0), w2 - 1))
    return delta * F.asinh(F.try_divide(F.when(y == 0, 1.0).otherwise(y), alpha))


def kurtosis_score(n: Column, g2: Column) -> Column:
    """Normal score of the kurtosis (Anscombe and Glynn 1983)."""
    b2 = g2 + 3.0
    mean = F.try_divide(3.0 * (n - 1), n + 1)
    var = F.try_divide(24.0 * n * (n - 2) * (n - 3), (n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = F.try_divide(b2 - mean, F.sqrt(var))
    root_b1 = F.try_divide(6.0 * (n * n - 5 * n + 2), (n + 7) * (n + 9)) * F.sqrt(
        F.try_divide(6.0 * (n + 3) * (n + 5), n * (n - 2) * (n - 3))
    )
    a = 6.0 + F.try_divide(F.lit(8.0), root_b1) * (
        F.try_divide(F.lit(2.0), root_b1) + F.sqrt(1.0 + F.try_divide(F.lit(4.0), root_b1 * root_b1))
    )
    denom = 1.0 + x * F.sqrt(F.try_divide(F.lit(2.0), a - 4))
    term = F.signum(denom) * F.cbrt(F.try_divide(1.0 - F.try_divide(F.lit(2.0), a), F.abs(denom)))
    spread = F.try_divide(F.lit(2.0), 9.0 * a)
    return F.try_divide(1.0 - spread - term, F.sqrt(spread))


def omnibus(n: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """(K squared, p value) of the D'Agostino-Pearson test; the p value is the chi-square tail with 2 df."""
    n = n.cast("double")
    stat = F.pow(skewness_score(n, g1), 2) + F.pow(kurtosis_score(n, g2), 2)
    return stat, F.exp(-stat / 2)


def safe_corr(sxy: Column, sxx: Column, syy: Column) -> Column:
    """Pearson r from centred sums; NULL when either side has no spread or no finite spread."""
    r = F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))
    # least and greatest skip NULL, so a missing r must not reach them
    return F.when(r.isNotNull() & ~F.isnan(r), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
