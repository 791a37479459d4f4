"""Shapiro-Wilk W by Royston's algorithm AS R94, for samples of at most 5000 values, and parts of Shapiro-Francia W'."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# Polynomial coefficients published with AS R94, in rising powers.
_A_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_A_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_GAMMA = (-2.273, 0.459)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


# Mean and standard deviation of ln(1 - W') published by Royston (1993), over ln(ln n) and ln n.
_FRANCIA_MEAN = (-1.2725, 1.0521)
_FRANCIA_SD = (1.0308, -0.26758)
#: Ranks at either end whose scores are added one by one; further inside the sum of many is an integral.
_EACH = 2000


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p). A sample without spread gives W = 1 and p = 1."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[-1] - x[0] < 1e-19:
        return 1.0, 1.0
    normal = NormalDist()
    scores = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total = float(scores @ scores)
    weights = scores / math.sqrt(total)
    u = 1.0 / math.sqrt(n)
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        last = weights[-1] + _poly(_A_LAST, u)
        if n > 5:
            second = weights[-2] + _poly(_A_NEXT, u)
            scale = (total - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            weights = scores / math.sqrt(scale)
            weights[-2], weights[1] = second, -second
        else:
            scale = (total - 2 * scores[-1] ** 2) / (1 - 2 * last**2)
            weights = scores / math.sqrt(scale)
        weights[-1], weights[0] = last, -last
    centred = x - x.mean()
    w = min(1.0, float(weights @ centred) ** 2 / float(centred @ centred))
    if n == 3:
        return w, max(0.0, 1.90985931710274 * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    gap = math.log(max(1.0 - w, 1e-300))
    if n <= 11:
        gamma = _poly(_SMALL_GAMMA, n)
        if gap >= gamma:
            return w, 1e-99
        gap = -math.log(gamma - gap)
        mean, sd = _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_LOG_SD, n))
    else:
        mean, sd = _poly(_LARGE_MEAN, math.log(n)), math.exp(_poly(_LARGE_LOG_SD, math.log(n)))
    return w, 0.5 * math.erfc((gap - mean) / sd / math.sqrt(2.0))


def score_sums(before: int, n: int, total: int) -> tuple[float, float]:
    """Sums of the normal scores of ranks ``before`` + 1 to ``before`` + ``n`` of ``total``, and of their squares.

    Long stretches of ranks far from both ends are integrated; the error is below 1e-6 of the sum.
    """
    normal = NormalDist()
    at = lambda rank: normal.inv_cdf((rank - 0.375) / (total + 0.25))
    first, last = before + 1, before + n
    inner = range(max(first, _EACH + 1), min(last, total - _EACH) + 1)
    if len(inner) <= _EACH:
        inner = range(0)
    one = two = 0.0
    edges = [(first, last)] if not len(inner) else [(first, inner[0] - 1), (inner[-1] + 1, last)]
    for a, b in edges:
        for rank in range(a, b + 1):
            m = at(rank)
            one, two = one + m, two + m * m
    if len(inner):
        (za, pa), (zb, pb) = ((normal.inv_cdf(p), p) for p in ((r - 0.375) / (total + 0.25) for r in (inner[0] - 0.5, inner[-1] + 0.5)))
        one += (total + 0.25) * (normal.pdf(za) - normal.pdf(zb))
        two += (total + 0.25) * (pb - pa - zb * normal.pdf(zb) + za * normal.pdf(za))
    return one, two


def francia_p(w: float, n: int) -> float:
    """Upper tail of W' for ``n`` values."""
    log, loglog = math.log(n), math.log(math.log(n))
    mean, sd = _poly(_FRANCIA_MEAN, loglog - log), _poly(_FRANCIA_SD, loglog + 2 / log)
    return 0.5 * math.erfc((math.log(max(1.0 - w, 1e-300)) - mean) / sd / math.sqrt(2.0))
