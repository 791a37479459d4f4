"""Tail probabilities, Shapiro-Wilk and moment formulas against published values."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableaudit.functions import moments as M
from tableaudit.functions import severity as S
from tableaudit.functions import tails
from tableaudit.functions.shapiro import shapiro_wilk


@pytest.mark.parametrize(
    ("t", "dof", "p"), [(12.706, 1, 0.05), (2.228139, 10, 0.05), (2.750, 30, 0.01), (1.959964, 1e9, 0.05), (0.0, 5, 1.0)]
)
def test_student(t, dof, p):
    assert tails.student_two_sided(t, dof) == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize(("x", "dof", "p"), [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (6.634897, 1, 0.01), (0.0, 3, 1.0)])
def test_chi_square(x, dof, p):
    assert tails.chi_square_tail(x, dof) == pytest.approx(p, abs=1e-7)


@pytest.mark.parametrize(("f", "d1", "d2", "p"), [(4.964603, 1, 10, 0.05), (3.325835, 5, 10, 0.05)])
def test_f(f, d1, d2, p):
    assert tails.f_tail(f, d1, d2) == pytest.approx(p, abs=1e-6)


def test_normal():
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)


def test_fisher_tea_tasting():
    assert tails.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)
    assert tails.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.0349650350, abs=1e-9)


def test_kolmogorov_critical_values():
    assert tails.kolmogorov_tail(1.358099) == pytest.approx(0.05, abs=1e-6)
    assert tails.kolmogorov_tail(1.627624) == pytest.approx(0.01, abs=1e-6)
    assert tails.kolmogorov_tail(0.5) == pytest.approx(0.9639452, abs=1e-6)


def test_two_sample_ks_counts_paths():
    from itertools import combinations

    def brute(d, m, n):
        hits = total = 0
        for chosen in combinations(range(m + n), m):
            picked, i, gap = set(chosen), 0, 0
            for k in range(m + n):
                i += k in picked
                gap = max(gap, abs(i * n - (k + 1 - i) * m))
            total += 1
            hits += gap >= round(d * m * n)
        return hits / total

    for d, m, n in [(0.5, 4, 6), (2 / 3, 6, 3), (3 / 7, 7, 7), (0.45, 5, 8), (1.0, 5, 4)]:
        assert tails.two_sample_ks_tail(d, m, n) == pytest.approx(brute(d, m, n), abs=1e-12)
    assert tails.two_sample_ks_tail(1.0, 5000, 5000) == 0.0


def test_shapiro_published_weights():
    weights = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    w, p = shapiro_wilk(weights)
    assert w == pytest.approx(0.79, abs=0.002)
    assert p == pytest.approx(0.0067, abs=1e-4)


def test_shapiro_limits():
    assert shapiro_wilk(np.ones(10)) == (1.0, 1.0)
    rng = np.random.default_rng(1)
    assert shapiro_wilk(rng.normal(size=2000))[1] > 0.01
    assert shapiro_wilk(rng.exponential(size=2000))[1] < 1e-10


def test_moments_equal_pandas(spark):
    rng = np.random.default_rng(3)
    for values in (rng.exponential(size=50), rng.normal(size=9), np.array([1.0, 2.0, 4.0]), np.array([5.0, 5.0, 5.0, 5.0])):
        s = pd.Series(values)
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        row = df.agg(F.count("x").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2")).select(
            M.sample_skewness(F.col("n"), F.col("g1")), M.sample_kurtosis(F.col("n"), F.col("g2"))
        ).first()
        assert row[0] == pytest.approx(s.skew(), abs=1e-9)
        assert row[1] == pytest.approx(s.kurt() if len(s) > 3 else 0.0, abs=1e-9)


def test_omnibus_scores(spark):
    """Worked example: the first 20 numbers have a kurtosis score of -1.7058104152 and the skewness scores below."""
    df = spark.range(20).select(F.col("id").cast("double").alias("x"))
    found = df.agg(F.count("x").cast("double").alias("n"), F.kurtosis("x").alias("g2"))
    assert found.select(M.kurtosis_score(F.col("n"), F.col("g2"))).first()[0] == pytest.approx(-1.7058104152, abs=1e-9)
    for values, score in (([1, 2, 3, 4, 5, 6, 7, 8], 1.0108048609), ([2, 8, 0, 4, 1, 9, 9, 0], 0.4462638537)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        found = df.agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("g1"))
        assert found.select(M.skewness_score(F.col("n"), F.col("g1"))).first()[0] == pytest.approx(score, abs=1e-9)


@pytest.mark.parametrize(
    ("scale", "cases"),
    [
        (S.missing_severity, {40.0: "critical", 39.99: "high", 20.0: "high", 5.0: "moderate", 4.9999: "low"}),
        (S.missing_level, {40.0: "MODERATE (1-40%)", 40.01: "HIGH (>40%)", 0.99: "LOW (<1%)"}),
        (S.outlier_severity, {10.0: "critical", 5.0: "high", 1.0: "moderate", 0.99: "low"}),
        (S.duplicate_severity, {10.0: "high", 2.0: "moderate", 1.99: "low"}),
        (S.skew_severity, {-1.01: "strongly_skewed", 1.0: "moderately_skewed", 0.5: "symmetric"}),
        (S.correlation_strength, {-0.7: "strong", 0.3: "moderate", 0.29: "weak"}),
        (S.imbalance_severity, {0.19: "severe", 0.2: "moderate", 0.5: "balanced"}),
        (S.grade, {95.0: "A+", 94.9: "A", 80.0: "B", 70.0: "C", 60.0: "D", 59.9: "F"}),
    ],
)
def test_scales(spark, scale, cases):
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    assert {r[0]: r[1] for r in df.select("x", scale(F.col("x"))).collect()} == cases


def test_perfect_and_missing_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    assert df.select(M.safe_corr(F.col("a"), F.lit(0.0), F.col("c"))).first()[0] is None
    assert df.select(M.safe_corr(F.lit(2.0), F.lit(2.0), F.lit(2.0))).first()[0] == pytest.approx(1.0)
    assert math.isclose(tails.student_two_sided(float("inf"), 3), 0.0)


@pytest.mark.parametrize("n", [10**9, 10**12, 10**14])
def test_tails_at_very_large_counts(n):
    for t in (1e-3, 0.5, 2.0, 5.0):
        # the normal tail and its first correction in 1 / n
        near = tails.normal_two_sided(t) + (t**3 + t) / (2 * n) * math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        assert tails.student_two_sided(t, n) == pytest.approx(near, abs=1e-12)
        assert tails.f_tail(t * t, 1, n) == pytest.approx(near, abs=1e-12)
    quarter = n // 4
    assert tails.fisher_two_sided(quarter, quarter, quarter, quarter) == 1.0
    shift = round(math.sqrt(n) / 4)  # one standard deviation
    p = tails.fisher_two_sided(quarter + shift, quarter - shift, quarter - shift, quarter + shift)
    assert p == pytest.approx(tails.normal_two_sided(1.0), abs=8 / math.sqrt(n) + 1e-8)


def test_student_and_f_forms_meet():
    for t in (0.1, 1.0, 3.0):
        below, above = tails.student_two_sided(t, 99_999.0), tails.student_two_sided(t, 100_001.0)
        assert below == pytest.approx(above, rel=1e-8)
    assert tails.f_tail(2.5, 3, 299_999) == pytest.approx(tails.f_tail(2.5, 3, 300_001), rel=1e-7)


def test_fisher_counts_every_table_as_rare():
    draw = random.Random(4)
    for _ in range(300):
        a, b, c, d = (draw.randrange(25) for _ in range(4))
        if not a + b + c + d:
            continue
        row, col, n = a + b, a + c, a + b + c + d
        ways = {k: math.comb(col, k) * math.comb(n - col, row - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(w for w in ways.values() if w <= ways[a]) / sum(ways.values())
        assert tails.fisher_two_sided(a, b, c, d) == pytest.approx(want, abs=1e-10)


def test_u_of_a_few_against_very_many(monkeypatch):
    for n1, n2, u in ((1, 4000, 3990), (3, 4000, 10_000), (5, 3000, 11_000), (8, 2000, 12_000)):
        counted = tails.exact_u_p(u, n1, n2)
        monkeypatch.setattr(tails, "EXACT_U_CELLS", 0)
        assert tails.exact_u_p(u, n1, n2) == pytest.approx(counted, abs=5e-4)
        monkeypatch.undo()
    assert 0 < tails.exact_u_p(1.2e9, 8, 10**9) < 1e-3
