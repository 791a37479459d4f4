import functools

import numpy as np
import pandas as pd
import pytest
from data import contacts, golden, reversal, to_spark
from pyspark.sql import functions as F

import tableaudit as A
from tableaudit.functions import constants as K
from tableaudit.functions import tails
from tableaudit.operators import relations as R


def rows(df):
    return sorted(df.collect(), key=lambda r: r["position"])


def test_reversal_is_found(spark):
    found = A.simpsons(to_spark(spark, reversal())).collect()
    assert {(r["category"], r["subgroup_corr"]) for r in found} == {("GroupA", -1.0), ("GroupB", -1.0)}
    assert all(r["overall_corr"] > 0 and r["finding"] == 1 for r in found)


def test_reversal_limit_counts_findings_not_rows(spark):
    frame = pd.concat([reversal().assign(W=lambda d: d.Y, V=lambda d: d.X)], ignore_index=True)
    df = to_spark(spark, frame)
    assert {r["finding"] for r in A.simpsons(df, limit=3).collect()} == {1, 2, 3}
    assert len({r["finding"] for r in A.simpsons(df).collect()}) == 4


def test_correlations_choose_the_method(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    frame = pd.DataFrame({"x": x, "y": x + rng.normal(size=300), "e": np.exp(3 * x)})
    found = {r["pair"]: r for r in A.correlations(to_spark(spark, frame)).collect()}
    assert found["x & y"]["method"] == K.PEARSON
    assert found["x & y"]["corr"] == pytest.approx(frame.x.corr(frame.y), abs=1e-4)
    assert found["x & e"]["method"] == K.SPEARMAN and found["x & e"]["corr"] == 1.0
    assert found["x & e"]["raw_p_value"] == 0.0 and found["x & e"]["is_significant"]


def test_correlations_with_constants_and_few_rows(spark):
    df = spark.range(20).select(
        F.col("id").cast("double").alias("a"),
        F.lit(3.0).alias("k"),
        F.when(F.col("id") < 7, F.col("id").cast("double")).alias("short"),
    )
    found = {r["pair"]: r for r in A.correlations(df).collect()}
    assert set(found) == {"a & k"}
    assert (found["a & k"]["corr"], found["a & k"]["raw_p_value"]) == (0.0, 1.0)
    assert A.correlations(df.select("a")).count() == 0


def test_vif_and_redundancy(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=200)
    frame = pd.DataFrame({"a": a, "b": a * 2, "c": a + 0.3 * rng.normal(size=200), "d": rng.normal(size=200), "k": 1.0})
    df = to_spark(spark, frame)
    vif = {r["column"]: r["vif"] for r in A.vif_scores(df).collect()}
    assert vif["a"] == 999.0 and vif["k"] == 1.0
    r = frame.a.corr(frame.c)
    assert vif["c"] == round(1 / (1 - r * r), 2)
    assert {(x["col1"], x["col2"]) for x in A.redundant_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def _mann_whitney(a, b):
    both = pd.concat([a, b])
    n1, n2, n = len(a), len(b), len(a) + len(b)
    u = both.rank().iloc[:n1].sum() - n1 * (n1 + 1) / 2
    ties = (both.value_counts() ** 3 - both.value_counts()).sum()
    sd = (n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) ** 0.5
    return u, min(1.0, tails.normal_two_sided((max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd))


@pytest.mark.parametrize("bucket", [2_000_000, 30])
def test_mann_whitney(spark, bucket):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"g": rng.choice(["p", "q"], 400), "v": rng.exponential(size=400).round(1)})
    frame.loc[frame.g == "q", "v"] += 0.2
    row = R.group_tests(to_spark(spark, frame), rows_per_bucket=bucket).first()
    u, p = _mann_whitney(frame.v[frame.g == "p"], frame.v[frame.g == "q"])
    assert row["test_name"] == K.MANN_WHITNEY
    assert row["statistic"] == pytest.approx(u, abs=1e-4)
    assert row["raw_p_value"] == pytest.approx(p, abs=1e-4)


def test_small_untied_groups_are_exact(spark):
    """Eight against eight without overlap: two of C(16, 8) arrangements are as extreme."""
    values = [0.0, 1.0, 2.0, 3.0, 50.0, 51.0, 52.0, 53.0] + [1000.0, 1001, 1002, 1003, 9000, 9001, 9002, 9003]
    assert tails.exact_u_p(0.0, 8, 8) == pytest.approx(2 / 12870)
    frame = pd.DataFrame({"g": ["a"] * 8 + ["b"] * 8, "v": values})
    row = R.group_tests(to_spark(spark, frame)).first()
    assert row["test_name"] == K.MANN_WHITNEY and row["statistic"] == 0.0
    assert row["raw_p_value"] == pytest.approx(2 / 12870, abs=1e-4)


def test_t_tests(spark):
    rng = np.random.default_rng(11)
    a, b, c = rng.normal(0, 1, 60), rng.normal(0.5, 1, 50), rng.normal(0, 6, 50)
    equal = pd.DataFrame({"g": ["a"] * 60 + ["b"] * 50, "v": np.concatenate([a, b])})
    row = A.group_tests(to_spark(spark, equal)).first()
    assert row["test_name"] == K.STUDENT_T
    pooled = ((59 * a.var(ddof=1) + 49 * b.var(ddof=1)) / 108) ** 0.5
    t = (a.mean() - b.mean()) / (pooled * (1 / 60 + 1 / 50) ** 0.5)
    assert row["statistic"] == pytest.approx(t, abs=1e-4)
    assert row["effect_size"] == pytest.approx((a.mean() - b.mean()) / pooled, abs=1e-4)
    assert row["raw_p_value"] == pytest.approx(tails.student_two_sided(t, 108), abs=1e-4)
    unequal = pd.DataFrame({"g": ["a"] * 60 + ["c"] * 50, "v": np.concatenate([a, c])})
    row = A.group_tests(to_spark(spark, unequal)).first()
    assert row["test_name"] == K.WELCH_T
    va, vc = a.var(ddof=1) / 60, c.var(ddof=1) / 50
    assert row["statistic"] == pytest.approx((a.mean() - c.mean()) / (va + vc) ** 0.5, abs=1e-4)


def test_group_order_by_first_appearance(spark):
    frame = pd.DataFrame({"at": range(40), "g": ["z", "a"] * 20, "v": np.arange(40.0) ** 2})
    df = to_spark(spark, frame)
    by_value = A.group_tests(df, columns=["v"]).first()
    by_row = A.group_tests(df, columns=["v"], order_col="at").first()
    assert by_value["variables"].endswith("(a vs z)") and by_row["variables"].endswith("(z vs a)")
    assert by_value["effect_size"] == pytest.approx(-by_row["effect_size"])


def test_group_test_cap(spark):
    frame = pd.DataFrame({"g": ["a", "b"] * 20, **{f"v{i}": np.random.default_rng(i).exponential(size=40) for i in range(7)}})
    df = to_spark(spark, frame)
    assert A.group_tests(df, limit=5).count() == 5
    assert A.group_tests(df).count() == 7


def test_chi_square_and_yates(spark):
    frame = pd.DataFrame(
        {"a": ["x"] * 30 + ["y"] * 30, "b": ["u"] * 20 + ["w"] * 10 + ["u"] * 10 + ["w"] * 20, "c": (["l", "m", "n"] * 20)}
    )
    found = {r["variables"]: r for r in A.contingency_tests(to_spark(spark, frame)).collect()}
    two = found["Categorical: 'a' & 'b'"]
    assert two["statistic"] == pytest.approx(5.4)  # 4 * (5 - 0.5)^2 / 15
    assert two["effect_size"] == pytest.approx((5.4 / 60) ** 0.5, abs=1e-4)
    assert two["test_name"] == K.CHI_SQUARE
    assert found["Categorical: 'a' & 'c'"]["statistic"] == pytest.approx(0.0)


def test_fisher_on_sparse_tables(spark):
    frame = pd.DataFrame({"a": ["x"] * 10 + ["y"] * 6, "b": ["u"] * 8 + ["w"] * 2 + ["u"] * 1 + ["w"] * 5})
    row = A.contingency_tests(to_spark(spark, frame)).first()
    assert row["test_name"] == K.FISHER
    assert row["statistic"] == pytest.approx(20.0)
    assert row["raw_p_value"] == pytest.approx(0.035, abs=1e-4)


def test_contingency_paths_agree(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({c: rng.choice(list("abcd"), 500, p=[0.7, 0.1, 0.1, 0.1]) for c in "xyz"})
    df = to_spark(spark, frame)
    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    joint = R.contingency_statistics(df, pairs, 64).orderBy("pair").collect()
    single = R.contingency_statistics(df, pairs).orderBy("pair").collect()
    for (a, b), j, s in zip(pairs, joint, single):
        table = pd.crosstab(frame[a], frame[b])
        e = np.outer(table.sum(1), table.sum(0)) / 500
        assert j["chi2"] == pytest.approx(((table.values - e) ** 2 / e).sum())
        assert s["chi2"] == pytest.approx(j["chi2"])


def _bh(p):
    order = np.argsort(p)
    out = np.empty(len(p))
    low = 1.0
    for rank in range(len(p), 0, -1):
        low = min(low, p[order[rank - 1]] * len(p) / rank)
        out[order[rank - 1]] = low
    return out


@pytest.mark.parametrize("bucket", [2_000_000, 25])
def test_false_discovery_control(spark, bucket, monkeypatch):
    if bucket == 25:
        monkeypatch.setattr(R, "lookup_join", functools.partial(R.lookup_join, easy_rows=0))
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"id": range(400), "f": rng.choice(["a", "b"], 400, p=[0.8, 0.2]), "p": (rng.random(400) ** 3).round(2)})
    got = {r["id"]: r for r in A.bh_adjust(to_spark(spark, frame), "p", "f", bucket).collect()}
    assert len(got) == 400
    for f, part in frame.groupby("f"):
        for i, q in zip(part.id, _bh(part.p.to_numpy())):
            assert got[i]["p_adj"] == pytest.approx(q, abs=6e-5)
            assert got[i]["family_size_m"] == len(part)


def test_small_families(spark):
    df = to_spark(spark, pd.DataFrame({"position": [0, 1, 2], "raw_p_value": [0.01, 0.04, 0.03]}))
    got = {r["position"]: r["p_adj"] for r in R.adjust_family(df).collect()}
    assert got == {0: 0.03, 1: 0.04, 2: 0.04}


def test_insights_fall_and_stay_few(spark):
    df = to_spark(spark, contacts()).select("Age", "Income", "SentinelCol", "Gender", "Target")
    found = sorted(A.rank_insights(A.group_tests(df), A.correlations(df)).collect(), key=lambda r: r["place"])
    assert [r["l_ci"] for r in found] == sorted((r["l_ci"] for r in found), reverse=True)
    assert len(found) <= 5


def test_insight_rule(spark):
    tests = to_spark(
        spark,
        pd.DataFrame({
            "position": [0, 1], "test_name": "T", "variables": ["'a' by 'g'", "'b' by 'g'"], "effect_size": [2.0, 0.1],
            "effect_size_type": ["Cohen's d", "Cramer's V"], "n_eff": [100, 100], "p_adj": [0.0, 0.9], "is_significant": [True, False],
        }),
    )
    pairs = to_spark(
        spark,
        pd.DataFrame({
            "position": [0], "method": "M", "pair": ["x & y"], "corr": [-0.9], "n_eff": [400], "p_adj": [0.0], "is_significant": [True],
        }),
    )
    found = sorted(A.rank_insights(tests, pairs).collect(), key=lambda r: r["place"])
    assert [r["variables"] for r in found] == ["x & y", "'a' by 'g'"]
    assert found[0]["l_ci"] == pytest.approx(0.81 - 1.96 / 20, abs=1e-4)
    assert found[1]["normalized_magnitude"] == 0.5


def test_one_family_of_all_tests(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], 300), "h": rng.choice(["u", "v", "w"], 300), **{f"x{i}": rng.exponential(size=300) for i in range(6)}})
    assert len(rows(A.association_tests(to_spark(spark, frame), group_limit=5))) == 6
    found = rows(A.association_tests(to_spark(spark, frame)))
    assert [r["position"] for r in found] == list(range(7))
    assert found[-1]["effect_size_type"] == "Cramer's V"


def test_levene_matches_anova_on_distances(spark):
    rng = np.random.default_rng(10)
    a, b = rng.normal(0, 1, 80), rng.normal(0, 2, 70)
    df = to_spark(spark, pd.DataFrame({"g": ["a"] * 80 + ["b"] * 70, "v": np.concatenate([a, b])}))
    side = lambda k: F.when(F.col("g") == k, F.col("v"))
    row = R.levene(df, {"t": (side("a"), side("b"))}).first()
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    grand = np.concatenate([za, zb]).mean()
    f = 148 * (80 * (za.mean() - grand) ** 2 + 70 * (zb.mean() - grand) ** 2) / (79 * za.var(ddof=1) + 69 * zb.var(ddof=1))
    assert row["statistic"] == pytest.approx(f)
    assert row["p_value"] == pytest.approx(tails.student_two_sided(f**0.5, 148), abs=1e-12)


def test_leakage(spark):
    frame = golden().assign(copy=lambda d: d.Target * 3.0 + 1, label=lambda d: np.where(d.Target == 1, "yes", "no"))
    df = to_spark(spark, frame)
    assert [r["column"] for r in A.leakage(df, "Target").collect()] == ["copy"]
    assert [r["column"] for r in A.leakage(df, "label").collect()] == ["Target", "copy"]


def test_text_target_codes(spark):
    from tableaudit.operators.target import target_codes

    df = spark.createDataFrame([("b",), ("a",), (None,), ("",), ("c",)], "t string")
    for small in (100, 2):
        got = {r["t"]: r["target_code"] for r in target_codes(df, "t", small=small).collect()}
        assert got == {"": 0.0, "a": 1.0, "b": 2.0, "c": 3.0, None: -1.0}
