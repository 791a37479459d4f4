"""Plan shapes: quantiles, running totals, ranks, pair moments and joins, also where data is cut into buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableaudit.functions.columns import key_of, plain_number, row_digest
from tableaudit.operators.quality import duplicates, row_counts
from tableaudit.plans import prefix, quantiles, ranks
from tableaudit.plans.codes import value_codes
from tableaudit.plans.freq import few_valued, number_counts, value_counts
from tableaudit.plans.joins import lookup_join
from tableaudit.plans.pairs import _by_expressions, _by_matrices, all_pairs, pair_moments


@pytest.fixture(scope="module")
def frame():
    """A continuous column, one where a single value holds a third of the rows, and gaps in both."""
    rng = np.random.default_rng(7)
    n = 6000
    x = rng.normal(size=n).round(3)
    y = np.where(rng.random(n) < 0.34, 5.0, rng.integers(0, 900, n).astype(float))
    y[rng.random(n) < 0.1] = np.nan
    z = x * 2 + rng.normal(size=n)
    z[rng.random(n) < 0.2] = np.nan
    return pd.DataFrame({"x": x, "y": y, "z": z})


@pytest.fixture(scope="module")
def table(spark, frame):
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "x double, y double, z double")
    return df.repartition(5).cache()


def _columns(names="xyz"):
    return {c: F.col(c) for c in names}


@pytest.mark.parametrize("direct", [1_000_000, 300, 40])
def test_exact_quantiles(table, frame, direct, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = quantiles.exact_quantiles(table, _columns(), probs, direct=direct)
    for c in "xyz":
        for p in probs:
            assert found[c][p] == pytest.approx(frame[c].quantile(p), abs=1e-12), (c, p)


def test_quantiles_of_tiny_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    found = quantiles.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.25, 0.5])
    assert found == {"a": {0.25: 1.5, 0.5: 2.0}}


@pytest.mark.parametrize("guess", [(0.0, 1.0), (-100.0, -50.0), (3.0, 3.0)])
def test_wrong_guesses_do_no_harm(table, frame, guess):
    n = int(frame.x.count())
    found = quantiles.order_statistics(table, {"x": F.col("x")}, {"x": [100]}, {"x": n}, direct=50, guesses={"x": guess})
    assert found[("x", 100)] == np.sort(frame.x)[100]


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 500, 20])
def test_average_ranks(table, frame, rows_per_bucket):
    columns = _columns()
    counts = quantiles.counts_of(table, columns)
    limits = prefix.bucket_limits(table, columns, counts, rows_per_bucket)
    assert bool(limits) == (rows_per_bucket < 6000)
    ranked = prefix.average_ranks(number_counts(table, columns), limits)
    got = {(r["column"], r["value"]): r["rank"] for r in ranked.collect()}
    for c in "xyz":
        want = dict(zip(frame[c].dropna(), frame[c].dropna().rank()))
        assert {v: got[(c, v)] for v in want} == want


def test_bucket_search_in_two_steps(spark):
    limits = {"a": [float(i) for i in range(0, 1000, 3)]}
    df = spark.range(-5, 1100).select(F.col("id").cast("double").alias("v"))
    rows = df.select("v", prefix.bucket_of(F.lit("a"), F.col("v"), limits).alias("b")).collect()
    assert all(r["b"] == sum(x < r["v"] for x in limits["a"]) for r in rows)


@pytest.mark.parametrize(("broadcast", "bucket"), [(10**6, 10**6), (0, 10**6), (500, 700)])
def test_rank_correlations(table, frame, broadcast, bucket, monkeypatch):
    columns = _columns()
    pairs = all_pairs(list("xyz"))
    pair_counts = {p: int(frame[list(p)].dropna().shape[0]) for p in pairs}
    counts = {c: int(frame[c].count()) for c in "xyz"}
    distinct = {c: int(frame[c].nunique()) for c in "xyz"}
    got = ranks.rank_correlations(table, columns, pairs, pair_counts, counts, distinct, len(frame), bucket, broadcast, 0)
    for a, b in pairs:
        both = frame[[a, b]].dropna().rank()
        assert got[(a, b)] == pytest.approx(both[a].corr(both[b]), abs=1e-12)


def test_hot_values_found(table):
    assert 5.0 in ranks.hot_values(table, {"y": F.col("y")})["y"]
    assert ranks.hot_values(table, {"z": F.col("z")})["z"] == []


def test_pair_moments_agree(table, frame):
    columns, pairs = _columns(), all_pairs(list("xyz"))
    for found in (_by_expressions(table, columns, pairs, []), _by_matrices(table, columns, pairs)):
        for r in found.collect():
            a, b = r["col1"], r["col2"]
            both = frame[[a, b]].dropna()
            assert r["n_eff"] == len(both)
            assert r["cov"] == pytest.approx(np.cov(both[a], both[b], ddof=0)[0, 1], rel=1e-9)
            assert r["var1"] == pytest.approx(both[a].var(ddof=0), rel=1e-9)


def test_infinite_values_give_no_correlation(spark):
    df = spark.createDataFrame([(float(i), float("inf") if i == 3 else float(i * i)) for i in range(20)], "a double, b double")
    assert pair_moments(df, _columns("ab")).first()["r"] is None


def test_matrix_moments_of_constants(spark):
    df = spark.range(50).select(F.lit(0.1).alias("k"), F.col("id").cast("double").alias("v"))
    row = _by_matrices(df, {"k": F.col("k"), "v": F.col("v")}, [("k", "v")]).first()
    assert row["var1"] == 0.0


@pytest.mark.parametrize("share", [64, 2, 1])
def test_lookup_join(table, frame, share):
    counts = number_counts(table, {"y": F.col("y")}).select(F.col("value").alias("y"), "n", (F.col("value") * 2).alias("twice"))
    joined = lookup_join(table.select("x", "y"), counts, ["y"], len(frame), share, easy_rows=0)
    rows = joined.collect()
    assert len(rows) == len(frame)
    assert all(r["twice"] == (None if r["y"] is None else r["y"] * 2) for r in rows)


@pytest.mark.parametrize("small", [1000, 3])
def test_value_codes(spark, small):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", None, "é", "a", "z", "b"]], "v string").repartition(3)
    codes, broadcast = value_codes(df, F.col("v"), small)
    assert broadcast == (small == 1000)
    got = {r["value"]: (r["code"], r["n"]) for r in codes.collect()}
    assert got == {"a": (0, 2), "b": (1, 2), "c": (2, 1), "z": (3, 1), "é": (4, 1)}


def test_long_text_keys_hold_the_whole_text(spark):
    long = "word " * 500
    df = spark.createDataFrame([(long,), (long,), (long + "x",), ("short",)], "t string")
    counts = sorted(r["n"] for r in value_counts(df, ["t"]).collect())
    assert counts == [1, 1, 2]
    assert df.select(F.max(F.length(key_of(F.col("t"))))).first()[0] == 256 + 1 + 64


def test_duplicates_narrow_and_wide(spark):
    rows = [("a", 1.0, None), ("a", 1.0, None), ("a", None, "1"), (None, 1.0, "a"), ("a", 1.0, "")]
    df = spark.createDataFrame(rows, "s string, x double, t string")
    assert duplicates(df).first()["duplicate_rows"] == 1
    wide = df.select("*", *[F.lit(i).alias(f"k{i}") for i in range(40)])
    assert duplicates(wide).first()["duplicate_rows"] == 1
    assert row_counts(df).count() == 4
    assert df.select(row_digest(df)).distinct().count() == 4


def test_nan_and_null_are_one(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (-0.0,)], "x double")
    assert duplicates(df).first()["duplicate_rows"] == 2


def test_few_valued_never_loses_a_column(spark):
    df = spark.range(5000).select(
        (F.col("id") % 19).cast("string").alias("small"), F.col("id").cast("string").alias("wide"), (F.col("id") % 2).alias("two")
    )
    assert few_valued(df, ["small", "wide", "two"], 20) == ["small", "two"]


def test_plain_numbers(spark):
    cases = {4532015112830366.0: "4532015112830366.0", 1e7: "10000000.0", 12.5: "12.5", 0.0001: "0.0001", -3.0: "-3.0", 12345678.25: "12345678.25"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    assert {r[0]: r[1] for r in df.select("x", plain_number(F.col("x"))).collect()} == cases


def test_infinite_values_count_the_same_in_both_forms(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({f"c{i}": rng.normal(size=60) for i in range(6)})
    frame.loc[::10, "c1"] = np.nan
    frame.loc[[3, 4], "c2"] = np.inf
    df = spark.createDataFrame(frame).repartition(3)
    columns = {c: F.when(~F.isnan(c), F.col(c)) for c in frame.columns}
    keys = all_pairs(list(columns))
    few = {(r["col1"], r["col2"]): r for r in _by_expressions(df, columns, keys, []).collect()}
    for r in _by_matrices(df, columns, keys).collect():
        one = few[r["col1"], r["col2"]]
        assert r["n_eff"] == one["n_eff"]
        infinite = "c2" in (r["col1"], r["col2"])
        assert infinite == (r["cov"] is None or not np.isfinite(r["cov"])) == (not np.isfinite(one["cov"]))
        if not infinite:
            assert r["cov"] == pytest.approx(one["cov"], abs=1e-12)
    found = {(r["col1"], r["col2"]): r["r"] for r in pair_moments(df, columns).collect()}
    assert all((v is None) == ("c2" in k) for k, v in found.items())


@pytest.mark.parametrize(("broadcast", "bucket"), [(10**6, 10**6), (120, 700), (0, 700)])
def test_rank_correlations_of_several_keys(spark, broadcast, bucket):
    draw = np.random.default_rng(11)
    n = 6000
    frame = pd.DataFrame({"k": draw.integers(0, 3, n), "a": draw.integers(0, 9, n).astype(float), "b": draw.normal(size=n).round(2)})
    frame["c"] = (frame.a + draw.integers(0, 4, n)).where(draw.random(n) > 0.2)
    frame["d"] = (frame.b + frame.k * frame.a).round(3).where(draw.random(n) > 0.1)
    names = list("abcd")
    table = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "k int, a double, b double, c double, d double").repartition(5)
    pairs = all_pairs(names)
    got = ranks.keyed_rank_correlations(
        table, F.col("k"), [0, 1, 2], {c: F.col(c) for c in names}, pairs,
        {p: len(frame[list(p)].dropna()) for p in pairs}, {c: int(frame[c].count()) for c in names},
        {c: sum(int(frame[frame.k == k][c].nunique()) for k in range(3)) for c in names}, n, bucket, broadcast, 0,
    )
    for k in range(3):
        for a, b in pairs:
            both = frame[frame.k == k][[a, b]].dropna().rank()
            assert got[k, (a, b)] == pytest.approx(both[a].corr(both[b]), abs=1e-12)


@pytest.mark.parametrize("broadcast", [10**6, 30])
def test_ranks_of_all_sets_of_gaps_come_from_few_scans(spark, broadcast, monkeypatch):
    """One scan a set of gaps and column made time grow with their number; ranks must not join rows of large columns."""
    rows = spark.range(2000).selectExpr("id % 7 + 0.0D AS a", "id * 3 % 1999 + 0.0D AS b", "CASE WHEN id % 5 > 0 THEN id % 11 + 0.0D END AS c")
    joined = []
    monkeypatch.setattr(ranks, "_salted_join", lambda *args: joined.append(args))
    pairs, columns = all_pairs(list("abc")), {c: F.col(c) for c in "abc"}
    n = {p: 1600 if "c" in p else 2000 for p in pairs}
    got = ranks.rank_correlations(
        rows, columns, pairs, n, {"a": 2000, "b": 2000, "c": 1600}, {"a": 7, "b": 1999, "c": 11}, 2000, 100, broadcast, 0
    )
    frame = rows.toPandas()
    for a, b in pairs:
        both = frame[[a, b]].dropna().rank()
        assert got[a, b] == pytest.approx(both[a].corr(both[b]), abs=1e-12)
    assert not joined


def test_rows_cross_one_shuffle_for_each_column_with_many_values(spark, monkeypatch):
    """Counts of values, equal rows and a join for each column took 5 times the input's size on disk."""
    rows = spark.range(3500).selectExpr("id % 3000 AS id").selectExpr(
        "id % 5 + 0.0D AS a", "id * 7 % 2999 + 0.0D AS b", "IF(id % 3 = 0, 4.5D, id * 11 % 2999) AS c", "sqrt(id % 1500) - 9 AS d"
    )
    seen = []
    whole = ranks.reduce
    monkeypatch.setattr(ranks, "reduce", lambda f, parts, *more: whole(f, seen.extend(parts) or parts if not more else parts, *more))
    names, frame = list("abcd"), rows.toPandas()
    got = ranks.rank_correlations(
        rows, {c: F.col(c) for c in names}, all_pairs(names), dict.fromkeys(all_pairs(names), 3500), dict.fromkeys(names, 3500),
        {c: int(frame[c].nunique()) for c in names}, 3500, 300, 20, 0,
    )
    for a, b in all_pairs(names):
        both = frame[[a, b]].rank()
        assert got[a, b] == pytest.approx(both[a].corr(both[b]), abs=1e-12)
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in seen if hasattr(p, "_jdf")]
    shuffles = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # by buckets of b, c and d, of which only c has a hot value, and never by values; counts of buckets are the others
    assert sum("__salt" in line for line in shuffles) == 1
    assert sum("REPARTITION_BY_COL" in line for line in shuffles) == 3
    assert sum("__bucket" in line for line in shuffles) <= 3 + 3 + 1
    assert not [line for line in shuffles if "hashpartitioning(x" in line]
