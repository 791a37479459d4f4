import datetime as dt

import numpy as np
import pandas as pd
import pytest
from data import dirty, golden, to_spark
from pyspark.sql import functions as F

import tableaudit as A
from tableaudit.functions import tails
from tableaudit.operators import features as H
from tableaudit.operators import target as T
from tableaudit.operators.charts import trend_means


# --- cleaning ------------------------------------------------------------------------------------------------
def test_clean_dirty_table(spark):
    done = A.clean(to_spark(spark, dirty()), target="Target")
    rows = {r["Date"]: r for r in done.data.collect()}
    assert rows["2024-01-05"]["Income_was_missing"] == 1 and rows["2024-01-01"]["Income_was_missing"] == 0
    assert rows["2024-01-05"]["Income"] == dirty()["Income"].median()
    assert "HighNullCol_was_missing" not in done.data.columns and rows["2024-01-02"]["HighNullCol"] is None
    report = {r["column"]: r for r in done.report.collect()}
    assert report["HighNullCol"]["action"] == "high_missing" and report["Income"]["action"] == "median"
    assert report["Age"]["outliers"] == 1 and report["Target"]["action"] == "target"
    assert done.mechanism == "MCAR/MAR"


def test_clean_drops_duplicates_after_filling(spark):
    frame = pd.DataFrame({"a": [1.0, 2.0, 2.0, np.nan, np.nan, 2.0, 3.0], "b": ["x", "y", "y", "y", "y", None, "x"]})
    done = A.clean(to_spark(spark, frame))
    assert done.duplicates_removed().first()[0] == 2  # (2, y) twice and the two filled rows
    assert done.data.count() == 5


def test_mode_ties_and_unknown(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), ("a", None), ("b", None)], "s string, n string")
    done = A.clean(df, max_missing=100.0)
    filled = [r for r in done.data.collect() if r["s_was_missing"] == 1]
    assert [(r["s"], r["n"]) for r in filled] == [("a", "Unknown")]


def test_missing_booleans_and_dates_take_the_mode(spark):
    df = spark.createDataFrame(
        [(True, dt.date(2024, 1, 1)), (True, dt.date(2024, 1, 2)), (False, dt.date(2024, 1, 1)), (None, None)], "f boolean, d date"
    )
    row = A.clean(df).data.where("f_was_missing = 1").first()
    assert row["f"] is True and row["d"] == dt.date(2024, 1, 1)


def test_mechanism_of_joint_gaps(spark):
    frame = golden().assign(Other=lambda d: np.where(d.Salary.isna(), np.nan, 1.0))
    done = A.clean(to_spark(spark, frame))
    assert done.mechanism == "MAR/MNAR" and "max r=1.00" in done.notes
    assert A.clean(to_spark(spark, frame[["Age"]])).mechanism == "none"


def test_winsorising(spark):
    frame = pd.DataFrame({"v": [*np.arange(200.0), 10_000.0], "t": range(201), "gap": [np.nan] * 101 + list(range(100))})
    df = to_spark(spark, frame)
    capped = A.winsorize(df, ["v", "gap"]).toPandas()
    assert capped.v.max() == pytest.approx(frame.v.quantile(0.99)) and capped.gap.isna().sum() == 101
    done = A.clean(df, target="t", cap_outliers=True)
    report = {r["column"]: r for r in done.report.collect()}
    assert report["v"]["winsorized"] and not report["t"]["winsorized"]
    assert done.data.agg(F.max("v")).first()[0] == pytest.approx(frame.v.quantile(0.99))


# --- features ------------------------------------------------------------------------------------------------
def test_interactions_and_logs(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=500)
    frame = pd.DataFrame({"a": a, "b": a + rng.normal(size=500), "c": a * 1.01, "s": rng.exponential(size=500) - 0.5, "y": a})
    done = A.engineer(to_spark(spark, frame), target="y")
    report = {r["feature"]: r for r in done.report.collect()}
    assert set(report) == {"a_x_b", "b_x_c", "s_log1p"}  # a and c are too close
    got = done.data.toPandas()
    assert np.allclose(got["a_x_b"], (frame.a - frame.a.mean()) * (frame.b - frame.b.mean()))
    assert np.allclose(got["s_log1p"], np.log1p(frame.s + abs(frame.s.min()) + 1))
    assert report["s_log1p"]["before"] == pytest.approx(frame.s.skew())
    assert report["s_log1p"]["after"] == pytest.approx(got["s_log1p"].skew())


def test_date_detection_and_parts(spark):
    df = spark.createDataFrame(
        [("2024-01-06", "x", "03/15/2024", None), ("2024-01-08 10:00:00", "2024-02-02", "12/31/2023", None), ("bad", "y", None, "20240101")],
        "a string, b string, c string, d string",
    )
    assert A.detect_datetime(df) == ["a", "c"]
    got = A.date_parts(df).collect()
    assert "a" not in got[0].asDict() and "b" in got[0].asDict()
    by = {(r["a_year"], r["a_month"], r["a_dayofweek"], r["a_is_weekend"]) for r in got}
    assert by == {(2024, 1, 5, 1), (2024, 1, 0, 0), (None, None, None, 0)}


def test_native_times_are_detected(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), "x")], "t timestamp, d date, s string")
    assert A.detect_datetime(df) == ["t", "d"]


def test_older_forms(spark):
    rng = np.random.default_rng(1)
    a = rng.exponential(size=300)
    frame = pd.DataFrame({"a": a, "b": a + rng.normal(size=300) * 0.1})
    df = to_spark(spark, frame)
    assert np.allclose(H.squared_skewed(df).toPandas()["a_sq"], frame.a**2)
    assert np.allclose(H.raw_interactions(df).toPandas()["a_x_b"], frame.a * frame.b)
    assert T.detect_target_or_classes(to_spark(spark, pd.DataFrame({"n": range(50), "g": list("abcde") * 10}))) == "g"


# --- target ---------------------------------------------------------------------------------------------------
def test_target_detection_order(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 6)], "id bigint, two string, also bigint")
    assert A.detect_target(df) == "two"
    assert A.detect_target(df.withColumn("LABEL", F.lit(1))) == "LABEL"
    assert A.detect_target(df.select("id")) is None


def test_balance_of_one_class(spark):
    row = A.class_balance(spark.createDataFrame([("a",), ("a",), (None,)], "t string"), "t").first()
    assert (row["classes"], row["imbalance_ratio"], row["imbalance_severity"]) == (1, None, "balanced")


def test_split_is_exact_and_stable(spark):
    df = spark.range(1237).withColumn("v", F.col("id") % 7)
    parts = A.split(df)
    train = {r["id"] for r in parts.train.collect()}
    test = {r["id"] for r in parts.test.collect()}
    assert (len(train), len(test)) == (int(1237 * 0.8), 1237 - int(1237 * 0.8)) and not train & test
    again = A.split(df.repartition(9))
    assert {r["id"] for r in again.train.collect()} == train
    assert {r["id"] for r in A.split(df, seed=1).train.collect()} != train
    assert A.split(spark.range(9)).status == "SKIPPED"


@pytest.mark.parametrize("copies", [1, 3, 40])
def test_split_of_copies(spark, copies):
    df = spark.range(100 * copies).select((F.col("id") % 100 % 3).alias("a"), F.lit("x").alias("b"))
    parts = A.split(df)
    assert parts.train.count() == int(100 * copies * 0.8)
    assert parts.train.unionAll(parts.test).groupBy("a").count().orderBy("a").collect() == df.groupBy("a").count().orderBy("a").collect()


def test_split_by_a_key_that_holds_a_third(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    for seed in range(4):
        parts = A.split(df, seed=seed, keys=["k"])
        assert (parts.train.count(), parts.test.count()) == (2400, 600)
        assert parts.train.unionAll(parts.test).distinct().count() == 3000


def test_copies_are_counted_before_they_are_hashed(spark, monkeypatch):
    """Rows of a few combinations of keys need no sketches and proofs of their hashes, scan by scan."""
    df = spark.range(4000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 5 > 0, "x").alias("b"))
    slow = {}
    monkeypatch.setattr(T, "FEW_HASHES", 0)
    for keys in (None, ["a"], ["a", "b"]):
        slow[str(keys)] = A.split(df, keys=keys).train.groupBy("a", "b").count().orderBy("a", "b").collect()
    monkeypatch.undo()

    def never(*args, **kwargs):
        raise AssertionError("hashes of copies were searched")

    monkeypatch.setattr(T, "order_positions", never)
    for keys in (None, ["a"], ["a", "b"]):
        parts = A.split(df, keys=keys)
        assert parts.train.groupBy("a", "b").count().orderBy("a", "b").collect() == slow[str(keys)]
        assert (parts.train.count(), parts.test.count()) == (3200, 800)


def test_repeated_rows_are_made_in_blocks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 10)], "k string, n bigint")
    got = T._repeat(df, F.col("n"), ["k"], block=10).groupBy("k").count().orderBy("k").collect()
    assert [(r["k"], r["count"]) for r in got] == [("a", 25), ("c", 10)]


def test_imputer_is_fitted_on_train_only(spark):
    frame = golden().assign(Kind=lambda d: np.where(d.Age > 40, None, "young"))
    df = to_spark(spark, frame)
    parts = A.split(df)
    train = parts.train.toPandas()
    fill = A.fit_imputer(parts.train, target="Target")
    assert fill["Salary"] == pytest.approx(train.Salary.median()) and fill["Kind"] == "young" and "Target" not in fill
    done = A.ml_prepare(df, target="Target")
    for part in (done.train, done.test):
        assert part.where("Salary is null or Kind is null").count() == 0
    assert done.train.count() == int(1312 * 0.8)


def test_ml_readiness_modes(spark):
    df = to_spark(spark, golden())
    assert set(A.ml_readiness(df, "Target")) == {"class_distribution", "class_balance", "leakage"}
    assert set(A.ml_readiness(df)) == {"redundant", "vif"}


# --- drift ------------------------------------------------------------------------------------------------------
def _ks(early, late):
    grid = np.sort(np.concatenate([early, late]))
    return np.max(np.abs(np.searchsorted(np.sort(early), grid, side="right") / len(early) - np.searchsorted(np.sort(late), grid, side="right") / len(late)))


@pytest.mark.parametrize("bucket", [2_000_000, 40])
@pytest.mark.parametrize("days", [500, 7, 1])
def test_drift(spark, bucket, days):
    """Few distinct days put many rows at the cut; rows without a time come last, missing values count as rows."""
    rng = np.random.default_rng(days)
    n = 501
    frame = pd.DataFrame({"day": rng.integers(0, days, n), "v": rng.normal(size=n).round(2)})
    frame["t"] = [f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}" if d // 28 < 12 else None for d in frame.day]
    frame.loc[rng.random(n) < 0.1, "v"] = np.nan
    ordered = frame.assign(key=frame.t.fillna("9999")).sort_values(["key", "v"], na_position="last")
    early, late = ordered.v.iloc[: n // 2].dropna().to_numpy(), ordered.v.iloc[n // 2 :].dropna().to_numpy()
    row = A.drift_ks(to_spark(spark, frame[["t", "v"]]), "t", "v", rows_per_bucket=bucket).first()
    assert (row["n_early"], row["n_late"]) == (len(early), len(late))
    assert row["ks_stat"] == pytest.approx(_ks(early, late), abs=1e-4)
    assert row["ks_pvalue"] == pytest.approx(tails.two_sample_ks_tail(_ks(early, late), len(early), len(late)), abs=1e-4)


def test_drift_needs_values(spark):
    df = spark.createDataFrame([(f"2024-01-0{i}", float(i)) for i in range(1, 9)], "t string, v double")
    row = A.drift_ks(df, "t", "v").first()
    assert row["ks_stat"] is None and row["drift_detected"] is False and row["n_early"] == 4
    assert A.drift_ks(df.limit(1), "t", "v").first()["ks_stat"] is None


def test_rolling_mean(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=100).strftime("%Y-%m-%d"), "v": rng.normal(size=100), "k": ["a"] * 95 + ["b"] * 5})
    frame.loc[90, "v"] = np.nan
    df = to_spark(spark, frame.sample(frac=1, random_state=1))
    want = frame.v.rolling(30, min_periods=1).mean().iloc[-1]
    assert A.rolling_mean_last(df, "t", "v").first()[0] == pytest.approx(want, abs=1e-4)
    by = {r["k"]: r["rolling_mean_last"] for r in A.rolling_mean_last(df, "t", "v", by=["k"]).collect()}
    assert by["b"] == pytest.approx(frame.v[95:].mean(), abs=1e-4)
    assert by["a"] == pytest.approx(frame.v[65:95].mean(), abs=1e-4)


def test_temporal_report(spark):
    none = A.temporal_report(spark.createDataFrame([("x", 1.0)], "s string, v double")).first()
    assert none["has_datetime"] is False and none["date_col"] is None
    frame = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=60).strftime("%Y-%m-%d"), "v": np.arange(60.0)})
    row = A.temporal_report(to_spark(spark, frame)).first()
    assert row["date_col"] == "t" and row["ks_stat"] == 1.0 and row["drift_detected"]
    assert row["first_time"] == dt.datetime(2024, 1, 1) and row["rolling_mean_last"] == 44.5


def test_chronological_puts_unreadable_times_last(spark):
    df = spark.createDataFrame([("2024-02-01", 1), ("bad", 2), ("2024-01-01", 3)], "t string, i bigint")
    assert [r["i"] for r in A.chronological(df, "t").collect()] == [3, 1, 2]


# --- charts -------------------------------------------------------------------------------------------------------
def test_histogram(spark):
    values = np.random.default_rng(2).normal(size=1000)
    rows = A.histogram(to_spark(spark, pd.DataFrame({"v": values})), "v").orderBy("bin").collect()
    assert [r["n"] for r in rows] == list(np.histogram(values, bins=30)[0])
    constant = A.histogram(spark.range(5).select(F.lit(2.0).alias("v")), "v").collect()
    assert [(r["bin"], r["n"]) for r in constant] == [(0, 5)]


def test_box_and_pair_tables(spark):
    frame = golden()
    df = to_spark(spark, frame)
    box = {r["column"]: r for r in A.box_stats(df).collect()}
    q1, q3 = frame.Age.quantile(0.25), frame.Age.quantile(0.75)
    inside = frame.Age[(frame.Age >= q1 - 1.5 * (q3 - q1)) & (frame.Age <= q3 + 1.5 * (q3 - q1))]
    assert box["Age"]["whisker_high"] == pytest.approx(inside.max()) and box["Age"]["n_outside"] == 1312 - len(inside)
    heat = {(r["x"], r["y"]): r["r"] for r in A.corr_heatmap(df).collect()}
    assert heat[("Age", "Salary")] == heat[("Salary", "Age")] == pytest.approx(frame.Age.corr(frame.Salary))
    assert heat[("Age", "Age")] == 1.0
    pair = A.top_pair(df).first()
    assert {pair["col1"], pair["col2"]} == {"Age", "Salary"}
    points = A.top_pair_scatter(df, rows=100).collect()
    assert len(points) == 100 and points[0]["x_name"] == pair["col1"]


def test_chart_tables(spark):
    frame = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=60).strftime("%Y-%m-%d"), "v": np.arange(60.0), "w": np.arange(60.0) ** 2, "g": ["a", "b", "b"] * 20})
    tables = A.chart_tables(to_spark(spark, frame), target="g")
    assert set(tables) == {"correlation_heatmap", "scatter", "distribution", "box", "trend"}
    assert [tuple(r) for r in tables["distribution"].collect()] == [("b", 40), ("a", 20)]
    assert [r["value"] for r in tables["trend"].collect()] == list(range(60))
    assert "frequency" in A.chart_tables(to_spark(spark, frame[["v", "g"]]))


# --- claims ---------------------------------------------------------------------------------------------------------
def test_claims_of_the_golden_table(spark):
    audit = A.audit(to_spark(spark, golden()), target="Target")
    claims = audit.claims().collect()
    assert [c["claim_id"] for c in sorted(claims, key=lambda c: int(c["claim_id"][6:]))] == [f"claim_{i + 1}" for i in range(len(claims))]
    texts = [c["claim"] for c in claims]
    assert any("312 duplicate rows (23.7805%), representing a high" in t for t in texts)
    nulls = int(golden().Salary.isna().sum())
    assert any(f"Column 'Salary' has {round(nulls * 100 / 1312, 4)}% missing values ({nulls} rows), categorized as low" in t for t in texts)
    assert any("class distribution of {'0': " in t for t in texts)
    gated = A.gate_claims(audit.claims())
    assert {r["status"]: r["n"] for r in A.gate_counts(gated).collect()} == {"supported": len(claims)}


def test_audit_tables_have_rows_for_every_part(spark):
    tables = A.audit(to_spark(spark, dirty())).tables()
    assert {"schema", "column_quality", "table_quality", "numeric_dist", "categorical_dist", "correlations", "group_tests", "simpsons", "vif", "redundant", "class_balance", "leakage", "pii"} <= set(tables)
    assert all(len(t.columns) > 1 for t in tables.values())


@pytest.mark.parametrize(
    ("text", "pct", "p", "normal", "reason"),
    [
        ("Age CAUSES income", None, None, None, "Banned Claim Rule"),
        ("because of age", None, None, None, None),
        ("critical missing values", 4.9, None, None, "Severity Misclassification: 4.9%"),
        ("critical missing values", 5.0, None, None, None),
        ("critical missing values", None, None, None, None),
        ("It is statistically significant", None, 0.05, None, "Unsupported Significance: p_adj=0.05"),
        ("It is statistically significant", None, None, None, None),
        ("x is normally distributed", None, None, None, "Unsupported Normality"),
        ("x is normally distributed", None, None, True, None),
        ("drop the missing column", 60.0, None, None, "Banned Recommendation"),
        ("an anomaly", None, None, None, "Banned Anomaly Claim"),
        ("an anomaly by class imbalance", None, None, None, None),
        ("drives an anomaly", None, None, None, "Banned Claim Rule"),
    ],
)
def test_gate(spark, text, pct, p, normal, reason):
    df = spark.createDataFrame([(text, pct, p, normal)], "claim string, pct double, p double, ok boolean")
    row = A.gate(df, "claim", "pct", "p", "ok").first()
    assert row["status"] == ("supported" if reason is None else "unsupported")
    assert (row["failure_reason"] or "").startswith(reason or "")


def test_clean_drops_equal_rows_that_hold_maps(spark):
    df = spark.createDataFrame([({"a": 1}, 1), ({"a": 1}, 1), ({"a": 2}, 1)], "m map<string,int>, n int")
    done = A.clean(df)
    assert done.data.count() == 2 and done.data.columns == ["m", "n"]


def test_interactions_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(1e6, 1, 4000)
    frame = pd.DataFrame({"k": range(4000), "a": a, "b": a + rng.normal(0, 2, 4000)})
    df = spark.createDataFrame(frame)
    means = []
    for n in (1, 5, 16):
        out = H.interactions(df.repartition(n), ["a", "b"]).select("k", "a_x_b").orderBy("k").toPandas()
        means.append(out["a_x_b"].to_numpy())
    assert all(np.array_equal(means[0], m) for m in means[1:])


def test_codes_by_first_appearance(spark):
    rows = [(1, "z", 0.0), (2, "a", 1.0), (3, "z", 0.0), (4, "m" * 300, 2.0), (5, None, -1.0)]
    df = spark.createDataFrame(rows, "at bigint, t string, v double")
    for small in (100, 0):
        coded = T.target_codes(df, "t", small=small, order_col="at")
        assert {r["at"]: r["target_code"] for r in coded.collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 2.0, 5: -1.0}
    found = {r["column"]: r["correlation"] for r in A.leakage(df, "t", order_col="at").collect()}
    assert found["v"] == 1.0


def test_trend_means_use_all_rows(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-31", 3.0), ("2024-02-01", None), ("x", 9.0)], "d string, v double")
    found = [(r["ts"] and r["ts"].strftime("%Y-%m"), r["n"], r["mean"]) for r in trend_means(df, "d", "v", "month").collect()]
    assert found == [("2024-01", 2, 2.0), ("2024-02", 0, None), (None, 1, 9.0)]
