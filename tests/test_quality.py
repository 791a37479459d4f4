import numpy as np
import pandas as pd
import pytest
from data import contacts, dirty, golden, to_spark
from pyspark.sql import functions as F

import tableaudit as A
from tableaudit.functions import constants as K
from tableaudit.operators.pii import is_luhn_number


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_dirty_table(spark):
    df = to_spark(spark, dirty())
    assert A.detect_target(df) == "Target"
    found = by_column(A.column_quality(df))
    assert found["HighNullCol"]["severity"] == "critical" and found["HighNullCol"]["missing_pct"] == 80.0
    assert found["Income"]["null_count"] == 1
    assert found["ZeroVarCol"]["is_constant"] and not found["Age"]["is_constant"]
    legacy = by_column(A.missing_values(df, labels="legacy"))
    assert legacy["HighNullCol"]["severity"] == "HIGH (>40%)"
    shape = A.schema_evidence(df, "Target").first()
    assert (shape["total_rows"], shape["total_cols"]) == (10, 7)


def test_golden_counts(spark):
    frame = golden()
    df = to_spark(spark, frame)
    whole = A.table_quality(df).first()
    assert whole["duplicate_rows"] == 312
    assert whole["total_nulls"] == int(frame.isna().sum().sum())
    assert whole["duplicate_severity"] == "high"
    assert by_column(A.column_quality(df))["Salary"]["severity"] == "low"
    balance = A.class_balance(df, "Target").first()
    assert balance["imbalance_ratio"] == pytest.approx(0.25, abs=0.05)


def test_quasi_constant_counts_whole_column(spark):
    n = 4000
    values = ["same"] * 3800 + [f"v{i}" for i in range(200)]
    df = to_spark(spark, pd.DataFrame({"quasi": values, "id": [f"k{i}" for i in range(n)], "under": ["a"] * 3799 + ["b"] * 201}))
    found = by_column(A.column_quality(df))
    assert found["quasi"]["is_quasi_constant"] and found["quasi"]["top_value"] == "same" and found["quasi"]["top_pct"] == 95.0
    assert not found["id"]["is_quasi_constant"] and not found["under"]["is_quasi_constant"]


def test_sentinels_compare_text(spark):
    df = spark.createDataFrame(
        [(-999, -999.0, " N/A ", "n/a", "0000-00-00"), (1, 1.0, "x", "NULL", "2024-01-01")],
        "a bigint, b double, c string, d string, e string",
    )
    found = {r["column"]: r["sentinels"] for r in A.sentinel_values(df).collect()}
    assert found == {"a": ["-999"], "c": ["N/A"], "e": ["0000-00-00"]}


def test_variants_strip_every_whitespace(spark):
    df = spark.createDataFrame([("Male",), ("male ",), (" MALE ",), ("female",), (None,)], "g string")
    assert {r["variant"] for r in A.category_variants(df).collect()} == {"Male", "male ", " MALE "}


def test_quality_score_of_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "a double, b string")
    row = A.table_quality(empty).first()
    assert row["total_rows"] == 0 and row["overall_score"] == 100.0 and row["grade"] == "A+"
    one = spark.createDataFrame([(1.0, "x")], "a double, b string")
    assert A.table_quality(one).first()["is_high_dimensional"]


def test_luhn(spark):
    cases = {"4532015112830366": True, "4532-0151-1283-0366": True, "4532015112830367": False, "123": False}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert {r[0]: r[1] for r in df.select("v", is_luhn_number(F.col("v"))).collect()} == cases


def test_contact_findings(spark):
    found = by_column(A.detect_pii(to_spark(spark, contacts())))
    assert found["Email"]["type"] == K.EMAIL_TYPE and found["Email"]["confidence"] == "HIGH"
    assert found["CreditCard"]["type"] == K.CARD_TYPE and found["CreditCard"]["matched"] == 50
    assert found["Phone"]["type"] == K.PHONE_TYPE
    assert "Age" not in found
    variants = {r["column"] for r in A.category_variants(to_spark(spark, contacts())).collect()}
    assert variants == {"Gender"}


def test_pii_falls_through_to_the_next_rule(spark):
    rows = [(f"{i}@x.org" if i < 3 else "10.0.0.1", "123-45-6789", "Ann", "nan") for i in range(100)]
    df = spark.createDataFrame(rows, "shipping string, code string, user_name string, email_note string")
    found = by_column(A.detect_pii(df))
    assert found["shipping"]["type"] == K.IP_TYPE  # 3 % e-mail addresses are too few
    assert found["code"]["type"] == K.SSN_TYPE
    assert found["user_name"]["matched"] == 100
    assert "email_note" not in found  # no real values at all


def test_pii_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(4532015112830366.0, 15550100123)], "card double, contact_no bigint")
    found = by_column(A.detect_pii(df))
    assert found["contact_no"]["type"] == K.PHONE_TYPE
    # 4532015112830366.0 has 17 digits as text, which is not a valid card
    assert "card" not in found


def test_masking_hides_values(spark):
    df = to_spark(spark, contacts())
    masked = A.mask_pii(df, A.detect_pii(df), salt="s")
    row = masked.first()
    assert row["CreditCard"] == "************0366"
    assert row["Email"] == "[redacted email]"
    assert row["Phone"] == "+**********"
    assert row["Gender"] == "Male"


def test_sampled_pii_scan(spark):
    df = to_spark(spark, contacts())
    assert by_column(A.detect_pii(df, sample_rows=30))["Email"]["matched"] == 30


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert A.missing_values(df).first()["null_count"] == 2


def test_results_do_not_depend_on_partitions(spark):
    df = to_spark(spark, golden())
    shuffled = df.orderBy(F.rand(5)).repartition(7)
    for f in (A.column_quality, A.table_quality, A.numeric_profile):
        assert sorted(map(str, f(df).collect())) == sorted(map(str, f(shuffled).collect()))


def test_wide_table(spark):
    df = spark.range(60).select(*[(F.col("id") * i % 17).cast("double").alias(f"c{i}") for i in range(1, 201)])
    assert A.column_quality(df).count() == 200
    profile = A.numeric_profile(df)
    assert profile.count() == 200
    assert A.redundant_pairs(df).count() > 0


def test_profile_equals_pandas(spark):
    frame = golden()
    found = by_column(A.numeric_profile(to_spark(spark, frame)))
    for c in ("Age", "Salary", "Target"):
        s, r = frame[c].dropna(), found[c]
        q1, q3, med = s.quantile(0.25), s.quantile(0.75), s.median()
        mad = np.median(np.abs(s - med))
        z = 0.6745 * np.abs(s - med) / mad if mad > 0 else np.zeros(len(s))
        out = (s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))
        want = {
            "mean": s.mean(), "std": s.std(), "median": med, "q25": q1, "q75": q3, "skewness": s.skew(), "kurtosis": s.kurt(),
            "variance": s.var(), "mad": mad,
        }
        for k, v in want.items():
            assert r[k] == pytest.approx(v, abs=1e-4, rel=1e-9), (c, k)
        assert (r["mad_count"], r["iqr_count"], r["total_outliers"]) == (int((z > 3.5).sum()), int(out.sum()), int(((z > 3.5) | out).sum()))
        assert r["test_used"] == K.SHAPIRO


def test_sketched_profile_is_close(spark):
    frame = golden()
    found = by_column(A.numeric_profile(to_spark(spark, frame), exact=False))
    assert found["Age"]["median"] == pytest.approx(frame["Age"].median(), abs=0.1)


def test_normality_gate(spark):
    rng = np.random.default_rng(0)
    df = to_spark(spark, pd.DataFrame({"n": rng.normal(size=6000), "e": rng.exponential(size=6000)}))
    found = by_column(A.normality(df))
    assert found["n"]["is_normal"] and found["n"]["test_used"] == K.DAGOSTINO
    assert not found["e"]["is_normal"]
    few = by_column(A.normality(spark.range(7).selectExpr("cast(id as double) x")))
    assert few["x"]["test_used"] == K.SAMPLE_CHECK and not few["x"]["is_normal"]


def test_profile_of_empty_constant_and_single(spark):
    df = spark.createDataFrame([(None, 2.0, None), (None, 2.0, 7.0)], "empty double, same double, one double")
    found = by_column(A.numeric_profile(df))
    assert "empty" not in found
    assert found["same"]["std"] == 0.0 and found["same"]["skewness"] == 0.0 and found["same"]["total_outliers"] == 0
    assert found["one"]["n"] == 1 and found["one"]["variance"] == 0.0
    assert A.numeric_profile(spark.createDataFrame([], "x double")).count() == 0


def test_categorical_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "d", "e", "f", "f", None]], "v string")
    rows = sorted((r["place"], r["value"], r["n"], r["pct"]) for r in A.categorical_profile(df).collect())
    assert [r[1] for r in rows] == ["f", "a", "b", "c", "d"]
    assert rows[0][3] == 28.57
    none = A.categorical_profile(spark.createDataFrame([(None,)], "v string")).collect()
    assert [(r["nunique"], r["value"]) for r in none] == [(0, None)]


def test_long_texts_are_shown_whole(spark):
    long = "x" * 300
    rows = [(long + "A", "a"), (long + "a", "a"), (long + "a", "a"), ("q\0r", "a"), ("q\0R", "a")] + [(long + "b", "a")] * 200
    df = spark.createDataFrame(rows, "t string, `other.name` string")
    found = {(r["variant"], r["n"]) for r in A.category_variants(df, ["t"]).collect()}
    assert found == {(long + "A", 1), (long + "a", 2), ("q\0r", 1), ("q\0R", 1)}
    assert {r["normalised"] for r in A.category_variants(df, ["t"]).collect()} == {long + "a", "q\0r"}
    quality = {r["column"]: r["top_value"] for r in A.column_quality(df).collect()}
    assert quality["t"] == long + "b"
    best = [(r["value"], r["n"]) for r in A.categorical_profile(df, columns=["t"]).orderBy("place").collect()]
    assert best[:2] == [(long + "b", 200), (long + "a", 2)]
    from tableaudit.operators.charts import frequency

    assert [r["value"] for r in frequency(df, "t").limit(1).collect()] == [long + "b"]
