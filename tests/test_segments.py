"""Evidence by segment against the same operator on the rows of each segment, and claims against evidence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableaudit.functions import constants as K
from tableaudit.operators import claims as C
from tableaudit.operators.distribution import categorical_profile, numeric_profile
from tableaudit.operators.quality import column_quality, table_quality
from tableaudit.operators.relations import correlations, simpsons
from tableaudit.operators.segments import correlations_by, numeric_profile_by
from tableaudit.operators.target import class_balance, class_distribution
from tableaudit.plans.spreads import group_quantiles, spreads

SEGMENTS = [("a", 1), (None, 1), ("hot", 7)]


@pytest.fixture(scope="module")
def messy(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        seg = SEGMENTS[2] if i % 3 == 0 else rng.choice(SEGMENTS[:2])
        x = rng.gauss(0, 1)
        rows.append(
            (
                *seg,
                None if rng.random() < 0.1 else x,
                float(rng.choice([0.0, -999.0, 5.0])) if rng.random() < 0.9 else float("nan"),
                rng.choice([-999, 3, None, 4]),
                x * 2 + rng.gauss(0, 0.1),
                rng.choice(["x", "X ", "y", None, "long" * 100]) if rng.random() < 0.03 else "same",
                rng.choice(["p", "q", "r"]),
                None,
            )
        )
    schema = "seg string, `part.no` int, x double, y double, k int, z double, name string, kind string, empty string"
    return spark.createDataFrame(rows + rows[:200], schema).repartition(5)


BY = ["seg", "part.no"]


def each(messy, operator, **kwargs):
    """Rows of ``operator`` on every segment by itself, with the segment."""
    out = []
    for seg, part in SEGMENTS:
        rows = messy.where(F.col("seg").eqNullSafe(F.lit(seg)) & F.col("`part.no`").eqNullSafe(F.lit(part))).drop(
            "seg", "part.no"
        )
        out += [((seg, part), r.asDict(recursive=True)) for r in operator(rows, **kwargs).collect()]
    return out


def same(found, want, skip=()):
    got = []
    for r in found.collect():
        row = r.asDict(recursive=True)
        got.append(((row.pop("seg"), row.pop("part.no")), row))
    clean = lambda rows: sorted(
        (
            (seg, sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in row.items() if k not in skip))
            for seg, row in rows
        ),
        key=repr,
    )
    assert clean(got) == clean(want)
    assert got


def test_column_quality(messy):
    same(column_quality(messy, by=BY), each(messy, column_quality))


def test_table_quality(messy):
    same(table_quality(messy, by=BY), each(messy, table_quality))


def test_categorical_profile(messy):
    want = [(s, r) for s, r in each(messy, categorical_profile, top=3) if r["place"] is not None]
    same(categorical_profile(messy, top=3, by=BY), want)


def test_classes(messy):
    same(class_distribution(messy, "kind", by=BY), each(messy, lambda df: class_distribution(df, "kind")))
    same(class_balance(messy, "kind", by=BY), each(messy, lambda df: class_balance(df, "kind")))


@pytest.mark.parametrize("direct", [1_000_000, 100])
def test_numeric_profile(messy, direct):
    found = numeric_profile_by(messy, BY, direct=direct) if direct < 1000 else numeric_profile(messy, by=BY)
    same(found, each(messy, numeric_profile))


@pytest.mark.parametrize("window_rows", [5_000_000, 700])
def test_correlations(messy, window_rows):
    slim = messy.select(*[f"`{b}`" for b in BY], "x", "y", "z", "k")
    found = correlations_by(slim, BY, window_rows=window_rows)
    same(found, each(slim, correlations), skip=("position",))


def test_pearson_family(messy):
    slim = messy.select(*[f"`{b}`" for b in BY], "x", "y", "z")
    same(correlations(slim, method="pearson", by=BY), each(slim, correlations, method="pearson"), skip=("position",))


def test_reversals(spark):
    rng = random.Random(2)
    rows = []
    for seg in ("s", "t", None):
        for _ in range(300):
            g, x = rng.choice([0, 10, 20]), rng.random() * 5
            y = g - x if seg != "t" else g + x
            rows.append((seg, 1 if seg == "t" else 2, x + g, y + rng.random(), f"g{g}", rng.choice("uvwxyz"), "one"))
    schema = "seg string, `part.no` int, a double, b double, grp string, many string, one string"
    df = spark.createDataFrame(rows, schema)
    found = simpsons(df, by=BY)
    want = []
    for seg, part in (("s", 2), ("t", 1), (None, 2)):
        part_rows = df.where(F.col("seg").eqNullSafe(F.lit(seg))).drop("seg", "part.no")
        want += [((seg, part), r.asDict()) for r in simpsons(part_rows).collect()]
    same(found, want)
    assert {s for (s, _), _ in want} == {"s", None}


def test_no_segment_columns(messy):
    with pytest.raises(ValueError):
        numeric_profile_by(messy, [])


# --- spreads ------------------------------------------------------------------------------------------------
def plain_spread(values):
    x = np.array(values, float)
    q25, median, q75 = np.quantile(x, [0.25, 0.5, 0.75])
    away = np.abs(x - median)
    mad = np.median(away)
    far = 0.6745 * away / mad > 3.5 if mad > 0 else np.zeros(len(x), bool)
    out = (x < q25 - 1.5 * (q75 - q25)) | (x > q75 + 1.5 * (q75 - q25))
    return (len(x), q25, median, q75, mad, far.sum(), out.sum(), (far | out).sum())


@pytest.mark.parametrize("direct", [1_000_000, 40, 3])
def test_spreads(spark, direct):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=3000),
        "ties": rng.integers(0, 3, 2000),
        "one": [4.0],
        "two": [1.0, 2.0],
        "constant": [3.0] * 500,
        "mostly zero": np.where(rng.random(2500) < 0.9, 0, rng.normal(size=2500) * 100),
        "infinite": [float("inf"), 1.0, 2.0, 3.0, -5.0, 4.0, 9.0],
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    long = spark.createDataFrame(rows, "g string, value double").repartition(6)
    got = {r["g"]: tuple(r)[1:] for r in spreads(long, ["g"], direct=direct).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        if g == "infinite":
            continue
        assert np.allclose(np.array(got[g], float), np.array(plain_spread(values), float)), g
    assert got["infinite"][2] == 3.0


def test_quantiles_of_large_groups_narrow(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.exponential(size=20_000)] + [("b", float(v)) for v in range(5000)]
    long = spark.createDataFrame(rows, "g string, value double")
    groups = long.groupBy("g").agg(F.count("value").alias("n"))
    got = {r["g"]: (r["p"], r["q"]) for r in group_quantiles(long, groups, ["g"], {"p": 0.1, "q": 0.999}, direct=20).collect()}
    for g in "ab":
        values = [v for k, v in rows if k == g]
        assert np.allclose(got[g], np.quantile(values, [0.1, 0.999]))


# --- claims against evidence ----------------------------------------------------------------------------------
def test_every_sentence_reads_back(spark):
    """The inverse of each template finds the facts that went in, also with quotes and line breaks in names."""
    for spec in C.CLAIMS:
        words, want = spec.pieces[0], {}
        for i, (name, wording) in enumerate(zip(spec.pieces[1::2], spec.pieces[2::2])):
            value = ["-0.25", "17", "1.0E-5", "None"][i % 4] if name in spec.numbers else f"it's {{a}}\n$%{i}"
            want[name] = value
            words += value + wording
        df = spark.createDataFrame([(words,), (words + "!",), (None,)], "claim string")
        said = [r["said"] for r in C.read_claims(df).collect()]
        assert said[1] is None and said[2] is None
        assert said[0]["metric"] == spec.metric
        assert said[0]["subject"] == "\u0001".join(want[s] for s in spec.subject)
        assert dict(said[0]["numbers"]) == {k: v for k, v in want.items() if k in spec.numbers}
        assert dict(said[0]["labels"]) == {k: v for k, v in want.items() if k in spec.labels and k not in spec.subject}


def test_numbers_within_their_rounding(spark):
    known = spark.createDataFrame(
        [("missingness", "c", {"missing_pct": 12.3456, "null_count": 7.0}, {"severity": "moderate"})],
        "metric string, subject string, numbers map<string,double>, labels map<string,string>",
    )
    text = "Column '{}' has {}% missing values ({} rows), categorized as {} severity."
    cases = [
        (text.format("c", "12.3456", 7, "moderate"), None),
        (text.format("c", "12.3", 7, "moderate"), None),
        (text.format("c", "12", 7, "moderate"), None),
        (text.format("c", "12.4", 7, "moderate"), K.REASON_NUMBER % ("missing_pct", "12.4", "12.3456")),
        (text.format("c", "12.35", 8, "moderate"), K.REASON_NUMBER % ("null_count", "8", "7.0")),
        (text.format("c", "None", 7, "moderate"), K.REASON_NUMBER % ("missing_pct", "None", "12.3456")),
        (text.format("c", "12.3456", 7, "low"), K.REASON_LABEL % ("severity", "low", "moderate")),
        (text.format("d", "12.3456", 7, "moderate"), K.REASON_NO_EVIDENCE),
        ("Nothing of note.", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, c, "x") for i, (c, _) in enumerate(cases)], "i int, claim string, labels string")
    got = {r["i"]: r for r in C.check_numbers(df, known).collect()}
    for i, (_, reason) in enumerate(cases):
        assert got[i]["mismatch"] == reason, cases[i]
        assert got[i]["checked"] == (i < 8)
    rules = {r["i"]: r["status"] for r in C.gate_numbers(C.gate(df, "claim"), known).collect()}
    assert [rules[i] for i in range(10)] == ["supported"] * 3 + ["unsupported"] * 5 + ["supported"] * 2


def test_all_claims_of_an_audit_agree_with_its_evidence(spark, messy):
    import tableaudit as ta

    df = messy.drop("seg", "part.no").withColumn("target", F.when(F.col("k") == 3, "yes").otherwise("no"))
    done = ta.audit(df, target="target")
    known = C.facts(done.tables())
    rows = C.check_numbers(done.claims(), known).collect()
    assert rows and all(r["checked"] and r["mismatch"] is None for r in rows)
    subgroups = [r["evidence"]["subgroups"] for r in rows if r["evidence"]["metric"] == "simpsons"]
    assert all(subgroups)
    shapes = [r["evidence"] for r in rows if r["evidence"]["metric"] == "shape"]
    assert all(e["mean"] is not None and e["median"] is not None for e in shapes)


def test_many_classes_stay_rows(spark):
    df = spark.range(20_000).select((F.col("id") % 7000).cast("string").alias("t"))
    claim = C.balance_claims(class_distribution(df, "t"), class_balance(df, "t")).first()
    assert "7000 classes" in claim["claim"] and len(claim["claim"]) < 300


def test_values_meet_ranges_without_a_lambda_a_row(spark):
    """Ranges as arrays were searched by interpreted lambdas: most of the time of large groups."""
    from tableaudit.plans import spreads as plan

    rows = "g string, slot string, start double, end double"
    state = spark.createDataFrame([("a", "p", None, 3.0), ("a", "q", 2.0, None), ("b", "q", 1.0, 1.0)], rows)
    long = spark.createDataFrame([(g, float(v)) for g in "abc" for v in range(6)], "g string, value double")
    held = plan._held(long, state, ["g"], ["p", "q"])
    assert "lambda" not in held._jdf.queryExecution().toString()
    want = [("a", "p", v) for v in (0.0, 1.0, 2.0, 3.0)] + [("a", "q", v) for v in (2.0, 3.0, 4.0, 5.0)] + [("b", "q", 1.0)]
    assert sorted(map(tuple, held.collect())) == want


def test_no_scan_for_small_groups_where_there_are_none(spark, monkeypatch):
    from tableaudit.plans import spreads as plan

    def never(*args, **kwargs):
        raise AssertionError("rows were read for groups that are not there")

    long = spark.createDataFrame([(g, float(v * k % 37)) for g, k in (("a", 3), ("b", 5)) for v in range(400)], "g string, value double")
    monkeypatch.setattr(plan, "counted_spreads", never)
    got = {r["g"]: tuple(r)[1:] for r in plan.spreads(long, ["g"], direct=20).collect()}
    for g, k in (("a", 3), ("b", 5)):
        assert np.allclose(np.array(got[g], float), np.array(plain_spread([v * k % 37 for v in range(400)]), float))
