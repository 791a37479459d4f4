"""Tiles of pair moments against numpy, and a table of 2000 columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableaudit.operators.relations import adjust_family, adjust_large_family, correlations, pearson_matrix, redundant_pairs, vif_scores
from tableaudit.plans import tiles
from tableaudit.plans.pairs import pair_moments


def frame(spark, data, names):
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in data]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)


@pytest.mark.parametrize("state", [1, 10_000, 256_000_000])
def test_tiles_equal_single_aggregates(spark, monkeypatch, state):
    monkeypatch.setattr(tiles, "STATE_BYTES", state)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 11)) + 1e3
    data[:, 3] = data[:, 1] * 2
    data[:, 4] = 7.0
    data[rng.random(data.shape) < 0.1] = np.nan
    data[:, :3] = rng.normal(size=(200, 3))
    data[5, 9] = np.inf
    names = [f"c{i}" for i in range(11)]
    df = frame(spark, data, names)
    values = {c: F.col(c) for c in names}
    want = {r["pair"]: r for r in pair_moments(df, values).collect()}
    got = {r["pair"]: r for r in tiles.tiled_pairs(df, values, width=4).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g["col1"], g["col2"], g["n_eff"]) == (w["col1"], w["col2"], w["n_eff"])
        assert (g["r"] is None) == (w["r"] is None), (g, w)
        if w["r"] is not None:
            assert abs(g["r"] - w["r"]) < 1e-9 and abs(g["cov"] - w["cov"]) < 1e-6
    strong = tiles.tiled_pairs(df, values, 0.5, width=4).collect()
    assert {r["pair"] for r in strong} == {k for k, w in want.items() if w["r"] is not None and abs(w["r"]) >= 0.5}
    best = {r["column"]: r["max_r2"] for r in tiles.tiled_best(df, values, width=4).collect()}
    for c in names:
        own = [w["r"] ** 2 for w in want.values() if c in (w["col1"], w["col2"]) and w["r"] is not None]
        assert abs(best[c] - max(own, default=0.0)) < 1e-9


def test_two_thousand_columns(spark):
    """No worker holds all pairs, and only strong pairs leave the tiles."""
    k = 2000
    base = spark.range(400, numPartitions=4)
    noise = [F.rand(i).alias(f"c{i}") for i in range(k - 1)]
    df = base.select(*noise).withColumn(f"c{k - 1}", F.col("c17") * 3 + 1)
    found = redundant_pairs(df).collect()
    assert [(r["col1"], r["col2"], r["corr"]) for r in found] == [("c17", f"c{k - 1}", 1.0)]
    state = max(len(share) for share in tiles._shares(-(-k // tiles.TILE), tiles.TILE)) * len(tiles._PARTS) * 8 * tiles.TILE**2
    assert state <= tiles.STATE_BYTES
    top = vif_scores(df).orderBy(F.desc("vif"), "column").limit(3).collect()
    assert {top[0]["column"], top[1]["column"]} == {"c17", f"c{k - 1}"} and top[0]["vif"] == 999.0 and top[2]["vif"] < 10


def test_matrix_of_a_wide_table_has_all_pairs(spark):
    k = tiles.TILE + 5
    df = spark.range(50).select(*[F.rand(i).alias(f"c{i}") for i in range(k)])
    assert pearson_matrix(df).count() == k * (k - 1) // 2


def test_large_families_are_adjusted_alike(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(3000) ** 4, 4)  # with ties
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "position int, raw_p_value double").repartition(5)
    want = {r["position"]: (r["p_adj"], r["is_significant"]) for r in adjust_family(df).collect()}
    for rows in (2_000_000, 100):
        got = {r["position"]: (r["p_adj"], r["is_significant"]) for r in adjust_large_family(df, rows_per_bucket=rows).collect()}
        assert got == want


def test_wide_families(spark, monkeypatch):
    df = spark.range(60).select(*[F.rand(i).alias(f"c{i}") for i in range(12)]).withColumn("twin", F.col("c3") + F.rand(99) / 10)
    want = {r["pair"]: r for r in correlations(df, method="pearson").collect()}
    monkeypatch.setattr(tiles, "TILE", 5)
    got = {r["pair"]: r for r in correlations(df, method="pearson").collect()}
    assert got == want and got["c3 & twin"]["is_significant"]
