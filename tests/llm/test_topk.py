"""Three-phase top-k against all inner products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tableaudit.llm import op4_topk as topk


def plain(vectors, is_query, k):
    out = []
    for q, qv in vectors.items():
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in vectors.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(df, is_query, k, **options):
    return sorted(map(tuple, topk.top_k(df, is_query, k, **options).collect()))


@pytest.mark.parametrize("kind", ["random", "negative", "hot", "few", "ragged", "large"])
def test_top_k(spark, kind):
    draw = random.Random(kind)
    n, width = (300, 9) if kind != "few" else (4, 3)
    vectors = {i: [draw.randrange(-200, 200) for _ in range(width)] for i in range(n)}
    if kind == "negative":
        vectors = {i: [abs(x) * (-1 if i % 50 else 1) for x in v] for i, v in vectors.items()}
    if kind == "hot":
        vectors = {i: vectors[0] if i % 3 else v for i, v in vectors.items()}
    if kind == "ragged":
        vectors = {i: v[: draw.randrange(0, width + 1)] for i, v in vectors.items()}
    if kind == "large":
        vectors = {i: [x << 22 for x in v] for i, v in vectors.items()}
    df = spark.createDataFrame(list(vectors.items()), "id bigint, v array<bigint>").repartition(3)
    every = 1 if kind == "few" else 25
    want = plain(vectors, lambda i: i % every == 0, 5)
    assert got(df, F.col("id") % every == 0, 5, rows_a_block=64) == want


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.5], 3), (1, None, 3), (2, [1.0, None], 3), (3, [math.nan, 1.0], 3), (4, [math.inf, 1.0], 3)]
    rows += [(5, [0.999, -0.001], 3), (None, [1.0, 1.0], 3), (50, [1.0, 0.5], 3), (50, [1.0, 0.5], 3), (7, [], 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int")
    whole = {r["id"]: r["v"] for r in topk.quantised(df).collect()}
    assert whole == {0: [256, 128], 5: [255, -1], 50: [256, 128], 7: []}
    want = plain(whole, lambda i: i % 50 == 0, 5)
    assert got(topk.quantised(df), F.col("id") % 50 == 0, 5) == want
    assert topk.top_k(topk.quantised(df.limit(0)), F.lit(True)).count() == 0


def test_blocks_do_not_go_through_the_driver(spark):
    """The query blocks are copied to every slot, which no estimate of Spark's counts."""
    import numpy as np

    draw = np.random.default_rng(3)
    rows = [(i, draw.integers(-200, 200, 16).tolist()) for i in range(200)]
    vectors = topk.keep(spark.createDataFrame(rows, "id bigint, v array<bigint>"))
    cut = vectors.withColumn("cut", F.lit(0).cast("bigint"))
    blocks = topk.keep(topk._blocks(cut, 16, 2, 64))
    scores = topk._resolved(vectors.select(F.col("id").alias("query"), (199 - F.col("id")).alias("row")), vectors, vectors)
    for joined in (topk._pairs(blocks, blocks, 16), scores):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        joined.collect()
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    found = {(r["query"], r["row"]): r["score"] for r in scores.collect()}
    assert found == {(i, 199 - i): sum(a * b for a, b in zip(rows[i][1], rows[199 - i][1])) for i in range(200)}
