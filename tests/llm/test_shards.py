"""Sharding against prefix sums in plain Python."""

import random
import zlib
from collections import defaultdict

import pytest

from tableaudit.llm import op11_shards as shards
from tableaudit.llm import ordering


def plain(docs, n):
    rows = sorted(
        (
            (d, zlib.crc32((t or "").encode()), len((t or "").encode()) + shards.ROW_BYTES)
            for d, t in docs
        ),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    total, before, places, out = sum(r[2] for r in rows), 0, defaultdict(int), []
    for doc_id, crc, size in rows:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((doc_id, size, crc, shard, places[shard]))
        places[shard] += 1
        before += size
    return sorted(out, key=repr)


def placed(spark, docs, n, parts):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    rows = shards.place(df, n).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    return sorted((tuple(r) for r in rows), key=repr)


CASES = {
    "mixed": [(i, random.Random(i).choice(["", None, "é" * i, "word " * (i % 13)])) for i in range(120)],
    "repeated": [(7, "same text")] * 400 + [(7, "other")] * 3 + [(i, "x" * i) for i in range(50)],
    "no id": [(None, "a"), (None, None), (None, "a"), (3, "\x00"), (1, "")],
    "one long": [(1, "a" * 100_000)] + [(i, "b") for i in range(2, 40)],
    "nulls only": [(i, None) for i in range(48)],
}


@pytest.mark.parametrize("case", list(CASES))
def test_places(spark, case):
    docs = CASES[case]
    for parts in (1, 5):
        assert placed(spark, docs, 24, parts) == plain(docs, 24)


def test_balance_and_contiguity(spark):
    docs = [(i, "x" * random.Random(i).randrange(300)) for i in range(2000)]
    rows = placed(spark, docs, 8, 4)
    largest = max(r[1] for r in rows)
    sizes = defaultdict(int)
    for _, size, _, shard, _ in rows:
        sizes[shard] += size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    by_id = [r[3] for r in sorted(rows)]
    assert by_id == sorted(by_id)
    for shard in range(8):
        assert sorted(r[4] for r in rows if r[3] == shard) == list(range(sum(r[3] == shard for r in rows)))


def test_empty_and_clash(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shards.place(empty).collect() == []
    with pytest.raises(ValueError):
        shards.place(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, Shard int"))


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, None)], "doc_id long, text string, before string")
    out = {r["doc_id"]: r for r in shards.place(df, 2).collect()}
    assert out[1]["before"] == "x" and out[2]["text"] is None and out[2]["size"] == shards.ROW_BYTES


def test_files_hold_their_slots_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * (i % 17)) for i in range(500)], "doc_id long, text string")
    shards.write_shards(docs, str(tmp_path / "out"), 4, rows_per_file=50)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 500 and {r["shard"] for r in rows} == {0, 1, 2, 3}


def test_hot_key_is_spread(spark):
    df = spark.createDataFrame([(1, 1)] * 4000 + [(i, 1) for i in range(2000)], "k long, v long")
    rows = ordering.running(df, [df.k], {"place": df.v}, parts=8)
    assert sorted(r["place"] for r in rows.collect()) == list(range(6000))
    files = spark.read.parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    most = files.groupBy("__part").count().agg({"count": "max"}).first()[0]
    assert most < 1500
