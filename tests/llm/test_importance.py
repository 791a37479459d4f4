"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tableaudit.llm import op13_importance as importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % importance.BUCKETS


def plain(docs, target):
    s, t = Counter(), Counter()
    for own, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            own.update(bucket(f) for f in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    size = importance.BUCKETS
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (all_s + size) / ((s[b] + 1) * (all_t + size)))) for b in range(size)
    }
    rows = []
    for doc_id, text in docs:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(own), weight, score, None, len(words)])
    pool = sorted((r for r in rows if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, row in enumerate(pool[: 5 * len(pool) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "été", "x9", "the", "of", "über", "中文", "a", "Zeta-eta", "w" * 300]
    odd = [None, "", "...", "\x00", "q" * 10_000, "one"]
    return [
        (i, rng.choice(odd) if i % 9 == 0 else " ,"[i % 2].join(rng.choice(words) for _ in range(rng.randrange(120))))
        for i in range(n)
    ]


def test_query(spark, tmp_path):
    docs = corpus(1, 700) + [(5, "beta of " * 40)] * 40 + [(None, "of the " * 30), (None, None)]
    target = ["the of alpha beta", None, "", "über été 中文 the of"] * 3
    spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, rank int").repartition(5).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    got = sorted((tuple(r) for r in importance.op13_importance(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain(docs, target)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert importance.resample(empty, some).collect() == []
    rows = {r["doc_id"]: r for r in importance.resample(some, empty).collect()}
    assert rows[1]["n_features"] == 6 and rows[2]["weight"] == 0 and rows[1]["rank"] is None


def test_draw_keeps_columns(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in corpus(2, 300)], "doc_id long, text string, more string")
    drawn = importance.draw(docs, docs.limit(5))
    ranked = importance.resample(docs, docs.limit(5)).filter("rank IS NOT NULL").count()
    assert drawn.columns == docs.columns and drawn.count() == ranked > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 é-\x00中", max_size=30), max_size=6))
def test_buckets_of_features(texts):
    found = importance.Features([t.encode() for t in texts])
    got = Counter()
    for document, own in found.parts:
        got.update(zip(document.tolist(), own.tolist()))
    want = Counter((i, bucket(f)) for i, t in enumerate(texts) for f in features(t)[1])
    assert got == want
    assert found.n_words.tolist() == [len(features(t)[0]) for t in texts]


def test_long_features_and_matrix():
    octets = np.frombuffer(random.Random(3).randbytes(9000), np.uint8)
    start = np.arange(0, 4000, 7)
    for length in (1, 2, 255, 3000):
        size = np.full(len(start), length)
        got = importance.buckets_of(octets, start, size, 10_000)
        assert got.tolist() == [zlib.crc32(octets[a : a + length].tobytes()) % 10_000 for a in start]
